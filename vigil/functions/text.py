"""Text, URL and date column functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.binding import let

# Unicode white space, spelled out: cheaper than switching the whole pattern to (?U).
_SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters as a string, for the built-in trim and translate.
_BLANKS = "".join(map(chr, [
    0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000]))


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, f"{_SPACE}+", " "))


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(_BLANKS))


def non_empty(col: Column) -> Column:
    """The text, or null when it is empty."""
    return let(col, lambda v: F.when(v != "", v))


def trimmed(col: Column) -> Column:
    """Trim, and turn an empty result into null. What rows meet by is never cut."""
    return non_empty(strip(col))


def clip(col: Column, n: int) -> Column:
    """Trim, cut at ``n`` characters, and turn an empty result into null."""
    return non_empty(F.substring(strip(col), 1, n))


def _codepoint(cp: Column) -> Column:
    """A Unicode character from its number; null outside the valid range."""
    valid = cp.between(1, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))


def _entity_names() -> Column:
    """The standard library's table of HTML entity names; Spark folds it into one map literal."""
    table = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


# Looked up before the long table, because nearly every entity in practice is one of these.
_COMMON_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "#39": "'"}
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_BARE_ENTITY = r"^(amp|lt|gt|quot|nbsp|copy|reg)(?![A-Za-z0-9;=])"


def decode_entities(col: Column) -> Column:
    """Decode HTML character references exactly once, inside the JVM.

    The text is split at ``&``; each piece decides on its own whether it starts with a reference,
    so a decoded ampersand can never form a second reference with what follows it.
    """
    table = _entity_names()

    def char_of(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.regexp_replace(name, "^#[xX]", ""), 16, 10).try_cast("int")
                        ).otherwise(F.regexp_replace(name, "^#", "").try_cast("int"))
        char = F.when(name.startswith("#"), let(number, _codepoint)).otherwise(F.try_element_at(table, name))
        for key, value in reversed(list(_COMMON_ENTITIES.items())):
            char = F.when(name == key, F.lit(value)).otherwise(char)
        return char

    def decoded(piece: Column, name: Column) -> Column:
        rest = F.regexp_replace(F.substr(piece, F.length(name) + 1), "^;", "")
        return let(char_of(name), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(c, rest)))

    def one(piece: Column, i: Column) -> Column:
        name = let(F.regexp_extract(piece, _ENTITY, 1), lambda n: F.when(n != "", n).otherwise(
            F.regexp_extract(piece, _BARE_ENTITY, 1)))
        found = let(name, lambda n: F.when(n == "", F.concat(F.lit("&"), piece)).otherwise(decoded(piece, n)))
        return F.when(i == 0, piece).otherwise(found)

    return F.when(F.instr(col, "&") > 0, F.array_join(F.transform(F.split(col, "&", -1), one), "")).otherwise(col)


# Possessive repeats keep Java's matcher from recursing once per character.
_COMMENTS_AND_TAGS = r"(?s)<!--.*?(?:-->|\z)|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\z)"


def html_to_text(col: Column, max_len: int | None = None) -> Column:
    """Markup to plain text: drop active blocks, comments and tags, decode once, squeeze blanks."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), vocab.ACTIVE_BLOCK, " ")
    text = F.regexp_replace(text, vocab.LINE_END_TAG, " ")
    text = F.regexp_replace(text, _COMMENTS_AND_TAGS, "")
    text = squeeze(decode_entities(text))
    return shorten(text, max_len) if max_len else text


def shorten(text: Column, max_len: int) -> Column:
    """Cut at the last blank before ``max_len`` and mark the cut."""
    def cut(t: Column) -> Column:
        at_blank = F.regexp_replace(F.substring(t, 1, max_len - 1), r" [^ ]*\z", "")
        return F.when(F.length(t) > max_len, F.concat(at_blank, F.lit("…"))).otherwise(t)

    return let(text, cut)


def _query_part(raw: Column, decoded: Column) -> Column:
    """Re-encode one decoded query name or value the way an HTML form does."""
    encoded = F.url_encode(decoded)
    return F.when(decoded.isNull(), raw).otherwise(F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")),
                                                             F.lit("%7E"), F.lit("~")))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def safe_url(col: Column) -> Column:
    """Canonical http(s) URL, or null for anything that is not one."""
    url = strip(col)
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.lower(F.regexp_extract(url, _URL, 2))
    path = F.regexp_extract(url, _URL, 3)
    # parameters hang on the last path segment only
    path = F.regexp_replace(path, r";[^/]*\z", "")
    query = F.regexp_extract(url, _URL, 4)

    def pair(p: Column) -> Column:
        name, value = F.regexp_extract(p, "^([^=]*)", 1), F.regexp_replace(p, "^[^=]*=?", "")
        return F.struct(
            F.coalesce(F.try_url_decode(name), name).alias("name"),
            F.coalesce(F.try_url_decode(value), value).alias("value"))

    kept = F.filter(
        F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair),
        lambda p: ~F.lower(p["name"]).isin(vocab.TRACKING_PARAMS))
    rebuilt = F.array_join(
        F.transform(kept, lambda p: F.concat(_query_part(p["name"], p["name"]), F.lit("="),
                                             _query_part(p["value"], p["value"]))), "&")
    ok = (F.length(url) > 0) & ~url.rlike("[\\r\\n\\t <>\"']") & scheme.isin("http", "https") & (host != "")
    return F.when(ok, F.concat(
        scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path),
        F.when(rebuilt != "", F.concat(F.lit("?"), rebuilt)).otherwise("")))


# Input date layouts, tried in order. Offsets and a trailing Z are optional where marked.
_DATE_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX][X]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][ XX][ XXX][XXX][XX]",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd[ HH:mm:ss]",
    "d MMM yyyy HH:mm:ss[ XX][ XXX][ z]",
    "d MMM yyyy HH:mm[ XX][ z]",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MM/dd/yyyy",
]


def parse_dt(col: Column) -> Column:
    """Tolerant timestamp parser: UTC timestamp, or null for junk. No offset means UTC."""
    text = F.regexp_replace(squeeze(col), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    text = F.regexp_replace(text, r"(?i)\b(GMT|UT|UTC)$", "+0000")
    text = F.regexp_replace(text, r"(?i)(\d)Z$", "$1+00:00")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in _DATE_LAYOUTS])


def parse_date(col: Column) -> Column:
    return F.to_date(parse_dt(col))


def snippet(text: Column, needle: Column, width: int = 120, lowered: Column | None = None) -> Column:
    """Text around the first case-insensitive hit, with marks where it was cut.

    Pass ``lowered`` when many needles are looked up in one text.
    """
    at = F.position(F.lower(needle), F.lower(text) if lowered is None else lowered)
    start = F.greatest(F.lit(0), at - 1 - width // 2)
    body = F.substr(text, start + 1, at - 1 + F.length(needle) + width // 2 - start)
    return F.when(at > 0, F.concat(F.when(start > 0, F.lit("…")).otherwise(""), strip(body), F.lit("…"))
                  ).otherwise(F.substring(text, 1, width))


def formula_guard(col: Column) -> Column:
    """A spreadsheet must read the cell as text: prefix an apostrophe to formula starters."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin(vocab.FORMULA_PREFIXES), F.concat(F.lit("'"), text)).otherwise(text)


def markdown(col: Column) -> Column:
    """Escape text for Markdown; line breaks become blanks."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.replace(F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1"), F.lit("\n"), F.lit(" "))


def markdown_link(title: Column, url: Column) -> Column:
    """A Markdown link when the target is http(s), else the escaped title alone."""
    target = F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("")), F.lit(")"), F.lit("%29")),
                       F.lit(" "), F.lit("%20"))
    label = markdown(title)
    shown = F.when(label != "", label).otherwise(target)
    return F.when(target.rlike("^https?://"), F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")"))
                  ).otherwise(label)


def contains_ci(col: Column, value: str) -> Column:
    """Case-insensitive literal containment; null reads as no match."""
    return F.coalesce(F.contains(F.lower(col), F.lit(value.lower())), F.lit(False))


def like_term(value: str) -> str:
    """A LIKE pattern that finds the whole ``value`` literally."""
    escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return "%" + escaped + "%"


def fold_name(col: Column) -> Column:
    """Vendor and product spelling used for comparison; null folds to ''."""
    plain = F.translate(F.lower(strip(F.coalesce(col, F.lit("")))), _BLANKS + "_", " " * (len(_BLANKS) + 1))
    return let(plain, lambda p: F.when(F.contains(p, F.lit("  ")), F.regexp_replace(p, " {2,}", " ")).otherwise(p))


def title_or(title: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(title != "", title), fallback)


def drop_controls(col: Column) -> Column:
    """Owner-typed text without control characters; empty becomes null."""
    text = strip(F.regexp_replace(col, r"[\x00-\x1f\x7f]", ""))
    return F.when(text != "", text)


def risk_band(score: Column) -> Column:
    """Reader label of a relevance score."""
    return (F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low"))


def _labels(tags: Column, table: dict[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(names, t), t))


def short_label(title: Column, tags: Column, platforms: Column) -> Column:
    """One-line label: a short title as it is, else the impact and where it applies."""
    has_title = title.isNotNull() & (title != "")
    impact = F.array_join(F.slice(_labels(tags, vocab.TAG_LABELS), 1, 2), " · ")
    where = F.array_join(F.slice(_labels(platforms, vocab.PLATFORM_LABELS), 1, 2), "/")
    described = F.concat_ws(" — ", impact, F.when(where != "", where))
    return (
        F.when(has_title & (F.length(title) <= 70), title)
        .when(F.size(tags) > 0, described)
        .when(has_title, F.concat(F.rtrim(F.substring(title, 1, 70)), F.lit("…")))
        .otherwise("No summary available"))
