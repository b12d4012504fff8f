"""Version and range columns (V1-V7).

A version is readable when every part between separators is a whole number. A readable version
becomes an array of (digits, number text) pairs with leading zeros removed, so arrays order like
the numbers they stand for, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.binding import let

# fixed values: bound notation, separators, and the shape of a version inside prose
BOUND = r"(>=|<=|>|<)\s*([^\s<>=]+)"
SEPARATORS = r"[.\-_+]"
VERSION_IN_TEXT = r"(?<![0-9A-Za-z.])[0-9]+(?:[.][0-9]+)+(?![0-9A-Za-z.])"

_PART = "array<struct<digits:int,number:string>>"


_BOUND_TYPE = "struct<op:string,version:string>"
RANGE = f"struct<lower:{_BOUND_TYPE},upper:{_BOUND_TYPE},label:string>"


def parse_range(versions: Column) -> Column:
    """struct(lower<op,version>, upper<op,version>, label); null when no bound is written."""
    text = F.coalesce(versions, F.lit(""))

    def bound(hit: Column) -> Column:
        op = F.regexp_extract(hit, "^[<>]=?", 0)
        return F.when(hit.isNotNull(), F.struct(op, F.regexp_replace(hit, r"^[<>]=?\s*", "")).cast(_BOUND_TYPE))

    def last(hits: Column, sign: str) -> Column:
        return bound(F.try_element_at(F.filter(hits, lambda h: h.startswith(sign)), F.lit(-1)))

    def rng(hits: Column) -> Column:
        return let(F.struct(last(hits, ">"), last(hits, "<")).cast(f"struct<lower:{_BOUND_TYPE},upper:{_BOUND_TYPE}>"),
                   lambda b: F.struct(b["lower"], b["upper"], F.concat_ws(
                       " ", b["lower"]["op"], b["lower"]["version"], b["upper"]["op"], b["upper"]["version"])).cast(RANGE))

    hits = F.regexp_extract_all(text, F.lit(BOUND), F.lit(0))
    written = F.contains(text, F.lit("<")) | F.contains(text, F.lit(">"))
    return F.when(written, let(hits, lambda h: F.when(F.size(h) > 0, rng(h))))


def cpe_version(cpe: Column) -> Column:
    """The version a CPE 2.3 name pins, or null for a wildcard."""
    part = F.trim(F.get(F.split(cpe, ":"), F.lit(5)))
    return F.when(cpe.startswith("cpe:2.3:") & ~part.isin("*", "-", ""), part)


def parts(version: Column) -> Column:
    """Readable version as comparable parts, or null when any part is not a number."""
    def pair(p: Column) -> Column:
        return let(F.regexp_replace(p, "^0+", ""), lambda number: F.struct(F.length(number), number))

    def readable(raw: Column) -> Column:
        numbers = (F.size(raw) > 0) & F.forall(raw, lambda p: p.rlike("^[0-9]+$"))
        return F.when(numbers, F.transform(raw, pair).cast(_PART))

    return let(F.filter(F.split(F.trim(version), SEPARATORS), lambda p: p != ""), readable)


def _padded(tokens: Column, width: Column) -> Column:
    zero = F.struct(F.lit(0), F.lit("")).cast("struct<digits:int,number:string>")
    return F.concat(tokens, F.array_repeat(zero, width - F.size(tokens)).cast(_PART))


def compare_parts(a: Column, b: Column, a_parts: Column, b_parts: Column) -> Column:
    """-1, 0 or 1, or null when the two cannot be ordered; equal spellings always compare equal."""
    width = F.greatest(F.size(a_parts), F.size(b_parts))
    both = F.array(_padded(a_parts, width), _padded(b_parts, width))
    ordered = let(both, lambda v: F.when(v[0] < v[1], -1).when(v[0] > v[1], 1).otherwise(0))
    return F.when(F.trim(a) == F.trim(b), 0).when(a_parts.isNotNull() & b_parts.isNotNull(), ordered)


def version_key(version_parts: Column) -> Column:
    """Readable parts as one string that sorts as the parts do: every number after its length, zeros at the end left out."""
    def text(p: Column) -> Column:
        return F.concat(F.lpad(F.hex(p["digits"].cast("long")), 8, "0"), p["number"])

    return F.regexp_replace(F.array_join(F.transform(version_parts, text), "."), r"(^|\.)0{8}(\.0{8})*$", "")


def compare_keys(a: Column, b: Column, a_key: Column, b_key: Column) -> Column:
    """``compare_parts`` over keys computed before: plain comparisons, for rows that meet many others."""
    ordered = F.when(a_key < b_key, -1).when(a_key > b_key, 1).otherwise(0)
    return F.when(F.trim(a) == F.trim(b), 0).when(a_key.isNotNull() & b_key.isNotNull(), ordered)


def compare_versions(a: Column, b: Column) -> Column:
    return compare_parts(a, b, parts(a), parts(b))


def version_in_range(version: Column, rng: Column, version_parts: Column | None = None,
                     lower_parts: Column | None = None, upper_parts: Column | None = None) -> Column:
    """'in', 'out' or 'unknown' for a version against a parsed range.

    Callers that join first may pass parts computed before the join.
    """
    v_parts = parts(version) if version_parts is None else version_parts
    lo, up = rng["lower"], rng["upper"]
    lo_parts = parts(lo["version"]) if lower_parts is None else lower_parts
    up_parts = parts(up["version"]) if upper_parts is None else upper_parts
    return inside(version, rng, compare_parts(version, lo["version"], v_parts, lo_parts),
                   compare_parts(version, up["version"], v_parts, up_parts))


def inside(version: Column, rng: Column, lo_cmp: Column, up_cmp: Column) -> Column:
    """'in', 'out' or 'unknown' from the comparisons of a version with both bounds of ``rng``."""
    lo, up = rng["lower"], rng["upper"]
    lo_out = (lo_cmp < 0) | ((lo_cmp == 0) & (lo["op"] == ">"))
    up_out = (up_cmp > 0) | ((up_cmp == 0) & (up["op"] == "<"))
    missing = version.isNull() | (version == "") | rng.isNull()
    return (
        F.when(missing, "unknown")
        .when(lo.isNotNull() & lo_cmp.isNull(), "unknown")
        .when(lo.isNotNull() & lo_out, "out")
        .when(up.isNotNull() & up_cmp.isNull(), "unknown")
        .when(up.isNotNull() & up_out, "out")
        .otherwise("in"))


def version_tokens(raw: Column) -> Column:
    """Concrete versions named in a string, in first-seen order."""
    return F.array_distinct(
        F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(VERSION_IN_TEXT), F.lit(0)))


def version_sort_key(version: Column) -> Column:
    """Numeric sort key of a dotted version."""
    return parts(version)
