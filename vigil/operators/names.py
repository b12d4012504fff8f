"""Finding known names in text.

A name counts where neither neighbour is a letter, digit, underscore or hyphen. Text is cut at the
start of every such word, so the words i..i+n-1 joined are the exact text of an n-word candidate;
looking candidates up is set membership instead of one long regular expression, and the cost does
not grow with the number of names. Longest-leftmost selection then runs inside the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.binding import let
from vigil.functions.text import strip

_WORD_START = r"(?U)(?<![\w-])(?=[\w-])"
_WORD = r"(?U)^[\w-]+"
_GAP = r"(?U)[^\w-]+"
_CORE = r"(?U)[\w-](?:.*[\w-])?"
_CUT = "struct<segments:array<string>,words:array<string>>"
HIT = "struct<start:int,stop:int,size:int,surface:string>"


class NameTable(NamedTuple):
    """Terms to look for, the technique ids, and a version that changes when either does."""
    names: DataFrame
    techniques: DataFrame
    version: str


def build_names(objects: DataFrame) -> DataFrame:
    """Names and aliases of live groups, malware, tools and campaigns, one row per term and object."""
    live = objects.filter(~F.col("revoked") & ~F.col("deprecated") & F.col("obj_type").isin(vocab.NAMED_TYPES))
    spelled = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = live.select("stix_id", "obj_type", "name", F.explode(spelled).alias("term"))
    rows = rows.withColumn("term", strip(F.col("term"))).withColumn("low", F.lower("term"))
    rows = rows.filter((F.length("term") >= vocab.MIN_NAME_CHARS) & ~F.col("low").isin(vocab.NEVER_MATCH_NAMES))
    exact = F.col("low").isin(vocab.CASE_SENSITIVE_NAMES) | (F.length("term") < vocab.CASE_SENSITIVE_BELOW_CHARS)
    return rows.select("low", "term", exact.alias("exact"), "stix_id", "obj_type", "name").distinct()


def build_techniques(objects: DataFrame) -> DataFrame:
    live = objects.filter(~F.col("revoked") & ~F.col("deprecated") & (F.col("obj_type") == "technique")
                          & (F.col("external_id") != ""))
    return live.groupBy("external_id").agg(F.min("stix_id").alias("stix_id"))


def build_name_table(objects: DataFrame) -> NameTable:
    """The version is one small aggregate read by the driver: newest change and number of entries."""
    kinds = [*vocab.NAMED_TYPES, "technique"]
    live = ~F.col("revoked") & ~F.col("deprecated") & F.col("obj_type").isin(kinds)
    row = objects.agg(F.max("modified").cast("string").alias("newest"), F.count_if(live).alias("n")).head()
    return NameTable(build_names(objects), build_techniques(objects), f"{row['newest'] or 'empty'}:{row['n']}")


class _Terms(NamedTuple):
    folded: list[str] | None
    exact: list[str] | None
    first_words: list[str] | None
    max_words: int
    max_lead: int
    max_tail: int


def _shape(names: DataFrame) -> DataFrame:
    """Word count and outer punctuation of each term."""
    core = F.regexp_extract("term", "(?s)" + _CORE, 0)
    at = F.position(core, F.col("term"))
    return names.select(
        "low", "term", "exact", core.alias("core"),
        F.size(F.split(core, _WORD_START)).alias("words"), F.greatest(at - 1, F.lit(0)).alias("lead"),
        (F.length("term") - F.length(core) - F.greatest(at - 1, F.lit(0))).alias("tail")).distinct()


def _terms(names: DataFrame, inline_limit: int) -> _Terms:
    """Bounds of the term list, the list itself and the words that terms start with, each when it has at most ``inline_limit`` entries."""
    shape = _shape(names).filter(F.col("core") != "")
    top = shape.agg(F.max("words").alias("w"), F.max("lead").alias("l"), F.max("tail").alias("t"),
                    F.count("*").alias("n")).head()
    bounds = (top["w"] or 0, top["l"] or 0, top["t"] or 0)
    opening = F.lower(F.regexp_extract("core", _WORD, 0)).alias("first")
    if top["n"] > inline_limit:
        first = [r["first"] for r in shape.select(opening).distinct().limit(inline_limit + 1).collect()]
        return _Terms(None, None, sorted(first) if len(first) <= inline_limit else None, *bounds)
    rows = shape.select("low", "term", "exact", opening).collect()
    return _Terms(sorted({r["low"] for r in rows if not r["exact"]}), sorted({r["term"] for r in rows if r["exact"]}),
                  sorted({r["first"] for r in rows}), *bounds)


def _candidates(segments: Column, words: Column, terms: _Terms) -> Column:
    """Every stretch of words that could be a term, with its word positions.

    ``words`` are the lowered words of the text; word i opens segment i.
    """
    known = (lambda w: w != "") if terms.first_words is None else (lambda w: w.isin(terms.first_words))
    starts = F.array_compact(F.transform(words, lambda w, i: F.when(known(w), i + 1)))

    def at(i: Column) -> Column:
        found = []
        for n in range(1, terms.max_words + 1):
            fits = i + (n - 1) <= F.size(segments)
            whole = F.array_join(F.slice(segments, i, n), "")
            last = F.element_at(segments, F.least(i + (n - 1), F.size(segments)))
            gap = F.length(last) - F.length(F.regexp_extract(last, _WORD, 0))
            is_end = i + (n - 1) == F.size(segments)
            before = F.when(i > 1, F.element_at(segments, F.greatest(i - 1, F.lit(1)))).otherwise("")
            lead_room = F.length(before) - F.length(F.regexp_extract(before, _WORD, 0))
            at_start = (i == 1) | ((i == 2) & (lead_room == F.length(before)))
            for lead in range(terms.max_lead + 1):
                for tail in range(terms.max_tail + 1):
                    ok = fits
                    if lead:
                        ok = ok & ((lead_room > lead) | ((lead_room == lead) & at_start))
                    if tail:
                        ok = ok & ((gap > tail) | ((gap == tail) & is_end))
                    surface = F.substr(whole, F.lit(1), F.length(whole) - gap + tail)
                    if lead:
                        surface = F.concat(F.right(before, F.lit(lead)), surface)
                    found.append(F.when(ok, F.struct(
                        i.alias("start"), (i + n).alias("stop"), F.length(surface).alias("size"),
                        surface.alias("surface"))))
        return F.array_compact(F.array(*found)).cast(f"array<{HIT}>")

    return F.flatten(F.transform(starts, at))


def _leftmost_longest(hits: Column) -> Column:
    """Scan left to right; at each word take the longest hit and go on behind it."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["size"]).alias("rank"), h.alias("hit"))))
    none = F.struct(F.lit(0).alias("stop"), F.array().cast(f"array<{HIT}>").alias("kept"))
    done = F.aggregate(order, none, lambda acc, x: F.when(
        x["start"] >= acc["stop"], F.struct(x["hit"]["stop"].alias("stop"),
                                            F.array_append(acc["kept"], x["hit"]).alias("kept"))).otherwise(acc))
    return F.when(F.size(hits) > 0, done["kept"]).otherwise(F.array().cast(f"array<{HIT}>"))


def find_names(docs: DataFrame, key: list[str], text: str, names: DataFrame, inline_limit: int = 20_000) -> DataFrame:
    """``docs`` with ``hits``: matched spellings in order, case-folded names first, then exact ones.

    Up to ``inline_limit`` terms are carried as literals and text never moves. A larger dictionary is
    joined on the candidate spelling instead, which shuffles candidates but never the text with them. Candidates
    start where some term could start, as far as its first words are at most ``inline_limit``.
    """
    terms = _terms(names, inline_limit)
    empty = F.array().cast("array<string>")
    if terms.max_words == 0:
        return docs.withColumn("hits", empty)
    cut = F.struct(F.split(F.col(text), _WORD_START, -1), F.split(F.lower(text), _GAP, -1)).cast(_CUT)
    candidates = let(cut, lambda c: _candidates(c["segments"], c["words"], terms))
    if terms.folded is not None:
        def spellings(cands: Column) -> Column:
            passes = (F.filter(cands, lambda c: F.lower(c["surface"]).isin(terms.folded)),
                      F.filter(cands, lambda c: c["surface"].isin(terms.exact)))
            return F.array_distinct(F.concat(*[
                F.transform(let(p, _leftmost_longest), lambda x: x["surface"]) for p in passes]))

        # one nested expression: nothing in it can be computed twice by later plan rewrites
        return docs.withColumn("hits", let(candidates, spellings))
    cands = docs.select(*key, candidates.alias("_cands")).select(*key, F.explode_outer("_cands").alias("c")).filter(
        F.col("c").isNotNull())
    shape = names.select("low", "term", "exact").distinct()
    same = (F.lower("c.surface") == F.col("low")) & (~F.col("exact") | (F.col("c.surface") == F.col("term")))
    hits = cands.join(shape, same).groupBy(*key).agg(
        F.collect_set(F.when(~F.col("exact"), F.col("c"))).alias("folded"),
        F.collect_set(F.when(F.col("exact"), F.col("c"))).alias("exact"))
    surfaces = [F.transform(_leftmost_longest(F.col(c)), lambda x: x["surface"]) for c in ("folded", "exact")]
    hits = hits.select(*key, F.array_distinct(F.concat(*surfaces)).alias("hits"))
    return docs.join(hits, key, "left").withColumn("hits", F.coalesce("hits", empty))
