"""Text search over a stored inverted index.

A posting is (word, key, positions): where a word stands in a document. Postings are stored in ranges of words and keys,
so a query reads the files whose statistics may hold its words and never a text; a word of a third of all documents spans
several files. A query is what people type into a search box: words must all be there, ``"several words"`` must follow
one another, ``-word`` must not be there, and ``OR`` separates alternatives.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
_PIECE = re.compile(r'(-?)"([^"]*)"|(\S+)')

Phrase = tuple[bool, tuple[str, ...]]  # whether it must not be there, and its words


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(word, key, positions) of every word of a document; a document's positions of a word are counted in its own task."""
    text = F.lower(F.concat_ws("\n", *columns))
    words = docs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(f"({WORD})"))).alias("pos", "word"))
    return words.groupBy("word", "key").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def write_postings(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("word", "key").sortWithinPartitions("word", "key").write.mode("overwrite").parquet(path)


def alternatives(q: str) -> list[list[Phrase]]:
    """What was typed, as alternatives of phrases that must all hold. Signs separate words, as in texts."""
    groups: list[list[Phrase]] = [[]]
    for minus, quoted, bare in _PIECE.findall(q):
        if bare == "OR":
            groups.append([])
            continue
        negated = minus == "-" or (bare.startswith("-") and len(bare) > 1)
        words = tuple(re.findall(r"\w+", (quoted or bare).lower()))
        if words:
            groups[-1].append((negated, words))
    return [g for g in groups if g]


def _there(found: Column, phrase: tuple[str, ...]) -> Column:
    """How often a phrase stands in a document, from the positions of its words."""
    def starts(k: int, word: str) -> Column:
        places = F.coalesce(F.try_element_at(found, F.lit(word)), F.array().cast("array<int>"))
        return F.transform(places, lambda p: p - k)

    return F.size(reduce(F.array_intersect, [starts(k, w) for k, w in enumerate(phrase)]))


def search(index: DataFrame, q: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, hits) of documents that the query finds; ``hits`` counts the places of its wanted phrases.

    One filter on the index and one aggregation by document: what meets in a row are the positions of the query's own
    words. An alternative of unwanted phrases alone finds documents that hold none of the query's words too, so ``keys``
    (all documents) must be given for it.
    """
    groups = alternatives(q)
    if not groups:
        raise ValueError("the query has no searchable word")
    words = sorted({w for g in groups for _, phrase in g for w in phrase})
    per_key = index.filter(F.col("word").isin(words)).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("found"))
    if any(all(negated for negated, _ in g) for g in groups):
        if keys is None:
            raise ValueError("a query of unwanted words alone needs the keys of all documents")
        per_key = keys.join(per_key, "key", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<string,array<int>>")))
    holds, hits = F.lit(False), F.lit(0)
    for group in groups:
        whole = F.lit(True)
        for negated, phrase in group:
            there = _there(F.col("found"), phrase)
            whole = whole & ((there == 0) if negated else (there > 0))
            hits = hits if negated else hits + there
        holds = holds | whole
    return per_key.filter(holds).select("key", hits.cast("long").alias("hits"))
