"""Benchmark decontamination by winnowing.

Test items are cut into windows of 13 words (an item of fewer words is one window). From the 8 hashes of 6 words in
any 13 words a sliding window keeps the least, so each window of a test item has one fingerprint, and a document that
shares the window keeps the same one at the same place: every shared span of 13 words is found (k + w - 1 = 13).
Kept fingerprints are (hash, place) packed in a long; they are stored per document, joined with those of the test
windows, and each hit is extended to the 13-word spans around it, which are compared with the test windows as text.
Items of fewer words are looked for by one hash of all their words at every place, only for lengths that occur.

All rows carried between stages are per document word or per hit; a passage that many documents share adds rows in
proportion to those documents, and equal windows of many items are one window until the final list of items.

Defined cases: null or empty texts have no words and no hits; items without words match nothing; rows that repeat a
document get the same result each; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import WORD, Workspace, ascii_lower, body, marked, row_key

SPAN = 13
GRAM = 6
KEPT_OF = SPAN - GRAM + 1
_PLACE_BITS = 31


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(body(text)), F.lit(WORD), F.lit(0))


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def _pairwise(values: Column, by: int, combine) -> Column:
    """combine(values[i], values[i + by]) for every i at which both exist."""
    return F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - by, F.lit(0))), _shifted(values, by), combine)


def _pack(hashes: Column) -> Column:
    """(32 bits of the hash, place), ordered by the hash, then leftmost first."""
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), _PLACE_BITS).bitwiseOR(i.cast("long")))


def packed_hash(code: Column) -> Column:
    return F.shiftright(code, _PLACE_BITS)


def packed_place(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def _columns(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Add columns one after another. Each step reads columns of the one before, so no array is computed twice."""
    for name, column in steps.items():
        df = df.withColumn(name, column)
    return df


def _longer(grams: str, singles: str, width: int) -> Column:
    """Hashes of width + 1 words from those of ``width`` words and of single words."""
    n = F.greatest(F.size(singles) - width, F.lit(0))
    return F.zip_with(F.slice(grams, F.lit(1), n), F.slice(singles, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))


def _coded(kept: str, span: int) -> Column:
    return F.transform(kept, lambda c: F.struct(F.lit(span).alias("span"), packed_hash(c).alias("hash"), packed_place(c).alias("place")))


def fingerprints(df: DataFrame, words: str, short: list[int]) -> DataFrame:
    """Add ``codes``: kept fingerprints of the 13-word windows and, per length in ``short``, one for every place."""
    both = lambda a, b: F.xxhash64(a, b)
    least = lambda a, b: F.least(a, b)
    n = F.greatest(F.size("__h4") - 2, F.lit(0))
    df = _columns(df, {
        "__h1": F.transform(words, lambda w: F.xxhash64(w)), "__h2": _pairwise(F.col("__h1"), 1, both), "__h4": _pairwise(F.col("__h2"), 2, both),
        "__g": F.zip_with(F.slice("__h4", F.lit(1), n), F.slice("__h2", F.lit(5), n), both),  # 4 + 2 words
        "__p": _pack(F.col("__g")), "__m2": _pairwise(F.col("__p"), 1, least), "__m4": _pairwise(F.col("__m2"), 2, least),
        "__kept": F.array_distinct(_pairwise(F.col("__m4"), 4, least))})
    codes, width, grams = [_coded("__kept", SPAN)], 1, "__h1"
    for span in short:
        while width < span:
            df = df.withColumn(f"__s{width + 1}", _longer(grams, "__h1", width))
            width, grams = width + 1, f"__s{width + 1}"
        df = df.withColumn(f"__c{span}", _pack(F.col(grams)))
        codes.append(_coded(f"__c{span}", span))
    df = df.withColumn("codes", F.concat(*codes))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def windows_of(benchmark: DataFrame) -> DataFrame:
    """One row per item and window: item_id, span (words in the window), window (its text)."""
    items = benchmark.select("item_id", words_of().alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    starts = F.sequence(F.lit(1), F.size("words") - span + 1)
    return (items.select("item_id", "words", span.alias("span"), F.explode(starts).alias("start"))
            .select("item_id", "span", F.array_join(F.slice("words", F.col("start"), F.col("span")), " ").alias("window")))


def scan(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated."""
    item_windows = ws.store(windows_of(benchmark).distinct(), "item_windows")
    tests = item_windows.select("span", "window").distinct()
    # at most 12 lengths under 13, whatever the size of the benchmark
    short = sorted(r[0] for r in item_windows.where(F.col("span") < SPAN).select("span").distinct().collect())
    marks = ws.store(fingerprints(tests.withColumn("words", F.split("window", " ")), "words", short).select("span", "codes"), "mark_codes")
    marks = ws.store(marks.select("span", F.explode("codes").alias("c")).where("c.span = span")
                     .select(F.col("c.span").alias("span"), F.col("c.hash").alias("hash")).distinct(), "marks")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), words_of().alias("words"))
    rows = fingerprints(rows, "words", short)
    found = ws.store(rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "codes"), "fingerprints")

    hits = ws.store(found.select("key", F.explode("codes").alias("c")).select("key", "c.*")
                    .join(marks, ["span", "hash"], "left_semi").select("key", "span", "place").distinct(), "hits")
    places = hits.groupBy("key").agg(F.collect_set(F.struct("span", "place")).alias("places"))  # within one document
    places = ws.store(places, "places")
    touched = marked(docs.select(row_key().alias("key"), "text"), "key", places.select("key")).join(places, "key")
    touched = touched.select("key", words_of().alias("words"), "places")
    reach = SPAN - GRAM
    starts = F.flatten(F.transform("places", lambda p: F.when(p["span"] < SPAN, F.array(F.struct(p["span"].alias("span"), p["place"].alias("start"))))
                                   .otherwise(F.transform(F.sequence(p["place"] - reach, p["place"]),
                                                          lambda s: F.struct(p["span"].alias("span"), s.alias("start"))))))
    inside = F.filter(F.array_distinct(starts), lambda s: (s["start"] >= 0) & (s["start"] + s["span"] <= F.size("words")))
    cut = F.transform(inside, lambda s: F.struct(s["span"].alias("span"), s["start"].alias("start"),
                                                 F.array_join(F.slice("words", s["start"] + 1, s["span"]), " ").alias("window")))
    # the outer form: for the plain one Spark adds a filter on the array, which would be computed twice
    spans = touched.select("key", F.explode_outer(cut).alias("s")).where("s IS NOT NULL").select("key", "s.*")
    matched = ws.store(spans.join(tests, ["span", "window"], "left_semi").distinct(), "matched")

    # words under any matched span: spans in order of their start, each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "span"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["span"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["start"] + s["span"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"])
    hit = matched.groupBy("key").agg(covered.cast("long").alias("n_hit"))
    pairs = matched.select("key", "window").distinct().join(item_windows, "window").select("key", "item_id").distinct()
    named = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"),
                                     F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return (found.select("doc_id", "key", "n_words").join(hit, "key", "left").join(named, "key", "left")
            .select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated")))
