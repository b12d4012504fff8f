"""N-gram Jaccard self-join with a MinHash LSH forest.

Texts are sets of word 5-grams (hashed to 64 bits; a text of one to four words is one n-gram). Texts with the same set
are one representative. The forest has ``TREES`` tries of signatures, each of ``DEPTH`` MinHash values. A trie is its
signatures in sorted order, in range partitions: two neighbours share as long a prefix as any two sets on their sides
do, so the lengths shared by neighbours are the trie, and sets meet at a node of depth k where all neighbours between
them share k values.

Matching starts with whole signatures. A pair of similarity s shares k values in a tree with s^k, so it meets with
1 - (1 - s^k)^trees; the pairs met so far, all of them, with their similarity estimated from signatures, stand
for their own number over that probability. While the recall that this gives for pairs above the threshold is below the
target, the matched prefix is shortened by one value. Six values reach the target for any such pair at the defaults
(5e-6 missed at a similarity of 0.8, far less above), so no more than that is given up.

Connected components of the neighbours that share the matched prefix are the groups in which links are looked for. Texts of a group come together once. A group above ``CHUNK_CHARS`` or
``CHUNK_ROWS`` is dealt to chunks, and each pair of chunks is a task of its own, of bounded size. A task intersects its
sets through an inverted index, verifies every pair by exact Jaccard, and returns for each set how many documents it
links to and one edge of a spanning forest: rows grow with the documents, never with pairs, and no link is left out.

Defined cases: null, empty and wordless texts have no n-grams and stand alone without links; copies link to one
another; the class id is the smallest doc_id of the class (null ids are larger than any); rows that repeat one another
are copies; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import Workspace, marked, row_key

NGRAM = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 8
TARGET_RECALL = 0.99999
CHUNK_ROWS = 500
CHUNK_CHARS = 3_000_000
_SLAB = 2048  # n-grams whose MinHash values are computed at once

# ASCII letters are lowered, other ASCII but digits separates, bytes beyond ASCII belong to words
_WORDS = bytes(c if c >= 128 or chr(c) in string.ascii_lowercase + string.digits else ord(chr(c).lower()) if chr(c) in string.ascii_uppercase else 32
               for c in range(256))
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The length to which prefixes may have to be shortened: a pair at the threshold is found there with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _M2
    values = (values ^ (values >> np.uint64(27))) * _M3
    return values ^ (values >> np.uint64(31))


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode().translate(_WORDS).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    rolled = hashes[:last].copy()
    for i in range(1, n):
        rolled = _mixed(rolled * _M1 + hashes[i:i + last])
    return np.unique(rolled)


def seeds(count: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _M1) | np.uint64(1)


def signature(grams: np.ndarray, factors: np.ndarray) -> bytes:
    """The MinHash values by each of ``factors`` (trees x depth), 16 bits each, so that bytes sort as values do."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), _SLAB):
        np.minimum(least, (factors[:, None] * grams[None, at:at + _SLAB]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("set_id", pa.binary()), ("n_chars", pa.int64()), ("signature", pa.binary())])


def signed(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """doc_id, key, set_id (128 bits of the n-gram set, null if empty), n_chars, signature."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(trees * depth)
        for batch in batches:
            ids, made, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                grams = ngram_set(text, n)
                ids.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                made.append(signature(grams, factors) if len(grams) else None)
                sizes.append(len(text or ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.binary()),
                                              pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], schema=_SIGNED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, key long, set_id binary, n_chars long, signature binary")


# ------------------------------------------------------------------------------------ the forest
def shared_values(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many first values two rows of signatures share."""
    return np.cumprod(one == other, axis=1).sum(axis=1)


_NEIGHBOURS = "a long, b long, depth int, part int, tree int, values binary"


def _walk(depth: int, least: int):
    """Neighbours of a sorted range that share ``least`` values or more; its ends as rows of depth -1 (first) and -2 (last)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def out(a, b, shared, tree, values):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int32()), pa.array([part] * n, pa.int32()),
                                               pa.array(tree, pa.int32()), pa.array(values, pa.binary())], names=["a", "b", "depth", "part", "tree", "values"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            raw = batch.column("values").to_pylist()
            values = np.frombuffer(b"".join(raw), ">u2").reshape(-1, depth)
            if last is None:
                yield out([node[0]], [None], [-1], [tree[0]], [raw[0]])
            else:
                tree, node, values = (np.concatenate((x, y)) for x, y in zip(last, (tree, node, values)))
            shared = np.where(tree[1:] == tree[:-1], shared_values(values[1:], values[:-1]), -1)
            met = np.flatnonzero(shared >= least)
            if len(met):
                yield out(node[met + 1], node[met], shared[met], tree[met], [None] * len(met))
            last = (tree[-1:], node[-1:], values[-1:])
        if last is not None:
            yield out(last[1], [None], [-2], last[0], [last[2][0].tobytes()])

    return task


def forest(reps: DataFrame, ws: Workspace, trees: int, depth: int, least: int) -> DataFrame:
    """Stored edges (a, b, depth): sets that are neighbours in a trie and the most values that they share there, ``least`` or more."""
    width = 2 * depth
    placed = reps.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "tree", F.substring(F.col("signature"), F.col("tree") * width + 1, F.lit(width)).alias("values"), "node")
    order = ["tree", "values", "node"]
    walked = ws.store(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(depth, least), _NEIGHBOURS), "walked")
    # the last row of a range and the first of the next one are neighbours too: two rows for each range
    ends = walked.where("depth < 0")
    line = Window.orderBy("part", F.desc("depth"))
    beside = ends.select("depth", "tree", "values", "a", *[F.lag(c).over(line).alias(f"last_{c}") for c in ("depth", "tree", "values", "a")])
    across = beside.where("depth = -1 AND last_depth = -2 AND tree = last_tree").select("a", F.col("last_a").alias("b"), _shared("values", "last_values", depth).alias("depth"))
    edges = walked.where("depth >= 0").select("a", "b", "depth").unionByName(across.where(F.col("depth") >= least))
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return ws.store(edges.select(low, high, "depth").groupBy("a", "b").agg(F.max("depth").alias("depth")), "edges")


def _shared(one: str, other: str, depth: int) -> Column:
    """How many first values two byte strings share."""
    return sum(((F.substring(F.col(one), F.lit(1), F.lit(2 * k)) == F.substring(F.col(other), F.lit(1), F.lit(2 * k))).cast("int") for k in range(1, depth + 1)), F.lit(0))


def recall(edges: DataFrame, reps: DataFrame, levels: list[int], threshold: float, trees: int) -> dict[int, float | None]:
    """By level, the estimated share of pairs above ``threshold`` that meet at so many values; None where no such pair meets.

    Every pair counts. Its signatures are fetched once for all levels.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, every = np.zeros(len(levels)), np.zeros(len(levels))
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("one", "other"))
            near, depth = (one == other).mean(axis=1), batch.column("depth").to_numpy()
            near, depth = near[near >= threshold], depth[near >= threshold]
            for i, level in enumerate(levels):
                met[i] += (depth >= level).sum()
                every[i] += (1 / (1 - (1 - near[depth >= level] ** level) ** trees)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(met), pa.array(every)], names=["level", "met", "every"])

    side = lambda name: reps.select(F.col("node").alias(f"__{name}"), F.col("signature").alias(name))
    pairs = edges.where(F.col("depth") >= min(levels)).join(side("one"), F.col("a") == F.col("__one")).join(side("other"), F.col("b") == F.col("__other"))
    sums = pairs.select("depth", "one", "other").mapInArrow(weigh, "level int, met double, every double").groupBy("level").agg(F.sum("met"), F.sum("every"))
    found = {level: met / every if met else None for level, met, every in sums.collect()}
    return {level: found.get(level) for level in levels}


def matched_edges(reps: DataFrame, ws: Workspace, threshold: float, trees: int, depth: int, target: float) -> tuple[DataFrame, int]:
    """Edges at the longest prefix that reaches the target recall, and its length."""
    least = matched_depth(threshold, trees, depth, target)
    edges, level = forest(reps, ws, trees, depth, least), depth
    found = recall(edges, reps, list(range(least + 1, depth + 1)), threshold, trees) if level > least else {}
    while level > least and (found[level] is None or found[level] < target):
        level -= 1
    return edges.where(F.col("depth") >= level).select("a", "b"), level


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, root (least node) for every node of ``edges`` (a, b), by alternating large-star and small-star rounds.

    A round replaces edges by edges to least neighbours and never adds any; it takes about log(nodes) of them.
    """
    def least_neighbour(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.join(least_neighbour(both), F.col("u") == F.col("w")).where("v > u")
        return near.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        near = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = ws.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}0")
    seen, turn = mark(current), 0
    while seen[0]:
        turn += 1
        current = ws.store(small(large(current)), f"{name}{turn}")
        now = mark(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def verified(frame: pd.DataFrame, i: int, j: int, threshold: Fraction, n: int) -> tuple[list[int], list[int], list[int]]:
    """Nodes with links between chunks i and j, their number of linked documents, and the root of a spanning forest."""
    sets = [ngram_set(t, n) for t in frame["text"]]
    sizes = np.array([len(s) for s in sets])
    chunk, copies, nodes = frame["chunk"].to_numpy(), frame["copies"].to_numpy(), frame["node"].to_numpy()
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    grams, owners = every[order], owner[order]
    fresh = np.concatenate(([True], grams[1:] != grams[:-1]))
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(grams)))
    of_set = np.empty(len(every), np.int64)
    of_set[order] = group
    starts = np.concatenate(([0], np.cumsum(sizes)))
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        own = of_set[starts[a]:starts[a + 1]]
        own = own[length[own] > 1]
        if not len(own):
            continue
        lengths = length[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        near = common * threshold.denominator >= threshold.numerator * (sizes + sizes[a] - common)
        near[a] = False
        if i != j:
            near &= chunk != chunk[a]
        partners = np.flatnonzero(near)
        links[a] = copies[partners].sum()
        for b in partners[partners > a]:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    linked = np.flatnonzero(links)
    return nodes[linked].tolist(), links[linked].tolist(), [int(nodes[find(a)]) for a in linked]


def similar(docs: DataFrame, ws: Workspace, n: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
            target_recall: float = TARGET_RECALL, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: doc_id, key, class_id, class_key (of the row that stands for the class), class_size, n_links."""
    exact = Fraction(threshold).limit_denominator(1000)
    rows = ws.store(signed(docs, n, trees, depth), "signed")
    with_set = rows.where("set_id IS NOT NULL")
    sets = with_set.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("r"), F.count(F.lit(1)).alias("copies"))
    sets = ws.store(sets.select("set_id", F.col("r.doc_id").alias("rep_id"), F.col("r.key").alias("rep_key"), "copies",
                                F.monotonically_increasing_id().alias("node")), "sets")

    reps = with_set.dropDuplicates(["set_id"]).select("set_id", "n_chars", "signature").join(sets.select("set_id", "node", "rep_key", "copies"), "set_id")
    reps = ws.store(reps.select("node", "rep_key", "copies", "n_chars", "signature"), "reps")
    edges, _ = matched_edges(reps, ws, threshold, trees, depth, target_recall)
    groups = ws.store(components(edges, ws, "group"), "groups")

    members = groups.join(reps.drop("signature"), "node")
    totals = members.groupBy("root").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("sets"))
    chunks = F.greatest(F.ceil(F.col("sets") / chunk_rows), F.ceil(F.col("chars") / chunk_chars)).cast("int")
    members = members.join(totals.select("root", chunks.alias("chunks")), "root").select(
        "root", "node", "rep_key", "copies", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    members = ws.store(members, "members")
    texts = docs.select(row_key().alias("rep_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = (marked(texts, "rep_key", members.select("rep_key")).join(members, "rep_key").dropDuplicates(["rep_key", "node"]))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tasks = texts.select("root", "node", "copies", "chunk", "text", other).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    links = F.lit(0).cast("long")

    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes, counts, roots = verified(frame, key[1], key[2], exact, n)
        return pd.DataFrame({"node": nodes, "links": counts, "peer": roots})

    found = ws.store(tasks.drop("other").groupBy("root", "i", "j").applyInPandas(verify, "node long, links long, peer long"), "found")
    classes = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")), ws, "class")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))

    named = sets.join(classes.withColumnRenamed("root", "class_node"), "node", "left").join(counts, "node", "left")
    named = named.select("set_id", "rep_id", "rep_key", "copies", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("links", links).alias("links"))
    heads = named.groupBy("class_node").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep_key")).alias("h"), F.sum("copies").alias("class_size"))
    named = ws.store(named.join(heads, "class_node").select("set_id", F.col("h.rep_id").alias("class_id"), F.col("h.rep_key").alias("class_key"), "class_size",
                                                           (F.col("links") + F.col("copies") - 1).alias("n_links")), "named")
    return rows.select("doc_id", "key", "set_id").join(named, "set_id", "left").select(
        "doc_id", "key", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("n_links", links).alias("n_links"))
