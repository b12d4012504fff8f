"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

A leaf is the hash of a document's fields. Per ``lang`` the leaves ascend by ``doc_id`` and are hashed in runs of eight,
level by level, to a subroot; the subroots, ordered by language, are hashed alike to the root. A node has the
coordinates (tree, level, place): tree 0 is that of the subroots, tree k + 1 that of the k-th language.

Places come from range partitions (ordering.py), so a language with a third of all rows is no task of its own. Nodes
are built by blocks: a block holds at most ``8 ** BLOCK_LEVELS`` neighbouring nodes of a level and yields all nodes
above them up to its own root, so two or three rounds build any tree and no task holds more than a block.

Proofs are made per leaf partition (a block of leaves) as octopus multiproofs: from the places of its leaves alone it
computes, level by level, the least set of nodes that it can't derive itself (siblings outside the partition up to the
root); all partitions' sets are fetched in one join with the stored nodes; the partition then derives the interior
nodes that its leaves share once, and expands each leaf's own proof from them.

Digests are lowercase hexadecimal SHA-256 and are hashed as that text. Text is hashed where it is read and never
shuffled.

Defined cases: a null field hashes as ``-``, an empty one as ``0:``; null ``lang`` is a tree of its own, the first;
leaves that share a ``doc_id`` (null first) stand in the order of their digests, and repeated rows are leaves of their
own; a language of one leaf has that leaf as its subroot, and one language's subroot is the root; extra columns are not
part of a leaf; an empty table gives no nodes and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.ordering import global_position, ordered, part_offsets
from vigil.llm.shared import Workspace, ascii_lower

FAN = 8
BLOCK_LEVELS = 4  # 4,096 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, place long, digest string"
TOP = 0  # the tree of subroots


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(text: Column = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a document's fields; ``text`` stands in for that field."""
    def field(name: str) -> Column:
        value = (F.col(name) if name != "text" or text is None else text).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(n) for n in fields]), 256)


def heights(n: int) -> list[int]:
    """Numbers of nodes of a tree of ``n`` leaves, from the leaves to the one root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


# ------------------------------------------------------------------------------------------- trees
def manifest(docs: DataFrame, ws: Workspace, tampered: Column = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, trees, nodes), stored.

    leaves: doc_id, leaf, tampered (the leaf of the altered text, or null), tree, place. trees: tree, leaves (their
    number), lang (null also for the top). nodes: all interior nodes and roots, and the leaves of the top tree.
    """
    other = F.lit(None).cast("string") if tampered is None else tampered
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"), other.alias("tampered"))
    rows = ordered(ws, ws.store(named, "hashed"), [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "in_order")
    offsets = part_offsets(rows, ["lang"])
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("leaves"))
    trees = global_position(ordered(ws, per_lang, [F.col("lang").asc_nulls_first()], "langs")).withColumnRenamed("position", "nth")
    trees = ws.store(trees.select((F.col("nth") + 1).alias("tree"), "leaves", "lang"), "trees")
    known = offsets.join(trees.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")))
    known = known.select(F.col("part").alias("__part"), F.col("lang").alias("__lang"), "tree", (F.col("before") - F.col("first_pos")).alias("shift"))
    leaves = rows.join(known, (F.col("part") == F.col("__part")) & F.col("lang").eqNullSafe(F.col("__lang")))
    leaves = ws.store(leaves.select("doc_id", "leaf", "tampered", "tree", (F.col("pos") + F.col("shift")).alias("place")), "leaves")
    base = leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"))
    below = _raised(ws, base, trees.select("tree", "leaves"), "lang")
    # a tree of one leaf has no interior node, its leaf is the subroot
    single = base.join(trees.where("leaves = 1").select(F.col("tree").alias("__tree")), F.col("tree") == F.col("__tree"), "left_semi")
    subroots = _roots(below, trees).unionByName(single)
    top_leaves = ws.store(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), (F.col("tree") - 1).alias("place"), "digest"), "subroots")
    top = _raised(ws, top_leaves, trees.count(), "top")
    return leaves, trees, below.unionByName(top_leaves).unionByName(top)


def _roots(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """The node of the highest level of each tree that has interior nodes."""
    # a tree of more than 8 ** k leaves has more than k levels above them
    high = sum(((F.col("leaves") > F.lit(FAN ** k)).cast("int") for k in range(1, 21)), F.lit(1))
    wanted = trees.where("leaves > 1").select(F.col("tree").alias("__tree"), high.alias("__level"))
    return nodes.join(wanted, (F.col("tree") == F.col("__tree")) & (F.col("level") == F.col("__level"))).drop("__tree", "__level")


def _block_task(level: int, step: int):
    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree, size, digests, first, out = int(rows["tree"].iloc[0]), int(rows["size"].iloc[0]), rows["digest"].tolist(), int(rows["place"].iloc[0]), []
        for up in range(1, step + 1):
            if size == 1:
                break
            digests = [digest("".join(digests[k:k + FAN])) for k in range(0, len(digests), FAN)]
            first, size = first // FAN, -(-size // FAN)
            out += [(tree, level + up, first + k, d) for k, d in enumerate(digests)]
        return pd.DataFrame(out, columns=["tree", "level", "place", "digest"])

    return task


def _raised(ws: Workspace, base: DataFrame, sizes: DataFrame | int, name: str) -> DataFrame:
    """All nodes above ``base`` (level 0), stored by rounds of BLOCK_LEVELS levels; ``sizes`` has tree and leaves, or is the leaves of one tree."""
    largest = sizes if isinstance(sizes, int) else sizes.agg(F.max("leaves")).head()[0] or 0
    top, rounds, current = len(heights(largest)) - 1 if largest else 0, [], base
    for level in range(0, top, BLOCK_LEVELS):
        shrunk = F.lit(sizes) if isinstance(sizes, int) else F.col("leaves")
        for _ in range(level):
            shrunk = F.ceil(shrunk / FAN).cast("long")
        if isinstance(sizes, int):
            sized = current.withColumn("size", shrunk.cast("long"))
        else:
            left = sizes.select(F.col("tree").alias("__tree"), shrunk.alias("size")).where("size > 1")
            sized = current.join(left, F.col("tree") == F.col("__tree"))
        block = F.floor(F.col("place") / FAN ** BLOCK_LEVELS).alias("block")
        made = ws.store(sized.groupBy("tree", block).applyInPandas(_block_task(level, BLOCK_LEVELS), NODES), f"{name}-{level}")
        rounds.append(made)
        current = made.where(F.col("level") == level + BLOCK_LEVELS)
    if not rounds:
        return base.where("false")
    whole = rounds[0]
    for made in rounds[1:]:
        whole = whole.unionByName(made)
    return whole


# ------------------------------------------------------------------------------------------ proofs
def missing(places: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Per level, the siblings that nodes at ``places`` need up to the root and that can't be derived from them: the minimal multiproof."""
    own = np.unique(places)
    for level, size in enumerate(sizes[:-1]):
        runs = np.unique(own // FAN)
        family = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(family[family < size], own, assume_unique=True)
        own = runs


def _needs(top_size: int):
    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block, size = (int(rows[c].iloc[0]) for c in ("tree", "block", "size"))
        out = [(tree, block, tree, level, p) for level, places in missing(rows["place"].to_numpy(), heights(size)) for p in places.tolist()]
        out += [(tree, block, TOP, level, p) for level, places in missing(np.array([tree - 1]), heights(top_size)) for p in places.tolist()]
        return pd.DataFrame(out, columns=["for_tree", "for_block", "tree", "level", "place"])

    return task


class _Partial:
    """Nodes of one tree that a partition knows, and the proofs that they give."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], sizes: list[int]):
        self.sizes, self.levels = sizes, [dict(own)]
        for level, size in enumerate(sizes[:-1]):
            here = self.levels[level]
            runs = {p // FAN for p in here}  # of what is derived, before the fetched ones join
            here.update({p: d for (at, p), d in fetched.items() if at == level})
            self.levels.append({r: digest("".join(here[p] for p in range(r * FAN, min(size, r * FAN + FAN)))) for r in runs})

    def root(self) -> str:
        return next(iter(self.levels[-1].values()))

    def siblings(self, place: int) -> list[list[str]]:
        """Per level, the other nodes of the run, left to right."""
        out = []
        for level, size in enumerate(self.sizes[:-1]):
            first = place // FAN * FAN
            here = self.levels[level]
            out.append([here[p] for p in range(first, min(size, first + FAN)) if p != place])
            place //= FAN
        return out


def folded(node: str, place: int, siblings: list[list[str]]) -> str:
    """The root that a node and its proof give."""
    for others in siblings:
        at = place % FAN
        node = digest("".join(others[:at]) + node + "".join(others[at:]))
        place //= FAN
    return node


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _expand(top_size: int):
    def task(key: tuple, rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c.split(" ")[0]: [] for c in _PROOF.split(", ")})
        tree, size = int(rows["tree"].iloc[0]), int(rows["size"].iloc[0])
        got = {(t, level, p): d for t, level, p, d in zip(fetched["tree"].tolist(), fetched["level"].tolist(), fetched["place"].tolist(), fetched["digest"].tolist())}
        of = lambda wanted: {(level, p): d for (t, level, p), d in got.items() if t == wanted}
        places, leaves = rows["place"].tolist(), rows["leaf"].tolist()
        low = _Partial(dict(zip(places, leaves)), of(tree), heights(size))
        subroot = low.root()
        high = _Partial({tree - 1: subroot}, of(TOP), heights(top_size))
        root, upper, out = high.root(), high.siblings(tree - 1), []
        upper_text = "".join(chain_of(upper))
        for doc_id, place, node, other in zip(rows["doc_id"].tolist(), places, leaves, rows["tampered"].tolist()):
            lower = low.siblings(place)
            again = folded(folded(other or node, place, lower), tree - 1, upper)
            out.append((None if doc_id is None else int(doc_id), node, subroot, root, digest("".join(chain_of(lower)) + upper_text), again, again == root))
        frame = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return frame.astype({"doc_id": "Int64"})

    return task


def chain_of(siblings: list[list[str]]) -> list[str]:
    return [d for others in siblings for d in others]


def prove(ws: Workspace, leaves: DataFrame, trees: DataFrame, nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A proof for each of ``leaves`` (or of ``wanted``, some rows of them): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is recomputed from the tampered leaf, where there is one, and the original siblings. When all leaves are
    proved, a partition of whole runs needs none of the lowest levels, so leaves are not read again for fetching.
    """
    chosen = leaves if wanted is None else wanted
    top_size = trees.count()
    sized = trees.select(F.col("tree").alias("__tree"), F.col("leaves").alias("size"))
    block = F.floor(F.col("place") / FAN ** BLOCK_LEVELS).cast("long")
    parts = (chosen.join(sized, F.col("tree") == F.col("__tree")).drop("__tree").withColumn("block", block)
             .withColumn("doc_id", F.col("doc_id").cast("string")))  # pandas would make floats of integers beside nulls
    asked = parts.select("tree", "block", "size", "place").groupBy("tree", "block").applyInPandas(
        _needs(top_size), "for_tree long, for_block long, tree long, level int, place long")
    if wanted is None:
        pool = nodes.where((F.col("level") >= BLOCK_LEVELS) | (F.col("tree") == TOP))
    else:
        pool = nodes.where((F.col("level") > 0) | (F.col("tree") == TOP)).unionByName(
            leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest")))
    held = pool.select(F.col("tree").alias("__t"), F.col("level").alias("__l"), F.col("place").alias("__p"), "digest")
    fetched = asked.join(held, (F.col("tree") == F.col("__t")) & (F.col("level") == F.col("__l")) & (F.col("place") == F.col("__p")))
    fetched = ws.store(fetched.select("for_tree", "for_block", "tree", "level", "place", "digest"), f"fetched-{uuid.uuid4().hex}")
    return parts.groupBy("tree", "block").cogroup(fetched.groupBy("for_tree", "for_block")).applyInPandas(_expand(top_size), _PROOF)


def lowered_every_third() -> Column:
    """The leaf of a document whose text had its A-Z lower-cased, for ids whose CRC-32 three divides; null for others."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(chosen, leaf(ascii_lower(F.col("text"))))
