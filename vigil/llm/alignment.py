"""Cross-tokenizer alignment by interval coalescing: which tokens of tokenizer A cover the bytes of which tokens of B.

A is a byte-level ``tokenizers`` file and reads a blank and the text; B is a ``sentencepiece`` model and adds the blank
itself. Tokens of both become byte intervals, sorted together by start; a running maximum of their ends gives the
groups, which break where a start reaches that maximum. Inside a group every A-B pair whose intervals overlap is a link.

A task aligns each distinct unit (encoding.py) once: a unit starts with a blank at which both tokenizers start a token,
so no group crosses it, and a document's groups are those of its units one after the other. Documents are packed into
chunks of ``chunk_bytes`` of text and one more document at most. A chunk is one stored row: its units' links as places
in its list of distinct id pairs, and each document's units. The pairs of all chunks are summed by Spark, joined with
the highest count of their B id, and brought back to the chunks that hold them, which add them up by unit and document.
So links themselves are never shuffled, and what meets in one task is bounded by a chunk. A pair is one integer.

Defined cases: a text that is null, empty, or that a tokenizer's bytes don't give back (U+2581 reads back as a blank)
has no tokens, zeros and an empty digest, and adds to no count; rows that repeat one another, in id or wholly, are rows
of their own and count each; a null ``doc_id`` is kept; a very long text is a chunk of its own; further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.encoding import SINGLE_BLANK, Growing, UnitTable, WordModel, byte_letters, gathered, per_process, starts_at_blanks, tokenizer
from vigil.llm.shared import Workspace

CHUNK_BYTES = 4 << 20
BLANK = "▁"
_SIMPLE = re.compile(WordModel.WORD.pattern.join("()") + r"([,.;:!?)]*)")


def coalesce(a_start, a_end, b_start, b_end):
    """(group of each A token, group of each B token, A index of each link, B index of each link).

    Each side's intervals are sorted and don't overlap one another.
    """
    n_a = len(a_start)
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    side = np.concatenate((np.zeros(n_a, np.int8), np.ones(len(b_start), np.int8)))
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, "right")  # of the B tokens that an A token meets
    many = np.searchsorted(b_start, a_end, "left") - first
    return group[:n_a], group[n_a:], np.repeat(np.arange(n_a), many), gathered(first, many)


class Aligner:
    """Alignments of units, remembered in tables."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = tokenizer(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(BLANK, " ").encode() for p in pieces]
        self.pieces = len(pieces)
        # a piece that holds a blank behind a letter could reach across the start of a unit
        self.by_unit = starts_at_blanks(a_path) and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.words = WordModel(self.a, lower=False) if self.by_unit else None
        size = lambda tokens: np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.a_size, self.b_size = size(self.a_bytes), size(self.b_bytes)
        self._reset()
        self.table = UnitTable(self._learn, self._reset)

    def _reset(self) -> None:
        self.whole, self.n_a, self.n_b, self.n_groups = Growing(bool), Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.links, self.link_starts, self.n_links = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.written: list[str] = []

    def _a_ids(self, units: list[str]) -> list[list[int]]:
        """A's ids of a blank and each unit; of a word and the signs behind it, by its model."""
        ids: list[list[int] | None] = [None] * len(units)
        if self.words:
            blank, simple, words = self.words.letters[0x20], _SIMPLE.fullmatch, self.words
            for k, u in enumerate(units):
                found = simple(u)
                if found:
                    word, signs = found.groups()
                    ids[k] = words.ids(blank + words.written(word)) + (words.ids(signs) if signs else [])
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + units[k] for k in rest], add_special_tokens=False)):
            ids[k] = e.ids
        return ids

    def _learn(self, units: list[str]) -> None:
        a_ids = self._a_ids(units)
        b_ids = self.b.encode(units, num_threads=1)
        whole = np.empty(len(units), bool)
        for k, u in enumerate(units):
            raw = (" " + u).encode()
            whole[k] = b"".join([self.a_bytes[i] for i in a_ids[k]]) == raw and b"".join([self.b_bytes[i] for i in b_ids[k]]) == raw
            if not whole[k]:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_group, b_group, la, lb = coalesce(a_end - self.a_size[a], a_end, b_end - self.b_size[b], b_end)
        unit_of_a, unit_of_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        n_links = np.bincount(unit_of_a[la], minlength=len(units))
        n_groups = np.bincount(unit_of_a, weights=np.diff(a_group, prepend=-1), minlength=len(units)).astype(np.int64)
        self.link_starts.extend(self.links.size + np.cumsum(n_links) - n_links)
        self.links.extend(a[la] * self.pieces + b[lb])
        for column, values in ((self.whole, whole), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            column.extend(values)
        self.written += self._text(a, b, a_group, b_group, unit_of_a, unit_of_b, len(units))

    @staticmethod
    def _text(a, b, a_group, b_group, unit_of_a, unit_of_b, units: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each unit."""
        unit, group = np.concatenate((unit_of_a, unit_of_b)), np.concatenate((a_group, b_group))
        side, ids = np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b))
        order = np.lexsort((side, group))  # stable: tokens of a side stay in their order
        unit, group, side, ids = unit[order], group[order], side[order], ids[order]
        new_unit, new_group, new_side = (np.diff(x, prepend=-1) != 0 for x in (unit, group, side))
        before = np.where(new_unit, "", np.where(new_group, ";", np.where(new_side, "|", ",")))
        parts = np.char.add(before, ids.astype("U")) if len(ids) else before
        ends = np.cumsum(np.bincount(unit, minlength=units))
        texts = parts.tolist()
        return ["".join(texts[s:e]) for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def documents(self, texts: list[str | None]):
        """(places of units, number of units of each text, whether each text has tokens)."""
        cut = SINGLE_BLANK.split if self.by_unit else lambda t: [t]
        units = [cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        places = self.table.places(pa.array(chain.from_iterable(units), pa.string()))
        broken = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=~self.whole.values[places], minlength=len(texts)) > 0
        return places, counts, (counts > 0) & ~broken


_CHUNK = """chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>,
            pairs array<long>, pair_counts array<long>, body binary"""


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.concatenate(([0], np.cumsum(values)))[np.cumsum(counts)]
    return np.diff(ends, prepend=0)


def _chunk(aligner: Aligner, number: int, doc_ids: list, texts: list) -> pa.RecordBatch:
    places, counts, good = aligner.documents(texts)
    used = np.repeat(good, counts)
    written = aligner.written
    ends = np.cumsum(counts).tolist()
    listed = places.tolist()
    digests = [hashlib.sha256(";".join([written[p] for p in listed[e - n:e]]).encode()).hexdigest() if g else ""
               for e, n, g in zip(ends, counts.tolist(), good.tolist())]
    totals = [_sums(np.where(used, column.values[places], 0), counts) for column in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links)]
    # units of documents without tokens are left out of what is counted and stored
    units, local, times = np.unique(places[used], return_inverse=True, return_counts=True)
    n_links = aligner.n_links.values[units]
    links = aligner.links.values[gathered(aligner.link_starts.values[units], n_links)]
    pairs, place = np.unique(links, return_inverse=True)
    pair_counts = np.bincount(place, weights=np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)
    arrays = [np.where(good, counts, 0), local, n_links, place]
    packed = zlib.compress(b"".join(len(x).to_bytes(8, "little") + x.astype("<u4").tobytes() for x in arrays), 1)
    columns = [number, doc_ids, *totals, digests, pairs, pair_counts, packed]
    types = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary()]
    names = ["chunk", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "pair_counts", "body"]
    return pa.RecordBatch.from_arrays([pa.array([c if isinstance(c, (int, bytes, list)) else c.tolist()], t) for c, t in zip(columns, types)], names=names)


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(body), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(np.frombuffer(raw, "<u4", n, at + 8).astype(np.int64))
        at += 8 + 4 * n
    return out


def chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents aligned and packed, a row per chunk. A chunk's number is its task's and its place in the task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = per_process(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        number, doc_ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                texts.append(text)
                size += 64 + len(text or "")
                if size >= chunk_bytes:
                    yield _chunk(aligner, number, doc_ids, texts)
                    number, doc_ids, texts, size = number + 1, [], [], 0
        if doc_ids:
            yield _chunk(aligner, number, doc_ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _CHUNK)


def align(docs: DataFrame, ws: Workspace, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is the most frequent one of its B id, ``count_sum`` adds up the links' corpus counts.
    """
    packed = ws.store(chunks(docs, a_path, b_path, chunk_bytes), "chunks", compression="zstd")
    held = packed.select("chunk", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.pair_counts").alias("n"))
    totals = ws.store(pair_counts(held, b_path), "totals")
    found = (held.select("chunk", F.col("pair").alias("__pair")).join(totals, F.col("__pair") == F.col("pair"))
             .groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", "best")).alias("found")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                units_of_doc, units, n_links, place = _unpacked(row["body"].as_py())
                list_of = row["found"].values
                total, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if list_of is not None and len(list_of):
                    order = np.argsort(list_of.field("pair").to_numpy())  # pairs of a chunk are stored ascending
                    total = list_of.field("total").to_numpy()[order]
                    best = list_of.field("best").to_numpy(zero_copy_only=False)[order]
                count_sum, n_best = (_sums(_sums(x[place], n_links)[units], units_of_doc) for x in (total, best.astype(np.int64)))
                plain = {n: row[n].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
                yield pa.RecordBatch.from_arrays(
                    [plain["doc_ids"], plain["n_a"], plain["n_b"], plain["n_groups"], plain["n_links"], pa.array(n_best, pa.int64()),
                     pa.array(count_sum, pa.int64()), plain["digests"]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = packed.drop("pairs", "pair_counts").withColumnRenamed("chunk", "__chunk").join(found, F.col("__chunk") == F.col("chunk"), "left").drop("__chunk", "chunk")
    return joined.mapInArrow(task, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(held: DataFrame, b_path: str) -> DataFrame:
    """(pair, total, best): the links of each id pair in the corpus, and whether no pair of the same B id has more."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    totals = held.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % F.lit(pieces))
    highest = totals.groupBy(F.col("b").alias("__b")).agg(F.max("total").alias("most"))  # a row per B id
    return totals.join(highest, F.col("b") == F.col("__b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
