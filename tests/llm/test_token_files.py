"""Token files: coding round trips, files against whole texts encoded at once, order, defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from vigil.llm import catalog, token_files as tf
from vigil.llm.encoding import IdEncoder, drops_blanks, slices
from vigil.llm.shared import load

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def brute(rows, whole):
    """rows in their order of ids -> (doc_id, start, n_tokens, crc)."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*whole(text), 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def read_back(docs, ws, name="files", **options):
    tf.write(docs, ws, ws.path(name), PATH, 1, **options)
    return sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.positions(ws, ws.path(name)).collect())


@given(st.lists(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300) | st.integers(65_000, 66_000), max_size=9), max_size=6))
@settings(max_examples=200, deadline=None)
def test_coding_round_trip(documents):
    counts = np.array([len(d) for d in documents], np.int64)
    ranks = np.array([r for d in documents for r in d], np.uint32)
    control, data = tf.encode(ranks, counts)
    assert [len(c) for c in control] == [-(-len(d) // 4) for d in documents]
    assert [len(x) for x in data] == [sum(0 if r == 0 else 1 if r < 256 else 2 if r < 65_536 else 4 for r in d) for d in documents]
    assert tf.decode(b"".join(control), b"".join(data), counts).tolist() == ranks.tolist()
    rows = [(None if k == 1 else k - 2, len(d), control[k], data[k]) for k, d in enumerate(documents)]
    content = tf.to_file(rows)
    parts = list(tf.from_file(content, most=4))
    doc_ids, missing, n, again = ([v for p in parts for v in p[k]] for k in range(4))
    assert [None if m else int(d) for d, m in zip(doc_ids, missing)] == [r[0] for r in rows] and n == counts.tolist() and again == ranks.tolist()
    for bad in (content[:-1], content + b"x", content[:50] + bytes([content[50] ^ 1]) + content[51:] if len(content) > 50 else b"x" * 48):
        with pytest.raises(ValueError):
            list(tf.from_file(bad))


MIXED = "aZ09é,.;:!?)\"'%$#*&<|>-_ \t\n\r  ́ẞİﬁ漢字😀\x00\x1f\x85"


@given(st.lists(st.text(alphabet=MIXED, max_size=30) | st.text(max_size=12) | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "it's, they'll.", '("Wörd!?"', "...,", "Ab...", "(((x)))", "\x0b\x0c"]), max_size=5))
@settings(max_examples=400, deadline=None)
def test_units_encode_as_whole_texts(parts):
    coder = _coder()
    text = " ".join(parts)
    ids, counts = coder.encode(pa.array([text, "", text]))
    want = coder.tok.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want), 0, len(want)]


_made = []


def _coder():
    if not _made:
        _made.append(IdEncoder(PATH))
        assert _made[0].by_unit
    return _made[0]


def test_other_vocabularies_take_whole_texts():
    assert not drops_blanks(public_tokenizers.path("byte_bpe_50k.json"))
    coder = IdEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.encode(pa.array(["two  words here"]))[0].tolist() == coder.tok.encode("two  words here").ids
    batch = pa.record_batch([pa.array(range(6)), pa.array(["abc", None, "", "defgh", "i", "jk"])], names=["n", "t"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 1, 4)]
    assert sum(parts, []) == list(range(6)) and len(parts) > 1 and slices(batch.slice(0, 0), 1, 4) == []


def test_a_full_memory_starts_anew():
    coder, want = IdEncoder(PATH, remembered=20), IdEncoder(PATH)
    texts = [f"word{k} and again word{k % 3} {'long' * 40}" for k in range(30)]
    whole = [want.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for k in range(0, 30, 4):
        assert coder.encode(pa.array(texts[k:k + 4]))[0].tolist() == [i for ids in whole[k:k + 4] for i in ids]


def test_query_against_whole_texts(spark, whole):
    rows = sorted((r.doc_id, r.text) for r in load(spark, SF, "documents").select("doc_id", "text").collect())
    found = catalog.op13_token_files(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute(rows, whole)


def test_small_files_and_many_parts(spark, rows, ws, whole):
    random.seed(5)
    values = [(random.randrange(-50, 400), " ".join(random.choice(["alpha", "beta", "of", "the"]) for _ in range(random.randrange(30)))) for _ in range(300)]
    docs = rows([(d, t, "x", 1) for d, t in values], "doc_id long, text string, part string, n long", 7)
    found = read_back(docs, ws, file_bytes=500)
    assert [f[1] for f in found] == sorted(d for d, _ in values)
    total = 0
    for start, _, n, _ in found:
        assert start == total
        total += n
    crc = sorted((d, len(whole(t)) + 1, zlib.crc32(np.array([*whole(t), 1], "<u4").tobytes())) for d, t in values)
    assert sorted((f[1], f[2], f[3]) for f in found) == crc
    stored = {(r.doc_id, tuple(r.ids)) for r in tf.read(ws, ws.path("files")).collect()}
    assert stored == {(d, (*whole(t), 1)) for d, t in values}


def test_awkward_rows_and_empty_tables(awkward, no_docs, ws, whole):
    found = read_back(awkward, ws)
    first, rest = found[0], found[1:]
    assert first[1] is None and [f[1] for f in rest] == [1, 2, 3, 4, 5, 6, 6, 7]
    texts = {(r.doc_id, len(whole(r.text)) + 1) for r in awkward.collect()}
    assert {(f[1], f[2]) for f in found} == texts
    assert read_back(no_docs, ws, "none") == []
