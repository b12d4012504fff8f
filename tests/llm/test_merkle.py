"""Merkle manifest: every column against a plain recursion, multiproofs of chosen leaves, defined cases."""

import hashlib
import zlib

import numpy as np
import pytest

from vigil.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, place):
    for level in levels[:-1]:
        first = place // 8 * 8
        yield place - first, [d for k, d in enumerate(level[first:first + 8], first) if k != place]
        place //= 8


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    ordered = {v: sorted(by_lang[v], key=lambda x: x[:3]) for v in langs}
    trees = {v: tree([x[2] for x in ordered[v]]) for v in langs}
    top = tree([trees[v][-1][0] for v in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, (_, _, digest, row) in enumerate(ordered[lang]):
            steps = [*path(trees[lang], place), *path(top, k)]
            node = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf((*row[:4], None if row[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            for at, others in steps:
                node = h("".join(others[:at]) + node + "".join(others[at:]))
            out.append((row[0], digest, trees[lang][-1][0], top[-1][0], h("".join(d for _, o in steps for d in o)), node, node == top[-1][0]))
    return sorted(out, key=str)


def proved(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def plain(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def run(docs, ws):
    return merkle.manifest(docs, ws, merkle.lowered_every_third())


@pytest.fixture(scope="module")
def many(rows):
    """One language of thousands (several blocks), one of exactly a run, one of a run and one, one of a single leaf, many small ones."""
    values = [(i, f"Text {i % 7} ABC é", "big", "s", i, "x", 1) for i in range(5_000)]
    values += [(10_000 + i, "Eight", "eight", None, None, "x", 1) for i in range(8)] + [(11_000 + i, None, "nine", "s", 1, "x", 1) for i in range(9)]
    values += [(12_000, "", None, "s", 0, "x", 1)] + [(13_000 + i, "t", f"l{i}", "s", 0, "x", 1) for i in range(20)]
    return rows(values, DOCS)


def test_against_recursion(many, ws):
    assert proved(merkle.prove(ws, *run(many, ws))) == brute(plain(many))


def test_chosen_leaves_get_the_same_proofs(many, ws):
    built = run(many, ws)
    chosen = built[0].where("doc_id % 97 = 5 OR tree = 1")
    found = proved(merkle.prove(ws, *built, wanted=chosen))
    assert found and set(found) < set(brute(plain(many)))


def test_multiproof_is_minimal():
    sizes = merkle.heights(1_000)
    assert sizes == [1_000, 125, 16, 2, 1]
    whole = dict(merkle.missing(np.arange(1_000), sizes))
    assert all(len(places) == 0 for places in whole.values())
    one = dict(merkle.missing(np.array([999]), sizes))
    assert one[0].tolist() == list(range(992, 999)) and one[1].tolist() == [120, 121, 122, 123] and one[2].tolist() == list(range(8, 15)) and one[3].tolist() == [0]
    pair = dict(merkle.missing(np.array([0, 8]), sizes))  # two runs below one node share what is above
    assert pair[0].tolist() == [*range(1, 8), *range(9, 16)] and pair[1].tolist() == list(range(2, 8)) and pair[2].tolist() == list(range(1, 8))


def test_awkward_rows(awkward, ws):
    docs = awkward.unionByName(awkward.where("doc_id = 5"))  # a row twice more
    assert proved(merkle.prove(ws, *run(docs, ws))) == brute(plain(docs))


def test_empty_and_single(no_docs, rows, ws, spark):
    from vigil.llm.shared import Workspace

    assert proved(merkle.prove(ws, *run(no_docs, ws))) == []
    one, other = rows([(3, "A", "en", "s", 1, "x", 1)], DOCS), Workspace(spark, "single")
    (row,) = proved(merkle.prove(other, *run(one, other)))
    assert row[1] == row[2] == row[3] and row[4] == h("")
    other.drop()
