"""Alignment: groups and links against plain sets, whole tables against whole texts encoded at once, defined cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from vigil.llm import alignment, catalog
from vigil.llm.shared import load

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
_made = []


def aligner():
    if not _made:
        _made.append(alignment.Aligner(A, B))
        assert _made[0].by_unit
    return _made[0]


def plain(text):
    """(A ids, B ids, groups as lists of both, links) of one whole text."""
    x = aligner()
    a, b = x.a.encode(" " + (text or ""), add_special_tokens=False).ids, x.b.encode(text or "")
    a_bytes, b_bytes = [x.a_bytes[i] for i in a], [x.b_bytes[i] for i in b]
    if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
        return [], [], [], []
    a_ends, b_ends = np.cumsum([len(v) for v in a_bytes]).tolist(), np.cumsum([len(v) for v in b_bytes]).tolist()
    groups, links, at_a, at_b = [], [], 0, 0
    a_place, b_place = ({end: k for k, end in enumerate(ends)} for ends in (a_ends, b_ends))
    for end in sorted(set(a_ends) & set(b_ends)):
        stop_a, stop_b = a_place[end] + 1, b_place[end] + 1
        groups.append((a[at_a:stop_a], b[at_b:stop_b]))
        links += [(a[i], b[j]) for i in range(at_a, stop_a) for j in range(at_b, stop_b)
                  if max(a_ends[i] - len(a_bytes[i]), b_ends[j] - len(b_bytes[j])) < min(a_ends[i], b_ends[j])]
        at_a, at_b = stop_a, stop_b
    return a, b, groups, links


def brute(rows):
    found = [(doc_id, *plain(text)) for doc_id, text in rows]
    counts, best = Counter(link for f in found for link in f[4]), {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    text = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return sorted(((d, len(a), len(b), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k),
                    hashlib.sha256(text(g).encode()).hexdigest() if a else "") for d, a, b, g, k in found), key=str)


def aligned(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)))))
@settings(max_examples=300, deadline=None)
def test_coalesce(case):
    n, a, b = case
    a_end, b_end = np.array(sorted(a | {n})), np.array(sorted(b | {n}))
    a_start, b_start = np.concatenate(([0], a_end[:-1])), np.concatenate(([0], b_end[:-1]))
    group_a, group_b, la, lb = alignment.coalesce(a_start, a_end, b_start, b_end)
    common = sorted(set(a_end) & set(b_end))
    assert group_a.tolist() == [sum(c <= s for c in common) for s in a_start] and group_b.tolist() == [sum(c <= s for c in common) for s in b_start]
    want = {(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if max(a_start[i], b_start[j]) < min(a_end[i], b_end[j])}
    assert list(zip(la.tolist(), lb.tolist())) == sorted(want)


MIXED = "aZ09é,.'!<|>-_ \t\n  ́漢字😀\x00\x1f\x85▁﻿​"


@given(st.text(alphabet=MIXED, max_size=40) | st.text(max_size=20) | st.sampled_from(["<|endoftext|> a", "it's  so", " lead", "trail ", "<s> x </s>", "   "]))
@settings(max_examples=400, deadline=None)
def test_units_align_as_whole_texts(text):
    x = aligner()
    places, counts, good = x.documents([text, None])
    a, b, groups, links = plain(text)
    assert good.tolist() == [bool(a), False]
    if a:
        assert (int(x.n_a.values[places].sum()), int(x.n_b.values[places].sum()), int(x.n_groups.values[places].sum())) == (len(a), len(b), len(groups))
        own = np.concatenate([x.links.values[s:s + n] for s, n in zip(x.link_starts.values[places], x.n_links.values[places])])
        assert [(int(v) // x.pieces, int(v) % x.pieces) for v in own] == links
        assert ";".join(x.written[p] for p in places) == ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def test_query_against_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in load(spark, SF, "documents").select("doc_id", "text").collect()]
    assert aligned(catalog.op12_token_alignment(spark, SF)) == brute(rows)


def test_awkward_rows_chunks_and_empty_tables(awkward, no_docs, rows, ws, spark):
    from vigil.llm.shared import Workspace

    odd = rows([(8, "a▁b c", "en", "s", 1, "k", 0.1, 1, "c"), (9, "two  blanks\n\nand lines ", "en", "s", 1, "k", 0.1, 1, "c")], awkward.schema.simpleString()[7:-1].replace(":", " "))
    docs = awkward.unionByName(odd).repartition(3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert aligned(alignment.align(docs, ws, A, B)) == want
    assert [w for w in want if w[0] == 8] == [(8, 0, 0, 0, 0, 0, 0, "")]
    small = Workspace(spark, "chunks")
    assert aligned(alignment.align(docs, small, A, B, chunk_bytes=1)) == want  # a chunk per document
    small.drop()
    none = Workspace(spark, "none")
    assert aligned(alignment.align(no_docs, none, A, B)) == []
    none.drop()
