"""Exact dedup: groups by brute force, state that lasts, digests that clash, awkward rows."""

import hashlib

from pyspark.sql import functions as F

from vigil.llm import exact_dedup


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(normal(text), []).append(doc_id)
    return {(i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for i in ids}


def found(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in df.collect()]


def check(df, docs):
    got = found(df)
    assert len(got) == len(docs)
    assert {g[:4] for g in got} == brute(docs)
    kept = [g for g in got if g[4]]
    assert len(kept) == len({normal(t) for _, t in docs}) and all(g[0] == g[1] for g in kept)


def test_awkward_rows(awkward, ws):
    check(exact_dedup.dedup(awkward, ws), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_clashing_digests_are_settled_by_bytes(rows, ws):
    docs = [(i, f"text {i % 17}") for i in range(120)]
    check(exact_dedup.dedup(rows(docs, "doc_id long, text string", 5), ws, digest=lambda c: F.substring(c, 1, 1)), docs)


def test_many_small_batches_give_the_same(rows, ws):
    docs = [(i, f"text {i % 7}") for i in range(60)]
    check(exact_dedup.dedup(rows(docs, "doc_id long, text string", 6), ws, files_per_batch=1), docs)


def test_state_lasts_between_runs(spark, rows, ws):
    feed, state = ws.path("feed"), ws.path("state")
    exact_dedup.land(rows([(1, "a"), (2, "b")], "doc_id long, text string"), feed, 0)
    exact_dedup.settle(spark, feed, state)
    exact_dedup.land(rows([(9, "A"), (3, "c")], "doc_id long, text string"), feed, 1)
    again = {r.keep_id: r.group_size for r in exact_dedup.settle(spark, feed, state).collect()}
    assert again == {9: 2, 2: 1, 3: 1}


def test_empty_table(no_docs, ws):
    assert found(exact_dedup.dedup(no_docs, ws)) == []


def test_settings_are_restored(spark, rows, ws):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    exact_dedup.dedup(rows([(1, "a")], "doc_id long, text string"), ws).count()
    assert spark.conf.get(key, None) == before
