"""Systematic sampling: targets, whole copies, repeats."""

import pytest
from pyspark.sql import functions as F

from vigil.llm import mixing


def level(sizes, weights, most=3):
    """Targets by filling up round after round."""
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else (left * weights[s] / open_weight if open_weight else 0) for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 30, "d": 4, "e": 90}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(rows, sizes):
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {r.source: r.target for r in mixing.source_targets(rows(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(level(sizes, weights))


def test_taken_words_come_near_the_targets(rows, ws):
    docs = [(i, "w " * (1 + i * 7 % 90), f"s{i % 4}" if i % 4 < 3 else None) for i in range(2000)]
    plan = mixing.mix(rows(docs, "doc_id long, text string, source string", 7), ws)
    assert plan.where("copies > 3 OR copies < 0").count() == 0
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r.taken - r.target) <= 2 * r.largest


def test_reruns_agree_and_copies_are_emitted(rows, ws):
    docs = [(i, "w " * (1 + i % 5), "a" if i % 3 else "b") for i in range(90)] + [(5, "w " * 1, "a")] * 2
    df = rows(docs, "doc_id long, text string, source string", 4)
    from vigil.llm.shared import Workspace

    other = Workspace(ws.spark, "again")
    plan, again = mixing.mix(df, ws), mixing.mix(df.repartition(3), other)
    assert sorted(plan.collect()) == sorted(again.collect())
    mixed = mixing.emit(df, plan)
    assert mixed.columns == [*df.columns, "copy"]
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    assert dict(mixed.groupBy("doc_id").count().collect()) == {k: v for k, v in plan.groupBy("doc_id").agg(F.sum("copies")).collect() if v}
    other.drop()


def test_awkward_rows(awkward, ws):
    got = mixing.mix(awkward, ws)
    assert got.count() == awkward.count()
    assert {r.doc_id: r.size for r in got.collect()}[1] == 0


def test_empty_table(no_docs, ws):
    assert mixing.mix(no_docs, ws).count() == 0
