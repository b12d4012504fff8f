"""The pipeline's stages on planted cases, and every query against its DuckDB answer."""

from pathlib import Path

import pytest

import corpus_pipeline
from check_oracles import compare, duck
from vigil.llm import catalog, oracles
from vigil.llm.shared import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_duckdb(spark, name):
    ok, note = compare(spark, duck(SF), name, catalog.QUERIES[name], oracles.ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_chat_format", "op6_decontaminate", "op8_mixing"])
def test_native_plans_hold_no_python_and_no_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert banned not in plan, banned


@pytest.fixture(scope="module")
def planted(spark, rows, tmp_path_factory):
    docs = load(spark, SF, "documents")
    prose = [r.text for r in docs.where("lang = 'en' AND n_chars BETWEEN 1500 AND 3000").orderBy("doc_id").limit(6).collect()]
    item = load(spark, SF, "benchmark").orderBy("item_id").first().text
    base = 10_000_000
    cases = {base + 1: prose[0] + " Own tail here.", base + 2: (prose[0] + " Own tail here.").upper().lower(), base + 3: prose[1] + " One more.",
             base + 4: prose[1] + " One more word.", base + 5: f"{item} {item}", base + 6: "AGAIN!! AND!! " * 200, base + 7: "word " * 500}
    return docs.unionByName(rows([(i, t, "en", "src0", len(t)) for i, t in cases.items()], "doc_id long, text string, lang string, source string, n_chars long"))


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_takes_effect(spark, planted):
    base, docs, kept = 10_000_000, planted, {}
    space = corpus_pipeline.Workspace(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, space.store(stage(spark, docs, SF), f"{name}")
        kept[name] = ids(docs)
        assert kept[name] <= ids(before)
        if name != "mixing":
            assert docs.columns == planted.columns
    assert not kept["quality"] & {base + 6, base + 7} and {base + 1, base + 3} <= kept["quality"]
    assert base + 1 not in kept["exact_dedup"] and base + 2 in kept["exact_dedup"]
    assert len(kept["near_dedup"] & {base + 3, base + 4}) <= 1
    assert base + 5 in kept["near_dedup"] and base + 5 not in kept["decontamination"]
    assert "copy" in docs.columns
    space.drop()


def test_stages_pass_awkward_and_empty_tables(spark, awkward, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    for docs in (awkward.select(columns), no_docs.select(columns)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 3 * docs.count() and set(columns) <= set(out.columns)


def test_columns_with_the_names_of_helpers_pass(spark, rows):
    """Whatever a table calls its columns, their values come through, and the copy's number finds a free name."""
    texts = ["alpha beta gamma delta epsilon zeta eta theta " * 20, "another text of quite other words that goes on for a while " * 15]
    docs = rows([(i, texts[i], "en", "s", len(texts[i]), i + 5, 10 + i, 20 + i, 30 + i, 40 + i) for i in range(2)],
                "doc_id long, text string, lang string, source string, n_chars long, copy int, __key int, __first int, __score int, __n int")
    space = corpus_pipeline.Workspace(spark, "names")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = space.store(stage(spark, docs, SF), name)
    got = docs.collect()
    space.drop()
    assert got and all(r["copy"] == r.doc_id + 5 and r["__key"] == r.doc_id + 10 and r["__first"] == r.doc_id + 20 and r["__n"] == r.doc_id + 40 and r["copy_"] >= 1 for r in got)


def test_registered():
    import __spark_entry__ as entry

    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert [name.split("_")[0] for name in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)]
