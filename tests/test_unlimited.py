"""Lists are whole unless the caller sets a limit."""

import inspect
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vigil.plans import environment, export, marts, profile

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fn", [profile.evidence_fragments, marts.entity_documents, marts.entity_vulnerabilities,
                                environment.versions_by_product, export.markdown_lines])
def test_the_default_is_all(fn):
    given = [p.default for p in inspect.signature(fn).parameters.values() if p.default is not inspect.Parameter.empty]
    assert given and all(v is None for v in given)


def test_lists_are_whole(table):
    edge = table([("document", f"u{i}", "attack", "x", "mentions", "e") for i in range(30)],
                 "subject_type string, subject_id string, object_type string, object_id string, relation string, evidence string")
    docs = table([(f"u{i}", "t", "s", None) for i in range(30)], "url string, title string, source_key string, published_at timestamp")
    assert marts.entity_documents(edge, docs).count() == 30
    assert marts.entity_documents(edge, docs, 25).count() == 25
    versions = ", ".join(f"{i}.0" for i in range(1, 71))
    products = table([("Acme", "Box", versions)], "vendor string, product string, versions string")
    assert environment.versions_by_product(products).count() == 70
    assert export._first(products, ["vendor"], [F.col("product")], None).count() == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_registered_without_limits(spark):
    got = entry.queries()["entity_documents_all"](spark, SF).agg(F.max("position")).first()[0]
    assert got > 25
