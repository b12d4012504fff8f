"""Search over the stored index: against plain Python, and what it reads."""

import random
import re

import pytest

from vigil.plans import textindex

WORDS = ["red", "team", "blue", "box", "Émile", "x_1", "42", "team-red", "RED"]


def plain(text, q):
    """Places of wanted phrases, or None where the query does not hold."""
    own = re.findall(r"\w+", text.lower())
    total, holds = 0, False
    for group in textindex.alternatives(q):
        whole = True
        for negated, phrase in group:
            n = sum(own[i:i + len(phrase)] == list(phrase) for i in range(len(own)))
            whole = whole and ((n == 0) if negated else n > 0)
            total += 0 if negated else n
        holds = holds or whole
    return total if holds else None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["", "red", "red team", "team red"] + [" ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 12))) for _ in range(200)]


@pytest.mark.parametrize("q", ["red", "Red TEAM", '"red team"', '"red team" -blue', "blue -red OR émile", '"team red" box OR "42 x_1"', 'red -"red team"', "-red", '-red -"blue box"',
                               "red red", '"red red"', "team-red", 'OR red OR', "nowhere", '"x_1'])
def test_queries(spark, table, texts, tmp_path, q):
    docs = table(list(enumerate(texts)), "i long, body string")
    textindex.write_postings(textindex.postings(docs, "i", ["body"]), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    got = {r.key: r.hits for r in textindex.search(index, q, docs.selectExpr("i AS key")).collect()}
    assert got == {i: n for i, t in enumerate(texts) if (n := plain(t, q)) is not None}


def test_parts_of_a_query():
    assert textindex.alternatives('a "b c" -d OR -"e f" OR') == [[(False, ("a",)), (False, ("b", "c")), (True, ("d",))], [(True, ("e", "f"))]]
    assert textindex.alternatives(" OR - ... ") == []


def test_refused(spark, table):
    index = textindex.postings(table([(1, "a b")], "i long, body string"), "i", ["body"])
    for q in ("", "-a"):
        with pytest.raises(ValueError):
            textindex.search(index, q)


def test_only_the_words_of_the_query_are_read(spark, table, tmp_path):
    docs = table([(i, f"common w{i}") for i in range(400)], "i long, body string")
    textindex.write_postings(textindex.postings(docs, "i", ["body"]), str(tmp_path / "index"))
    plan = textindex.search(spark.read.parquet(str(tmp_path / "index")), "w7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(word,w7)" in plan.replace("In(word, [w7])", "EqualTo(word,w7)") and "body" not in plan
