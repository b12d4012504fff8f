"""Learned operators: held-out accuracy on the test tables, formulas against plain ones, awkward rows."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import catalog, language_id, learning, quality, toxicity
from vigil.llm.shared import load

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


# --------------------------------------------------------------------------------- quality
def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=quality.PLACES), rng.normal(size=(quality.PLACES, 4)))
    places, values = np.array([3, 77, 16000, quality.PLACES - 1]), rng.normal(size=4)
    pairs = sum(machine.factors[places[i]] @ machine.factors[places[j]] * values[i] * values[j] for i in range(4) for j in range(i + 1, 4))
    assert machine.margin(places, values) == pytest.approx(0.3 + machine.linear[places] @ values + pairs)


def test_pairs_are_learned():
    """Labels that only the product of two features tells."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (800, 2))
    rows = [(np.array([10 + a, 20 + b], np.int32), np.ones(2, np.float32)) for a, b in bits]
    labels = (bits[:, 0] ^ bits[:, 1]).astype(float)
    machine = quality.fit_machine(rows, labels, steps=500, decay=0.0)
    assert np.mean([(machine.margin(*r) > 0) == y for r, y in zip(rows, labels)]) > 0.98


def test_degenerate_training():
    assert quality.fit_machine([], np.array([])).score("a") == pytest.approx(0.5)
    one = quality.fit_machine([quality.features("a")] * 3, np.ones(3))
    assert one.score(None) == pytest.approx(0.8)


@tables
def test_quality_held_out(spark):
    got = catalog.op4_quality(spark, SF).join(load(spark, SF, "labels"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97 and len(got) > 40


# --------------------------------------------------------------------------------- language
@tables
def test_language_held_out(spark):
    got = catalog.op9_language_id(spark, SF).join(load(spark, SF, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98 and len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_several_centroids_and_rejection():
    texts = ["the cat sat on the mat", "the dog ran to the cat", "ACGT GATTACA TAGC", "GATTA CCGT TACA"] * 5 + ["der hund lief zur katze", "die katze sass auf der matte"] * 5
    names = ["en"] * 20 + ["de"] * 10
    model = language_id.fit_centroids(names, np.array([language_id.gram_counts(t) for t in texts]))
    assert 2 <= model.languages.count("en") <= language_id.CENTROIDS
    assert model.predict("the mat and the dog")[0] == "en" and model.predict("auf der katze")[0] == "de" and model.predict("TAGACCA")[0] == "en"
    assert model.predict("жшщ ыьэ юя")[2] and model.predict("жшщ ыьэ", reject_as="und")[0] == "und"
    assert not model.predict(texts[0])[2]
    for text in (None, "", "12 34 !?"):
        assert model.predict(text) == ("und", 0.0, True)


def test_nothing_learned():
    model = language_id.fit_centroids([], np.zeros((0, language_id.PLACES)))
    assert model.predict("abc") == ("und", 0.0, True)


# --------------------------------------------------------------------------------- toxicity
@tables
def test_toxicity_held_out(spark):
    got = catalog.op10_toxicity(spark, SF).join(load(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) >= 0.97 and len(got) > 40


def lexicon():
    return toxicity.Lexicon({" ".join(toxicity.folded(w).split()): 5.0 for w in ("loser", "idiot", "scum", "trash", "clown")}, {toxicity.folded("lostra").strip(): 5.0})


@pytest.mark.parametrize("text, hits", [
    ("you l0ser", 1), ("1d10t!", 1), ("$cum and tr@sh", 2), ("an ídıot", 0), ("ｌｏｓｅｒ", 1), ("с1оwn", 1), ("lo​ser", 1), ("LOSER, loser. loser", 3),
    ("losers closer scumble", 0), ("lostraba LOSTRA losträ xlostra", 2), ("take the trash can out", 0), ("trash can, trash", 1), ("a clown fish", 0), ("", 0), (None, 0),
    ("4 0 1 $ @", 0), ("loser!!", 1)])
def test_folding_and_exceptions(text, hits):
    assert lexicon().measure(text)[1] == hits


def test_length_counts():
    words = lexicon()
    words.curve = (-4.0, 1.0, 1.0)
    assert words.score("loser")[0] > words.score("loser " + "fine words " * 5000)[0] > words.score("fine words")[0]


def test_beginnings_are_lengthened_while_words_agree():
    found = {"vequ": (10, 5.0), "vequa": (4, 5.0), "vequb": (6, 5.0), "lowe": (8, 5.0), "lowei": (8, 5.0), "loweix": (3, 4.0), "loweiy": (5, 4.0)}
    assert toxicity.choose_beginnings(found) == {"vequ": 5.0, "lowei": 5.0}


# --------------------------------------------------------------------------------- all three
def test_awkward_rows(awkward, rows):
    labels = rows([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, t boolean").withColumn("toxic", F.col("t").cast("int"))
    labels = labels.unionByName(rows([(None, None, None, None)], "doc_id long, quality int, t boolean, toxic int"))
    more = rows([(i, f"some words {i}", "en", "s", 3) for i in range(10, 60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    n = docs.count()
    for column in (quality.scored(quality.train(docs, labels)), language_id.predicted(language_id.train(docs)), toxicity.scored(toxicity.train(docs, labels))):
        assert docs.select("doc_id", column.alias("c")).where("c IS NOT NULL").count() == n


def test_empty_tables(no_docs, rows):
    labels = rows([], "doc_id long, quality int, toxic int")
    for column in (quality.scored(quality.train(no_docs, labels)), language_id.predicted(language_id.train(no_docs)), toxicity.scored(toxicity.train(no_docs, labels))):
        assert no_docs.select(column).count() == 0


def test_held_out_rows_and_null_ids_are_not_learned_from(rows):
    import zlib

    labels = rows([(i, i % 2) for i in range(300)] + [(None, 1), (301, None), (7, 0)], "doc_id long, quality int")
    docs = rows([(i, f"text {i}") for i in range(302)] + [(None, "none")], "doc_id long, text string")
    got = learning.labelled_texts(docs, labels, "quality", 10_000).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    assert all(r.label == r.doc_id % 2 and r.text == f"text {r.doc_id}" for r in got)  # 7 has two labels, the larger one stays
    few = sorted(r.doc_id for r in learning.labelled_texts(docs, labels, "quality", 100).collect())
    assert len(few) == 100 and few == sorted(r.doc_id for r in learning.labelled_texts(docs.repartition(5), labels, "quality", 100).collect())


def test_samples_are_bounded_whatever_repeats(spark, rows):
    """One id with one text, and one id with many texts, hold a third of all rows each; one language has nearly all."""
    docs = (spark.range(1_000).select("id", F.format_string("text %d", "id").alias("text"))
            .unionByName(spark.range(1_000).select(F.lit(5).cast("long").alias("id"), F.lit("again").alias("text")))
            .unionByName(spark.range(1_000).select(F.lit(6).cast("long").alias("id"), F.format_string("own %d", "id").alias("text"))))
    docs = docs.select(F.col("id").alias("doc_id"), "text", F.when(F.col("id") < 20, F.concat(F.lit("l"), (F.col("id") % 4).cast("string"))).otherwise("en").alias("lang"))
    labels = spark.range(1_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for bound in (50, 400):
        got = learning.labelled_texts(docs, labels, "quality", bound).collect()
        assert len(got) == bound == len({(r.doc_id, r.text) for r in got})
        per = learning.texts_per_value(docs, "lang", bound, 3).groupBy("value").count().collect()
        assert len(per) == 3 and max(r["count"] for r in per) <= bound
    assert learning.labelled_texts(docs, labels, "quality", 10_000).where("text = 'again'").count() <= 1


# --------------------------------------------------------------------------------- plain versions
@tables
def test_scores_equal_plain_versions(spark):
    """Every row of a whole table: the queries' scores against loops over characters, words and pairs."""
    import math
    import unicodedata

    docs = load(spark, SF, "documents").where("doc_id < 300")
    rows = docs.collect()

    centroids = language_id.train(load(spark, SF, "documents"))
    found = {r.doc_id: r.p for r in docs.select("doc_id", language_id.predicted(centroids).alias("p")).collect()}
    for row in rows:
        weights = {}
        for place in np.flatnonzero(counts := language_id.gram_counts(row.text)):
            weights[place] = math.log1p(counts[place]) * centroids.idf[place]
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        cosines = [sum(w / norm * centre[place] for place, w in weights.items()) for centre in centroids.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        got = found[row.doc_id]
        if not any(unicodedata.category(c).startswith("L") for c in row.text or ""):
            assert got.lang_pred == "und"
        else:
            assert got.lang_pred == centroids.languages[best] and got.score == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-6)

    words = toxicity.train(load(spark, SF, "documents"), load(spark, SF, "labels"))
    found = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scored(words).alias("s")).collect()}
    for row in rows:
        own = toxicity.folded(row.text or "").split()
        total = hits = 0
        spared = set()
        for phrase in toxicity.EXCEPTIONS:
            parts = toxicity.folded(phrase).split()
            spared |= {k for at in range(len(own) - len(parts) + 1) if own[at:at + len(parts)] == parts for k in range(at, at + len(parts))}
        for k, word in enumerate(own):
            begun = [w for b, w in words.beginnings.items() if word.startswith(b)]
            weight = max([*begun, *([words.words[word]] if word in words.words else [])], default=None)
            if weight is not None and k not in spared:
                total, hits = total + weight, hits + 1
        assert found[row.doc_id].hits == hits, row.doc_id
        inputs = toxicity.curve_inputs(total, len(own))
        assert found[row.doc_id].score == pytest.approx(1 / (1 + math.exp(-float(np.dot(words.curve, inputs)))), abs=1e-6)
