"""Key-bucketed tables: what a batch rewrites, what a reader sees, replays, races, clean-up."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil import schemas
from vigil.operators import merge
from vigil.store import MOST_FOLDERS, Store
from vigil.streaming import jobs

AS_OF = datetime(2024, 6, 1)
CACHE = schemas.TABLES["payload_cache"]


def cache_rows(spark, start, stop, payload="p"):
    return spark.range(start, stop).select(F.format_string("CVE-%d", "id").alias("cve_id"), F.lit(payload).alias("payload"), F.lit(True).alias("found"),
                                           F.lit(AS_OF).cast("timestamp").alias("fetched_at"))


def latest(known, batch):
    return merge.put_payloads(known, batch)


def files(tmp_path, table="payload_cache"):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / table).glob("c-*/__bucket=*/part-*")}


def content(store, table="payload_cache"):
    return sorted((r.cve_id, r.payload) for r in store.read(table).collect())


def test_five_rows_rewrite_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=64)
    store.write("payload_cache", cache_rows(spark, 0, 5_000, "old"))
    before, manifest = files(tmp_path), store._manifest("payload_cache")
    assert len(manifest["folders"]) == 64
    batch = cache_rows(spark, 10, 15, "new").withColumn("fetched_at", F.lit(datetime(2024, 7, 1)).cast("timestamp"))
    done = store.merge("payload_cache", batch, latest)
    added = files(tmp_path) - before
    assert 1 <= len(done.buckets) <= 5 and {int(f.split("__bucket=")[1].split("/")[0]) for f in added} == set(done.buckets)
    after = store._manifest("payload_cache")
    assert [b for b in after["folders"] if after["folders"][b] != manifest["folders"][b]] == [str(b) for b in done.buckets]
    assert content(store) == sorted((f"CVE-{i}", "new" if 10 <= i < 15 else "old") for i in range(5_000))
    assert [r[1] for r in sorted((r.cve_id, r.payload) for r in store.read("payload_cache", version=0).collect())] == ["old"] * 5_000


def test_append_adds_files_and_compacts(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    for k in range(MOST_FOLDERS + 2):
        before = files(tmp_path)
        store.append("payload_cache", cache_rows(spark, 100 * k, 100 * k + 100))
        assert before <= files(tmp_path)
    assert max(len(f) for f in store._manifest("payload_cache")["folders"].values()) <= MOST_FOLDERS
    assert len(content(store)) == 100 * (MOST_FOLDERS + 2) == len(set(content(store)))


def test_add_missing_and_replace(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    fresh = lambda known, batch: merge.missing_rows(known, batch, ["cve_id"], ["fetched_at"])
    store.add_missing("payload_cache", cache_rows(spark, 0, 50, "first"), fresh)
    before = files(tmp_path)
    store.add_missing("payload_cache", cache_rows(spark, 40, 60, "second"), fresh)
    assert before <= files(tmp_path)
    assert content(store) == sorted((f"CVE-{i}", "first" if i < 50 else "second") for i in range(60))
    keys = spark.range(5, 8).select(F.format_string("CVE-%d", "id").alias("cve_id"))
    store.replace("payload_cache", keys, cache_rows(spark, 6, 7, "third"))  # the others of the keys go
    assert content(store) == sorted((f"CVE-{i}", "third" if i == 6 else "first" if i < 50 else "second") for i in range(60) if i not in (5, 7))


def test_dead_writers_and_races(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), buckets=4)
    store.write("payload_cache", cache_rows(spark, 0, 20))
    rows = content(store)
    monkeypatch.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        store.merge("payload_cache", cache_rows(spark, 0, 30, "lost"), latest)
    monkeypatch.undo()
    assert content(store) == rows and store.version("payload_cache") == 0  # files without a manifest are not seen
    one, other = store._manifest("payload_cache"), store._manifest("payload_cache")
    store._committed("payload_cache", one, "c-none", [], [], {})
    with pytest.raises(RuntimeError, match="another job"):
        store._committed("payload_cache", other, "c-none", [], [], {})
    assert content(store) == rows


def test_note_comes_before_the_commit(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path), buckets=4), []
    fold = lambda known, batch: latest(known, batch).withColumn("change", F.lit("new"))
    store.merge("payload_cache", cache_rows(spark, 0, 3), fold, note=lambda rows: seen.append((rows.filter("change = 'new'").count(), store.version("payload_cache"))))
    assert seen == [(3, -1)] and store.version("payload_cache") == 0


def test_vacuum_keeps_what_the_last_commits_name(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    store.write("payload_cache", cache_rows(spark, 0, 200))
    for k in range(4):
        store.merge("payload_cache", cache_rows(spark, k, k + 1, f"v{k}").withColumn("fetched_at", F.lit(datetime(2024, 7, 1 + k)).cast("timestamp")), latest)
    rows, old = content(store), files(tmp_path)
    assert store.vacuum("payload_cache", keep=2) > 0
    assert content(store) == rows and store.versions("payload_cache") == [3, 4] and files(tmp_path) < old
    assert not list((tmp_path / "payload_cache").glob("staged-*"))
    assert store.read("payload_cache", version=3).count() == 200
    store.vacuum("payload_cache", keep=1)
    named = {f"{folder}/__bucket={b}" for b, folders in store._manifest("payload_cache")["folders"].items() for folder in folders}
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "payload_cache").glob("c-*/__bucket=*")} == named and content(store) == rows


def test_streams_and_batch_jobs_share_a_table(spark, tmp_path):
    """Replayed batches change nothing, whoever committed in between; two streams keep their own marks."""
    store = Store(spark, str(tmp_path), buckets=4)
    one, two = jobs.snapshot_sink(store, "payload_cache", latest, "one"), jobs.snapshot_sink(store, "payload_cache", latest, "two")
    one(cache_rows(spark, 0, 5, "a"), 0)
    store.append("payload_cache", cache_rows(spark, 100, 105, "batch"))
    two(cache_rows(spark, 5, 9, "b"), 0)
    rows, version = content(store), store.version("payload_cache")
    one(cache_rows(spark, 0, 5, "other"), 0)
    two(cache_rows(spark, 5, 9, "other"), 0)
    assert content(store) == rows and store.version("payload_cache") == version
    one(cache_rows(spark, 20, 21, "c"), 1)
    assert store.marks("payload_cache") == {"one": 1, "two": 0} and len(content(store)) == len(rows) + 1
