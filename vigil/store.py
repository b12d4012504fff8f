"""Tables in key-hash buckets on the cluster's file system.

A row's bucket is a hash of its natural key. A commit writes the buckets that it touches to a new folder and then a
manifest that names, for every bucket, the folders that hold its rows; readers take the newest manifest. So a batch
rewrites the buckets of its own keys and nothing else, no file is overwritten while a job still reads it, and a job that
died half-way leaves files that no manifest names. ``vacuum`` removes what the last commits no longer name.

A manifest also holds marks: the last batch of each stream, or the last entry of a feed, that its rows take in. Rows and
marks become visible together, so a batch that runs again changes nothing. One writer per table at a time; a writer that
lost a race for a version fails and leaves the table as it was.

Bounds: a manifest holds one entry per bucket and commit that is still named; only bucket numbers come to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas

BUCKETS = 32
MOST_FOLDERS = 8  # of a bucket; appending to more rewrites it
_BUCKET = "__bucket"
_MARK_PREFIX = "m"

MergeRows = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Commit:
    """What a write did: the version it made, the rows it wrote (a merge's with their ``change``), the buckets it rewrote."""
    version: int
    rows: DataFrame
    buckets: list[int]


class Store:
    """Tables below ``root``. ``buckets`` holds for tables that are new; others keep the number of their manifest."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -------------------------------------------------------------------------------------- files
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest_folder(self, table: str) -> str:
        return f"{self.root}/{table}/manifest"

    def versions(self, table: str) -> list[int]:
        return [int(n[1:].split(".")[0]) for n in self._names(self._manifest_folder(table)) if n.startswith(_MARK_PREFIX)]

    def _manifest(self, table: str, version: int | None = None) -> dict:
        known = self.versions(table)
        if not known:
            return {"version": -1, "buckets": self.buckets, "folders": {}, "marks": {}}
        stream = self._fs().open(self._path(f"{self._manifest_folder(table)}/{self._manifest_name(known[-1] if version is None else version)}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @staticmethod
    def _manifest_name(version: int) -> str:
        return f"{_MARK_PREFIX}{version:010d}.json"

    def _publish(self, table: str, manifest: dict) -> None:
        """Write a manifest under a hidden name and move it to its version, which must not exist."""
        fs, folder = self._fs(), self._manifest_folder(table)
        hidden, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{self._manifest_name(manifest['version'])}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(hidden, final):
            fs.delete(hidden, False)
            raise RuntimeError(f"{table}: version {manifest['version']} was written by another job")

    # -------------------------------------------------------------------------------------- reading
    def key(self, table: str) -> list[str]:
        return schemas.KEYS[table]

    def columns(self, table: str) -> list[str]:
        return [c.split(" ")[0].strip("`") for c in _top_level(schemas.TABLES[table])]

    def _bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.key(table)]), F.lit(buckets)).cast("int")

    def _read(self, table: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = manifest["folders"] if buckets is None else {str(b): manifest["folders"].get(str(b), []) for b in buckets}
        paths = [f"{self.root}/{table}/{folder}/{_BUCKET}={b}" for b, folders in wanted.items() for folder in folders]
        return self.spark.read.schema(schemas.TABLES[table]).parquet(*paths) if paths else schemas.empty(self.spark, table)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of the newest commit, or of an older one that is still kept; empty when there is none."""
        return self._read(table, self._manifest(table, version))

    def version(self, table: str) -> int:
        """The number of the newest commit, -1 before the first."""
        return max(self.versions(table), default=-1)

    def marks(self, table: str) -> dict[str, int]:
        return self._manifest(table)["marks"]

    def holds(self, table: str, stream: str, batch: int) -> bool:
        """Whether the table takes in this batch of a stream (batches are taken in their order)."""
        return self.marks(table).get(stream, -1) >= batch

    # -------------------------------------------------------------------------------------- writing
    def _store(self, table: str, rows: DataFrame, buckets: int, extra: list[str] = ()) -> tuple[str, list[int]]:
        """Write rows by bucket to a new folder: its name and the buckets in it. The hint splits large buckets over several tasks."""
        folder = f"c-{uuid.uuid4().hex}"
        placed = rows.select(*self.columns(table), *extra, self._bucket(table, buckets).alias(_BUCKET))
        placed.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.root}/{table}/{folder}")
        found = [int(n.split("=")[1]) for n in self._names(f"{self.root}/{table}/{folder}") if n.startswith(f"{_BUCKET}=")]
        return folder, found

    def _committed(self, table: str, manifest: dict, folder: str, written: list[int], replaced: list[int], marks: dict[str, int]) -> int:
        folders = dict(manifest["folders"])
        for b in replaced:
            folders.pop(str(b), None)
        for b in written:
            folders[str(b)] = [*folders.get(str(b), []), folder]
        self._publish(table, {"version": manifest["version"] + 1, "buckets": manifest["buckets"], "folders": folders,
                              "marks": {**manifest["marks"], **marks}})
        return manifest["version"] + 1

    def _new_rows(self, table: str, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{folder}")

    def write(self, table: str, rows: DataFrame, marks: dict[str, int] | None = None) -> Commit:
        """Replace the whole table."""
        manifest = self._manifest(table)
        folder, written = self._store(table, rows, manifest["buckets"])
        old = [int(b) for b in manifest["folders"]]
        version = self._committed(table, manifest, folder, written, old, marks or {})
        return Commit(version, self._new_rows(table, folder, schemas.TABLES[table]), sorted({*old, *written}))

    def staged(self, table: str, batch: DataFrame) -> DataFrame:
        """A batch written once, so that landed files are parsed once and don't change under a job."""
        path = f"{self.root}/{table}/staged-{uuid.uuid4().hex}"
        typed = batch.withColumns({c: F.col(c).cast("string") for c, kind in batch.dtypes if kind == "void"})
        typed.write.parquet(path)
        return self.spark.read.schema(typed.schema).parquet(path)

    def _touched(self, table: str, staged: DataFrame, manifest: dict) -> list[int]:
        found = staged.select(self._bucket(table, manifest["buckets"]).alias("b")).distinct().collect()  # at most as many rows as buckets
        return sorted(r.b for r in found)

    def merge(self, table: str, batch: DataFrame, fold: MergeRows, marks: dict[str, int] | None = None,
              note: Callable[[DataFrame], None] | None = None) -> Commit:
        """Rewrite the buckets that the batch's keys fall into: ``fold(rows of those buckets, batch)`` gives their next rows.

        A ``change`` column that ``fold`` adds is kept with the commit's rows, for counts. ``note`` gets these rows after
        they were written and before they become visible: what it records of them is never behind the table.
        """
        manifest, staged = self._manifest(table), self.staged(table, batch)
        touched = self._touched(table, staged, manifest)
        return self._rewrite(table, manifest, touched, fold(self._read(table, manifest, touched), staged), marks or {}, note)

    def _rewrite(self, table: str, manifest: dict, buckets: list[int], rows: DataFrame, marks: dict[str, int],
                 note: Callable[[DataFrame], None] | None = None) -> Commit:
        extra = [c for c in ("change",) if c in rows.columns]
        folder, written = self._store(table, rows, manifest["buckets"], extra)
        new_rows = self._new_rows(table, folder, schemas.TABLES[table] + "".join(f", {c} string" for c in extra))
        if note is not None:
            note(new_rows)
        return Commit(self._committed(table, manifest, folder, written, buckets, marks), new_rows, buckets)

    def replace(self, table: str, keys: DataFrame, rows: DataFrame, marks: dict[str, int] | None = None) -> Commit:
        """Rows in place of all stored ones whose bucket key is in ``keys``: also those that have no new row go."""
        manifest, key = self._manifest(table), self.key(table)
        fresh, gone = self.staged(table, rows), self.staged(table, keys.select(*key).distinct())
        touched = sorted({*self._touched(table, fresh, manifest), *self._touched(table, gone, manifest)})
        kept = self._read(table, manifest, touched).join(gone, key, "left_anti")
        return self._rewrite(table, manifest, touched, kept.unionByName(fresh.select(*self.columns(table))), marks or {})

    def append(self, table: str, rows: DataFrame, marks: dict[str, int] | None = None) -> Commit:
        """Add rows that the table doesn't hold yet; stored buckets stay as they are until they have MOST_FOLDERS folders."""
        manifest = self._manifest(table)
        folder, written = self._store(table, rows, manifest["buckets"])
        version = self._committed(table, manifest, folder, written, [], marks or {})
        full = [b for b in written if len(manifest["folders"].get(str(b), [])) >= MOST_FOLDERS]
        if full:
            self.compact(table, full)
        return Commit(version, self._new_rows(table, folder, schemas.TABLES[table]), [])

    def add_missing(self, table: str, batch: DataFrame, fresh: MergeRows, marks: dict[str, int] | None = None) -> Commit:
        """First write wins: ``fresh(rows of the touched buckets, batch)`` gives the rows to add; nothing is rewritten."""
        manifest, staged = self._manifest(table), self.staged(table, batch)
        known = self._read(table, manifest, self._touched(table, staged, manifest))
        return self.append(table, fresh(known, staged), marks)

    def compact(self, table: str, buckets: list[int] | None = None) -> Commit:
        """Rewrite buckets that several folders hold as one folder."""
        manifest = self._manifest(table)
        chosen = [int(b) for b, folders in manifest["folders"].items() if len(folders) > 1] if buckets is None else buckets
        return self._rewrite(table, manifest, chosen, self._read(table, manifest, chosen), {})

    def vacuum(self, table: str, keep: int = 4) -> int:
        """Remove manifests before the last ``keep`` and all files that the kept ones don't name: a reader must end within as many commits.

        Run it while no writer is at work, as its files are not named yet. Returns how many folders went.
        """
        fs, known = self._fs(), self.versions(table)
        named = {(folder, b) for v in known[-keep:] for b, folders in self._manifest(table, v)["folders"].items() for folder in folders}
        removed = 0
        for name in self._names(f"{self.root}/{table}"):
            if name == "manifest":
                continue
            inside = [n for n in self._names(f"{self.root}/{table}/{name}") if n.startswith(f"{_BUCKET}=")]
            unnamed = [n for n in inside if (name, n.split("=")[1]) not in named]
            whole = len(unnamed) == len(inside)
            for path in [f"{self.root}/{table}/{name}"] if whole else [f"{self.root}/{table}/{name}/{n}" for n in unnamed]:
                fs.delete(self._path(path), True)
                removed += 1
        for v in known[:-keep]:
            fs.delete(self._path(f"{self._manifest_folder(table)}/{self._manifest_name(v)}"), False)
        return removed


def _top_level(ddl: str) -> list[str]:
    """Column definitions of a schema string, not cut inside angle brackets."""
    parts, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]
