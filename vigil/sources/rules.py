"""Detection rules as data (S9, N16-N18). Rule bodies are stored, never run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import parse_dt
from vigil.sources.common import Parsed, split_rejects

_DOCUMENT = (
    "file string, error string, external_id string, title string, description string, status string, level string, "
    "author string, logsource map<string,string>, detection string, falsepositives array<string>, "
    "references array<string>, tags array<string>")


def techniques_from_tags(tags: Column) -> Column:
    hits = F.transform(tags, lambda t: F.upper(F.regexp_extract(F.trim(t), vocab.RULE_TECHNIQUE_TAG, 1)))
    return F.array_distinct(F.filter(hits, lambda t: t != ""))


def cves_from_tags(tags: Column) -> Column:
    def one(t: Column) -> Column:
        year = F.regexp_extract(F.trim(t), vocab.RULE_CVE_TAG, 1)
        return F.when(year != "", F.concat(F.lit("CVE-"), year, F.lit("-"),
                                           F.regexp_extract(F.trim(t), vocab.RULE_CVE_TAG, 2)))
    return F.array_distinct(F.array_compact(F.transform(tags, one)))


def read_rules(spark: SparkSession, path: str, release: str, published: str | None = None, max_bytes: int | None = None) -> Parsed:
    """YAML files of an unpacked rule release; with ``max_bytes`` a larger file is a reject with that reason."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{yml,yaml}", recursiveFileLookup=True)
    fits = F.lit(True) if max_bytes is None else F.col("_metadata.file_size") <= max_bytes
    files = files.select(F.col("_metadata.file_path").alias("file"), F.when(fits, F.col("value")).alias("text"))
    return parse_rules(files, release, published)


def _words(value, limit: int):
    text = None if value is None else " ".join(str(value).split())[:limit]
    return text or None


def _as_list(value):
    items = [value] if isinstance(value, str) else value if isinstance(value, (list, tuple)) else []
    return [w for w in (_words(i, 500) for i in items) if w]


def _load_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML has no built-in reader in Spark, so files are parsed in Arrow batches inside tasks."""
    import yaml

    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["text"]):
            try:
                doc = None if text is None else yaml.safe_load(text)
                error = "file over the size limit" if text is None else None if isinstance(doc, dict) else "document is not a mapping"
            except yaml.YAMLError:
                doc, error = None, "unreadable YAML"
            doc = doc if isinstance(doc, dict) else {}
            source, body = doc.get("logsource"), doc.get("detection")
            rows.append((
                file, error, _words(doc.get("id"), 300), _words(doc.get("title"), 500),
                _words(doc.get("description"), 2000), _words(doc.get("status"), 32), _words(doc.get("level"), 32),
                _words(doc.get("author"), 300),
                {str(k): _words(v, 300) for k, v in source.items()} if isinstance(source, dict) else {},
                None if body is None else yaml.safe_dump(body, default_flow_style=False, sort_keys=False),
                _as_list(doc.get("falsepositives")), _as_list(doc.get("references")), _as_list(doc.get("tags"))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DOCUMENT.split(", ")])


def parse_rules(files: DataFrame, release: str, published: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Parsed:
    """Rules and rejects of files (file, text). A file costs its parsing far more than its bytes, so files are dealt over
    all partitions, however few they came in; ``keep`` stores what was parsed, so that it is parsed once for both."""
    wide = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = files.repartition(wide, "file", "text").mapInPandas(_load_yaml, _DOCUMENT)
    docs = docs if keep is None else keep(docs)
    reason = F.coalesce(F.col("error"), F.when(F.col("external_id").isNull(), "rule has no id").when(
        F.col("title").isNull(), "rule has no title"))
    parsed = split_rejects(docs, "sigma", reason, F.col("file"))
    good = parsed.good.drop("error").withColumns({
        "status": F.lower("status"), "level": F.lower("level"), "rule_format": F.lit("sigma"),
        "techniques": techniques_from_tags(F.col("tags")), "cve_ids": cves_from_tags(F.col("tags")),
        "release": F.lit(release), "published_at": parse_dt(F.lit(published).cast("string")),
        "source_key": F.lit("sigma"), "tier": F.lit(2)})
    return Parsed(good, parsed.rejects)
