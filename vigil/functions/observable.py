"""Observable and feed-cell columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import squeeze, strip

# fixed values: shapes of observables
SHA256 = "^[0-9a-f]{64}$"
SHA1 = "^[0-9a-f]{40}$"
MD5 = "^[0-9a-f]{32}$"
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
DOMAIN = r"^(?=.{1,253}$)(?!-)[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63})+$"


def fold(col: Column) -> Column:
    """The spelling a lookup compares: trimmed and lowered."""
    return F.lower(strip(F.coalesce(col, F.lit(""))))


def classify(col: Column) -> Column:
    """Kind of observable, or null for anything else."""
    v = fold(col)
    octets = F.forall(F.split(v, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(v.rlike(SHA256), "sha256")
        .when(v.rlike(SHA1), "sha1")
        .when(v.rlike(MD5), "md5")
        .when(F.contains(v, F.lit("://")), "url")
        .when(v.rlike(IPV4), F.when(octets, F.lit("ipv4")))
        .when(v.rlike(DOMAIN), "domain"))


def host_of(col: Column) -> Column:
    """Host of a URL without credentials, port or brackets; a bare host is its own host."""
    v = fold(col)
    netloc = F.regexp_replace(F.regexp_extract(v, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    bracketed = F.regexp_extract(netloc, r"^\[+([^\]]*)", 1)
    host = F.when(netloc.startswith("["), bracketed).otherwise(F.regexp_replace(netloc, ":[^:]*$", ""))
    return F.when(F.contains(v, F.lit("://")), F.when(host != "", host)).when(
        classify(v).isin("domain", "ipv4"), v)


def clean(col: Column) -> Column:
    """Upstream's word, or null where it wrote a placeholder."""
    v = strip(F.regexp_replace(squeeze(col), '^"+|"+$', ""))
    return F.when(~F.lower(v).isin(vocab.PLACEHOLDERS), v)


def split_tags(col: Column) -> Column:
    """Comma-separated tags, cleaned, first occurrence kept."""
    tags = F.transform(F.split(clean(col), ","), clean)
    return F.coalesce(F.array_distinct(F.array_compact(tags)), F.array().cast("array<string>"))


def family_keys(col: Column) -> Column:
    """Names to try against known software: the full name, then without the feed's suffix."""
    name = F.lower(clean(col))
    base = F.regexp_replace(name, vocab.FAMILY_SUFFIX, "")
    keys = F.array_compact(F.array(name, F.when((base != name) & (F.length(base) >= 3), base)))
    usable = name.isNotNull() & ~name.isin(vocab.FORMAT_TAGS)
    return F.when(usable, keys).otherwise(F.array().cast("array<string>"))
