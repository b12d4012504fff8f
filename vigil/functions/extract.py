"""Finders and classifiers over free text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.binding import let


def _words(pattern: str) -> str:
    return vocab.JAVA_WORDS + pattern


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost ``|``."""
    found, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            found.append("")
        else:
            found[-1] += ch
    return found


def needed_literals(pattern: str) -> list[str]:
    """For each alternative, lower-case text that every match of it contains.

    Groups, classes, escapes and optional characters are cut out; the longest run left is needed.
    """
    stems = set()
    for alt in _alternatives(pattern):
        while re.search(r"\([^()]*\)", alt):
            alt = re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?\??", "\0", alt)
        alt = re.sub(r"\\.|\[[^\]]*\](?:[?*+]|\{[^}]*\})?\??|\.|.[?*]|[\^$]", "\0", alt)
        stems.add(max(alt.split("\0"), key=len).lower())
    return sorted(stems)


def _with_lowered(text: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` applied to the lowered text, which is computed once however often it is used."""
    return let(F.lower(text), build)


def search(text: Column, pattern: str, low: Column) -> Column:
    """Case-insensitive, Unicode-aware search that runs the pattern only on texts holding a needed
    literal. Plain containment costs a small part of a pattern search, and most texts have none."""
    return F.when(contains_any(low, needed_literals(pattern)), text.rlike(_words(pattern))).otherwise(F.lit(False))


def _search_once(text: Column, pattern: str) -> Column:
    body = F.coalesce(text, F.lit(""))
    return _with_lowered(body, lambda low: search(body, pattern, low))


def find_cves(text: Column) -> Column:
    """CVE ids in first-seen order, hyphens normalised."""
    body = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(body, F.lit(vocab.CVE_IN_TEXT), F.lit(0))
    plain = F.array_distinct(F.transform(hits, lambda x: F.translate(F.upper(x), vocab.HYPHENS[1:], "---")))
    return F.when(F.contains(F.upper(body), F.lit("CVE")), plain).otherwise(F.array().cast("array<string>"))


def find_techniques(text: Column) -> Column:
    """Technique ids, exact case, in first-seen order."""
    body = F.coalesce(text, F.lit(""))
    hits = F.array_distinct(F.regexp_extract_all(body, F.lit(vocab.TECHNIQUE_IN_TEXT), F.lit(1)))
    return F.when(F.contains(body, F.lit("T1")), hits).otherwise(F.array().cast("array<string>"))


def find_edb_ids(text: Column) -> Column:
    """Exploit archive ids named in prose."""
    return F.array_distinct(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(vocab.EDB_IN_TEXT), F.lit(1)))


def exploitation_phrase(text: Column) -> Column:
    """The first phrase that reports exploitation, or null."""
    body = F.coalesce(text, F.lit(""))
    hit = F.regexp_extract(body, _words(vocab.EXPLOITATION_WORDS), 0)
    found = F.when(hit != "", hit)
    return _with_lowered(body, lambda low: F.when(contains_any(low, needed_literals(vocab.EXPLOITATION_WORDS)), found))


def mentions_ransomware(text: Column) -> Column:
    return _search_once(text, vocab.RANSOMWARE_WORD)


def classify_impact(text: Column, cwes: Column | None = None) -> Column:
    """Sorted impact tags from keywords, joined with those the CWE ids imply."""
    body = F.coalesce(text, F.lit(""))

    def tags(low: Column) -> Column:
        found = []
        for tag in sorted(vocab.IMPACT_WORDS):
            hit = search(body, vocab.IMPACT_WORDS[tag], low)
            if cwes is not None and tag in vocab.IMPACT_CWES:
                ids = F.array(*[F.lit(c) for c in vocab.IMPACT_CWES[tag]])
                hit = hit | F.coalesce(F.arrays_overlap(cwes, ids), F.lit(False))
            found.append(F.when(hit, F.lit(tag)))
        return F.array_compact(F.array(*found))

    return _with_lowered(body, tags)


def classify_platforms(text: Column) -> Column:
    """Sorted platform tags from keywords."""
    body = F.coalesce(text, F.lit(""))
    return _with_lowered(body, lambda low: F.array_compact(F.array(*[
        F.when(search(body, vocab.PLATFORM_WORDS[tag], low), F.lit(tag)) for tag in sorted(vocab.PLATFORM_WORDS)])))


def internet_facing(text: Column) -> Column:
    return _search_once(text, vocab.INTERNET_FACING_WORDS)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the literal words occurs in already lowered text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit
