"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its distinct words hashed into 2^14 places (values: damped counts, scaled to length 1), and one
place for each statistic's bin (repeated words and lines, capitals, digits, punctuation, word length, ...) and for its
metadata (size in characters and bytes). A score has a bias, linear weights and low-rank pairwise interactions of all
features; those are summed in linear time as half of (sum of v x) squared minus the sum of (v x) squared. No label,
language, source or id is a feature.

The model is fitted on a bounded sample of labelled rows outside the held-out fold (``train_rows``, default 8,000):
features are computed by tasks, and the sample's sparse rows, some megabytes, are fitted by mini-batch Adam. Scoring
runs over all rows and whole texts in Arrow batches.

Defined cases: null and empty texts have no words and the same statistics; long texts are read whole; without
labelled rows every score is 0.5, with one class only it is that class's share smoothed by one row each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.learning import labelled_texts

WORD_PLACES = 1 << 14
ACCEPT = 0.3
# Upper bin edges of each statistic.
_EDGES = {
    "distinct": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "top_word": (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75),
    "follows_itself": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "repeated_lines": (0.01, 0.1, 0.2, 0.3, 0.5, 0.7),
    "capitals": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6),
    "digits": (0.002, 0.01, 0.03, 0.1, 0.3),
    "stops": (0.005, 0.01, 0.02, 0.04, 0.08, 0.15),
    "marks": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "beyond_ascii": (0.001, 0.02, 0.1, 0.3),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "words": (0.5, 5, 10, 20, 50, 100, 200, 500, 1000, 5000),
    "characters": (0.5, 20, 50, 100, 300, 1000, 3000, 10000, 50000),
    "bytes_per_character": (1.0001, 1.02, 1.1, 1.3, 2),
}
_FIRST = dict(zip(_EDGES, WORD_PLACES + np.cumsum([0, *(len(e) + 1 for e in _EDGES.values())])))
PLACES = int(WORD_PLACES + sum(len(e) + 1 for e in _EDGES.values()))
_STATISTIC_VALUE = 0.5


def _table(characters: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=np.int64)
    mask[list(characters)] = 1
    return mask


_CLASSES = {"capitals": _table(bytes(range(65, 91))), "digits": _table(bytes(range(48, 58))), "stops": _table(b".,;:?'\"-"),
            "marks": _table(b"!#$%&*+/<=>@[\\]^_`{|}~"), "beyond_ascii": _table(bytes(range(128, 256)))}


def statistics(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    n = max(1, len(words))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    seen, size = np.bincount(data, minlength=256), max(1, len(data))
    lines = text.split("\n")
    out = {name: float(seen @ mask) / size for name, mask in _CLASSES.items()}
    out |= {"distinct": len(counts) / n, "top_word": max(counts.values(), default=0) / n,
            "follows_itself": sum(map(eq, words, islice(words, 1, None))) / n, "repeated_lines": 1 - len(set(lines)) / len(lines),
            "word_length": sum(map(len, words)) / n, "words": float(len(words)), "characters": float(len(text)),
            "bytes_per_character": len(data) / max(1, len(text))}
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, words and statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = statistics(text, words, counts)
    own = [_FIRST[name] + int(np.searchsorted(edges, stats[name], side="left")) for name, edges in _EDGES.items()]
    places = np.array([zlib.crc32(w.encode()) & (WORD_PLACES - 1) for w in counts] + own, dtype=np.int32)
    values = np.full(len(places), _STATISTIC_VALUE, dtype=np.float32)
    if counts:
        damped = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
        values[:len(counts)] = damped / np.linalg.norm(damped)
    return places, values


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        weighted = self.factors[places] * values[:, None]
        summed = weighted.sum(axis=0)
        return float(self.bias + self.linear[places] @ values + 0.5 * (summed @ summed - (weighted * weighted).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def _constant(probability: float) -> Machine:
    return Machine(float(np.log(probability / (1 - probability))), np.zeros(PLACES, np.float32), np.zeros((PLACES, 1), np.float32))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, steps: int = 800, batch: int = 128,
                rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss, mini-batch Adam; gradients follow from the same linear-time sums as the score."""
    if len(labels) == 0:
        return _constant(0.5)
    if labels.min() == labels.max():
        return _constant((labels.sum() + 1) / (len(labels) + 2))
    rng = np.random.default_rng(seed)
    share = labels.mean()
    bias, linear = np.log(share / (1 - share)), np.zeros(PLACES)
    factors = rng.normal(0, 0.02, (PLACES, rank))
    moments = {"w": [np.zeros(PLACES), np.zeros(PLACES)], "v": [np.zeros((PLACES, rank)), np.zeros((PLACES, rank))]}
    step = 0
    while step < steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            places = np.concatenate([rows[i][0] for i in chosen])
            values = np.concatenate([rows[i][1] for i in chosen]).astype(np.float64)
            starts = np.cumsum([0, *(len(rows[i][0]) for i in chosen[:-1])])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            weighted = factors[places] * values[:, None]
            summed = np.add.reduceat(weighted, starts, axis=0)
            margin = bias + np.add.reduceat(linear[places] * values, starts) + 0.5 * (
                (summed * summed).sum(axis=1) - np.add.reduceat((weighted * weighted).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            pull = error[owner] * values
            used, at_used = np.unique(places, return_inverse=True)
            gradient_w = np.bincount(at_used, pull, minlength=len(used)) + decay * linear[used]
            inner = pull[:, None] * (summed[owner] - weighted)
            gradient_v = np.stack([np.bincount(at_used, inner[:, f], minlength=len(used)) for f in range(rank)], axis=1) + decay * factors[used]
            step += 1
            bias -= rate * error.sum()
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for target, gradient, (first, second) in ((linear, gradient_w, moments["w"]), (factors, gradient_v, moments["v"])):
                first[used] = 0.9 * first[used] + 0.1 * gradient
                second[used] = 0.999 * second[used] + 0.001 * gradient * gradient
                target[used] -= scale * first[used] / (np.sqrt(second[used]) + 1e-8)
    return Machine(float(bias), linear.astype(np.float32), factors.astype(np.float32))


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [features(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "places": [p.tobytes() for p, _ in made],
                            "vals": [v.tobytes() for _, v in made]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 8000) -> Machine:
    sample = labelled_texts(docs, labels, label, train_rows).mapInPandas(_feature_rows, "doc_id long, label int, places binary, vals binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["places"], r["vals"]))  # the same order whatever the partitions
    return fit_machine([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in rows],
                       np.array([r["label"] for r in rows], dtype=np.float64))


def scored(model: Machine) -> Column:
    """The score of column ``text``."""
    shared = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.score(t) for t in texts], dtype="float64")

    return score(F.col("text"))


def accepted(score: Column) -> Column:
    return (score >= F.lit(ACCEPT)).cast("int")
