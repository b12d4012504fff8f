"""Language ID by the nearest of several centroids per language.

A text becomes a TF-IDF vector of hashed character n-grams (1 to 3, letters only, one space between words), scaled to
length 1. Each language has up to ``CENTROIDS`` centroids, found by spherical k-means over a bounded sample of labelled
texts (``train_rows`` per language, default 400, of the ``languages`` most frequent ones, default 200, outside the held-out fold). The prediction is the language of the
centroid with the largest cosine; the score is that cosine. A text further from its centroid than nearly all training
texts were is marked as rejected, and ``reject_as`` can replace its prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned;
ties go to the language that sorts first; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.learning import texts_per_value

PLACES = 4096
CENTROIDS = 3
UNKNOWN = "und"
_STEP = 1 << 20  # code points handled at once
_LETTER = np.zeros(128, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MIX = [np.uint32(m) for m in (2654435761, 2246822519, 3266489917)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of one to three characters occurs."""
    counts = np.zeros(PLACES, dtype=np.int64)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(points), _STEP):
        part = points[max(0, at - 2):at + _STEP]
        letters = np.where((part >= 128) | _LETTER[np.minimum(part, 127)], part, np.uint32(32))
        kept = letters[~((letters == 32) & (np.concatenate(([0], letters[:-1])) == 32))]
        if len(kept) < 3:
            continue
        one = kept * _MIX[0]
        two = (one[:-1] ^ (kept[1:] * _MIX[1])) * _MIX[2]
        three = (two[:-1] ^ (kept[2:] * _MIX[1])) * _MIX[0]
        for hashed in (one, two, three):
            counts += np.bincount(hashed >> np.uint32(20), minlength=PLACES)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    norm = np.linalg.norm(weights)
    return weights / norm if norm else weights


@dataclass
class Centroids:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centres: np.ndarray
    nearest_seen: dict[str, float]  # cosine that all but 1 % of the training texts of a language reach

    def predict(self, text: str | None, reject_as: str | None = None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        cosines = self.centres @ vector(gram_counts(text), self.idf)
        best = int(np.argmax(cosines))
        language, cosine = self.languages[best], float(np.clip(cosines[best], 0, 1))
        rejected = cosine < self.nearest_seen[language]
        return (reject_as if rejected and reject_as is not None else language), cosine, rejected


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest texts, so it has no random part."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[int(np.argmin(np.max(vectors @ np.array(centres).T, axis=1)))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        moved = [vectors[own == c].mean(axis=0) for c in range(len(centres)) if (own == c).any()]
        centres = np.array([m / max(np.linalg.norm(m), 1e-12) for m in moved])
    return centres


def fit_centroids(languages: list[str], counts: np.ndarray, k: int = CENTROIDS) -> Centroids:
    if not languages:
        return Centroids(np.ones(PLACES), [], np.zeros((0, PLACES)), {})
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors = np.array([vector(c, idf) for c in counts])
    names = np.array(languages)
    own, centres, near = [], [], {}
    for language in sorted(set(languages)):
        found = cluster(vectors[names == language], k)
        own += [language] * len(found)
        centres.append(found)
        near[language] = float(np.quantile(np.max(vectors[names == language] @ found.T, axis=1), 0.01))
    return Centroids(idf, own, np.concatenate(centres), near)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["value"],
                            "counts": [gram_counts(t).astype(np.uint32).tobytes() for t in batch["text"]]})


def train(docs: DataFrame, train_rows: int = 400, languages: int = 200) -> Centroids:
    """Learn from at most ``train_rows`` texts of each of the ``languages`` most frequent languages."""
    sample = texts_per_value(docs, "lang", train_rows, languages).mapInPandas(_count_rows, "doc_id long, lang string, counts binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["lang"], r["counts"]))
    rows = [r for r in rows if any(r["counts"])]
    return fit_centroids([r["lang"] for r in rows], np.array([np.frombuffer(r["counts"], np.uint32) for r in rows]))


def predicted(model: Centroids, reject_as: str | None = None) -> Column:
    """struct(lang_pred, score, rejected) of column ``text``."""
    shared = model

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.predict(t, reject_as) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(F.col("text"))
