"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts, with exception phrases.

Texts and lexicon are folded alike: compatibility forms, lower case, look-alike letters of other scripts, digits and
signs that stand for letters, invisible characters dropped, everything else one space. Letters that one sign may stand
for (i, l, 1, |) fold to one. The lexicon holds whole words and word beginnings; its weights are log-odds from labelled
rows outside the held-out fold (a bounded sample, ``train_rows``, default 12,000, whose words are counted by Spark), to
which callers can add entries. A match inside an exception phrase doesn't count. The sum of weights, and that sum per
word, give a score by a logistic curve fitted on the same sample.

Defined cases: null and empty texts match nothing and get the score of a text without matches; without labelled rows
only added entries match; long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.learning import labelled_texts

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = {"а": "a", "ѕ": "s", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
               "р": "p", "ԛ": "q", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "в": "b", "н": "h", "α": "a", "β": "b", "ε": "e",
               "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
               "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴢ": "z"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
SAME = {"l": "i"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash collection", "class clown fish", "clown fish", "pond scum")
_SIGN_IN_WORD = re.compile(r"[@$!|](?=\w)")
_PREFIX_LENGTHS = (4, 5, 6, 7)


class _Fold(dict):
    """A translation table that is filled as characters turn up."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point)
        if char in INVISIBLE or unicodedata.category(char) == "Mn":
            out = None
        else:
            char = LOOK_ALIKES.get(char, DIGITS.get(char, char))
            out = SAME.get(char, char) if char.isalnum() else " "
        self[point] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """The folded text: words of letters between single characters of space."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    if any(sign in text for sign in SIGNS):
        text = _SIGN_IN_WORD.sub(lambda m: SIGNS[m.group()], text)
    return f" {text.translate(_FOLD)} "


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.0)
    _machine: object = field(default=None, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        """The automaton, built once in each worker."""
        if self._machine is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for pattern, weight in [*((f" {w} ", v) for w, v in self.words.items()), *((f" {b}", v) for b, v in self.beginnings.items())]:
                found.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                pattern = f" {' '.join(folded(phrase).split())} "
                found.add_word(pattern, (len(pattern), None))
            if len(found):
                found.make_automaton()
            self._machine = found
        return self._machine

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, matches, words) of a text."""
        plain = folded(text)
        machine = self.machine()
        if not len(machine):
            return 0.0, 0, len(plain.split())
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(plain):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        if spared and hits:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        return sum(hits.values()), len(hits), len(plain.split()) if hits else 0

    def score(self, text: str | None) -> tuple[float, int]:
        total, hits, words = self.measure(text)
        return float(1 / (1 + np.exp(-np.clip(np.array(self.curve) @ curve_inputs(total, words), -30, 30)))), hits


def curve_inputs(total: float, words: int) -> np.ndarray:
    return np.array([1.0, np.log1p(total), np.log1p(100 * total / max(1, words))])


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, int(y)) for t, y in zip(batch["text"], batch["label"]) for w in set(folded(t).split())]
        for at in range(0, max(1, len(rows)), 200_000):
            yield pd.DataFrame(rows[at:at + 200_000], columns=["word", "label"])


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))


def choose_beginnings(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of qualifying beginnings (count, weight), the shortest, lengthened while all its words go on alike."""
    chosen = {}
    children = defaultdict(list)
    for b in found:
        children[b[:-1]].append(b)
    for b in sorted(found, key=len):
        if any(b[:n] in found for n in range(1, len(b))):
            continue
        while (c := [x for x in children[b] if found[x][0] == found[b][0]]) and len(children[b]) == 1:
            b = c[0]
        chosen[b] = found[b][1]
    return chosen


def learn_words(sample: DataFrame, n_toxic: int, n_clean: int, least_odds: float = 3.0, support: int = 5, entries: int = 5000) -> Lexicon:
    """Whole words and beginnings by log-odds. At most ``entries`` of each, the heaviest, come to the driver."""
    words = (sample.mapInPandas(_words, "word string, label int").groupBy("word")
             .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")))
    odds = _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    top = [F.col("weight").desc(), F.col("toxic").desc()]
    own = words.withColumn("weight", odds).where((F.col("toxic") >= support) & (F.col("weight") >= least_odds)).orderBy(*top, "word").limit(entries)
    lengths = F.array(*[F.lit(n) for n in _PREFIX_LENGTHS])
    begun = (words.select("word", "toxic", "clean", F.explode(F.filter(lengths, lambda n: n < F.length("word"))).alias("n"))
             .groupBy(F.expr("substring(word, 1, n)").alias("start"))
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum((F.col("toxic") > 0).cast("int")).alias("kinds"))
             .withColumn("weight", odds).where((F.col("toxic") >= support) & (F.col("kinds") >= 4) & (F.col("weight") >= least_odds))
             .orderBy(*top, "start").limit(entries))
    beginnings = choose_beginnings({r["start"]: (r["toxic"], r["weight"]) for r in begun.collect()})
    whole = {r["word"]: r["weight"] for r in own.collect() if not any(r["word"].startswith(b) for b in beginnings)}
    return Lexicon(whole, beginnings)


def fit_curve(inputs: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    weights = np.zeros(inputs.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (labels - p) - ridge * weights
        curvature = (inputs * (p * (1 - p))[:, None]).T @ inputs + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(curvature, slope)
    return weights


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = 12_000, added: dict[str, float] | None = None) -> Lexicon:
    sample = labelled_texts(docs, labels, label, train_rows)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_words(sample, counts.get(1, 0), counts.get(0, 0)) if counts.get(1) and counts.get(0) else Lexicon()
    lexicon.words |= {" ".join(folded(w).split()): v for w, v in (added or {}).items()}
    if counts.get(1) and counts.get(0):
        shared = lexicon

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [shared.measure(t) for t in batch["text"]]
                yield pd.DataFrame({"total": [r[0] for r in rows], "words": [r[2] for r in rows], "label": batch["label"]})

        rows = sorted(sample.mapInPandas(measured, "total double, words long, label int").collect())
        lexicon.curve = tuple(fit_curve(np.array([curve_inputs(r[0], r[1]) for r in rows]), np.array([r[2] for r in rows], dtype=float)))
    return lexicon


def scored(lexicon: Lexicon) -> Column:
    """struct(score, hits) of column ``text``."""
    shared = lexicon

    @F.pandas_udf("score double, hits long")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.score(t) for t in texts], columns=["score", "hits"])

    return score(F.col("text"))
