"""Secret scans: base patterns, and formats inferred from labelled credentials.

Base spans come from three fixed patterns. Their distinct matches in all documents are the labelled credentials, and the
formats are inferred from all of them, of any number and length. From the credentials of a kind a prefix tree is built and
its statistically compatible states are merged (Hoeffding bounds on symbol and end frequencies, red-blue order), which
gives a probabilistic automaton; twice, over characters and over the sorts of characters that the kind mixes. This runs in
one process, which holds each distinct credential once: what follows a state that too few arrived at to tell it from any
other stays a string. Every candidate of every whole text (a run of 8 or more ``CANDIDATE`` characters, the least length
and the alphabet of an assigned credential, words included) is scored by each automaton's log-likelihood per character
less that of a background model, whose pairs of characters are counted over all distinct ordinary candidates where they
lie; one that reaches the score that nearly all labelled credentials of the kind reach, and overlaps no base span, is
added as a ``format`` span. A run with dots is read whole, then without outer dots, then by its parts of 8 or
more characters between dots. Base spans always stay.

Defined cases: null and empty texts have no spans; long texts are scanned whole; without labelled credentials only base
spans are found; spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "format")
# The base patterns, the group whose length counts and its least length.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_LEAST = 8
# a maximal run that is too short is dropped, so asking for long runs finds the same ones
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PART = re.compile(r"[^.]{8,}")
_ALPHABET = 69  # symbols of a candidate, and its end
_UNSEEN = math.log(1e-6)
_LEAST_APART = 50  # credentials of a kind from which on a fifth sets the score to reach and isn't learned from

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def credentials(text: str) -> list[tuple[int, str]]:
    """(kind, credential) of each base span; an assignment's credential is what is assigned."""
    return [(kind, _ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]) for start, kind, end in base_spans(text)]


def candidates(text: str, spans: list[Span]) -> list[list[tuple[int, str]]]:
    """Readings (start, run) of each candidate outside ``spans``: the whole run, the run without outer dots, its parts."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, run = m.start(), m.group()
        readings = [(start, run)]
        if "." in run:
            inner = run.strip(".")
            readings += [(start + run.find(inner), inner)] if _ASSIGN_LEAST <= len(inner) < len(run) else []
            if "." in inner:
                readings += [(start + p.start(), p.group()) for p in _PART.finditer(run)]
        if spans:
            readings = [(at, r) for at, r in readings if not any(s < at + len(r) and at < e for s, _, e in spans)]
        if readings:
            found.append(readings)
    return found


# --------------------------------------------------------------------------------- grammar inference
@dataclass(slots=True)
class _State:
    arrived: int = 0
    ended: int = 0
    to: dict[str, list[int]] = field(default_factory=dict)  # symbol: [state, count]
    rest: list[tuple[str, int]] | None = None  # strings that arrived and where each goes on, until the state is opened


def _opened(states: list[_State], i: int) -> _State:
    """The state with what follows it: one state a symbol, itself not opened."""
    at = states[i]
    if at.rest is not None:
        rest, at.rest = at.rest, None
        for s, k in rest:
            if k == len(s):
                at.ended += 1
                continue
            step = at.to.get(s[k])
            if step is None:
                step = at.to[s[k]] = [len(states), 0]
                states.append(_State(rest=[]))
            step[1] += 1
            below = states[step[0]]
            below.arrived += 1
            below.rest.append((s, k + 1))
    return at


def prefix_tree(strings: list[str], telling: int = 0) -> list[_State]:
    """Opened as far as more than ``telling`` strings arrive."""
    states = [_State(arrived=len(strings), rest=[(s, 0) for s in strings])]
    stack = [0]
    while stack:
        i = stack.pop()
        if states[i].arrived > telling:
            stack += [below for below, _ in _opened(states, i).to.values()]
    return states


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _telling(alpha: float) -> int:
    """States at which no more strings arrive differ from no state."""
    return int(0.5 * math.log(2 / alpha))


def compatible(states: list[_State], red: int, blue: int, alpha: float) -> bool:
    """Whether two states, and all states that the same symbols lead to, have like frequencies. ``blue`` has a tree below it,
    where fewer and fewer strings arrive, so that the walk ends where they are too few to tell."""
    stack, few = [(red, blue)], _telling(alpha)
    while stack:
        i, j = stack.pop()
        if states[j].arrived <= few:
            continue
        r, b = _opened(states, i), _opened(states, j)
        if _differ(r.ended, r.arrived, b.ended, b.arrived, alpha):
            return False
        for c in r.to.keys() | b.to.keys():
            if _differ(r.to.get(c, (0, 0))[1], r.arrived, b.to.get(c, (0, 0))[1], b.arrived, alpha):
                return False
            if c in r.to and c in b.to:
                stack.append((r.to[c][0], b.to[c][0]))
    return True


def _walk(states: list[_State], i: int, s: str, k: int) -> int | None:
    """Lead a string from its place ``k`` on through the automaton at ``i``; the state that goes on by a symbol it had not."""
    while True:
        at = states[i]
        at.arrived += 1
        if at.rest is not None:
            at.rest.append((s, k))
            return None
        if k == len(s):
            at.ended += 1
            return None
        step = at.to.get(s[k])
        if step is None:
            at.to[s[k]] = [len(states), 1]
            states.append(_State(1, rest=[(s, k + 1)]))
            return i
        step[1] += 1
        i, k = step[0], k + 1


def _fold(states: list[_State], red: int, blue: int) -> set[int]:
    """Add the tree below ``blue`` to the automaton at ``red``; the states that go on by a symbol they had not."""
    stack, grown = [(red, blue)], set()
    while stack:
        i, j = stack.pop()
        b, states[j] = states[j], None
        if b.rest is not None:
            grown.update([_walk(states, i, s, k) for s, k in b.rest])
            continue
        r = _opened(states, i)
        r.arrived += b.arrived
        r.ended += b.ended
        for c, (below, n) in b.to.items():
            if c in r.to:
                r.to[c][1] += n
                stack.append((r.to[c][0], below))
            else:
                r.to[c] = [below, n]
                grown.add(i)
    return grown


# Sorts of characters that random tokens draw from together; a sign is a sort of its own.
_SORTS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")


def symbols(strings: list[str]) -> dict[str, str]:
    """The symbol of each character: sorts that most of the strings with the one also have of the other are one symbol.

    A random token draws from its whole alphabet everywhere, so a tree of characters has a leaf for each token and nothing
    to compare; over symbols, tokens of a format share their path and lengths and fixed signs become states.
    """
    sorts = [set(x) for x in _SORTS] + [{c} for c in sorted(set("".join(strings)) - set("".join(_SORTS)))]
    held = [{i for i, s in enumerate(strings) if not x.isdisjoint(s)} for x in sorts]
    name = list(range(len(sorts)))
    for i in range(len(_SORTS)):
        for j in range(i):
            both = len(held[i] & held[j])
            if both > 0.5 * max(len(held[i]), 1) and both > 0.5 * max(len(held[j]), 1):
                name = [name[j] if n == name[i] else n for n in name]
    return {c: chr(0x61 + n) for n, x in zip(name, sorts) for c in x}


@dataclass
class Automaton:
    """log-probabilities: steps[state][symbol] = (next state, log p), ends[state] = log p, letters[character] = log p in its symbol."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    symbol: dict[str, str]
    letters: dict[str, float]

    def likelihood(self, s: str) -> float:
        """Mean log-likelihood per character, the end included."""
        total, state, symbol, letters = 0.0, 0, self.symbol, self.letters
        for c in s:
            step = self.steps[state].get(symbol.get(c))
            if step is None:
                return _UNSEEN
            state = step[0]
            total += step[1] + letters[c]
        return (total + self.ends[state]) / (len(s) + 1)


def _letters(strings: list[str], symbol: dict[str, str]) -> dict[str, float]:
    """Each character's share of its symbol, add-one; of a symbol of one character all."""
    counts = Counter({c: 1 for c in symbol})
    for s in strings:
        counts.update(s)
    totals = Counter()
    for c, n in counts.items():
        totals[symbol[c]] += n
    return {c: math.log(n / totals[symbol[c]]) for c, n in counts.items()}


def infer(strings: list[str], alpha: float = 0.01, by_symbol: bool = False) -> Automaton:
    """Merge compatible states of the prefix tree: each blue state into the first compatible red one, or it turns red.

    Over characters this gives an automaton of any length that the credentials' letters allow, over symbols one of their
    lengths and signs.
    """
    symbol = symbols(strings) if by_symbol else {c: c for s in strings for c in s}
    states = prefix_tree(sorted("".join([symbol[c] for c in s]) for s in strings), len(strings))
    number = {0: 0}  # red states in the order in which they turned red
    queue = deque((0, c) for c in sorted(_opened(states, 0).to))
    known = set(queue)
    while queue:
        parent, c = queue.popleft()
        known.discard((parent, c))
        blue = states[parent].to[c][0]
        if blue in number:
            continue
        match = next((r for r in number if compatible(states, r, blue, alpha)), None)
        if match is None:
            number[blue] = len(number)
            grown = {blue}
        else:
            states[parent].to[c][0] = match
            grown = _fold(states, match, blue) & number.keys()
        new = [(r, x) for r in sorted(grown, key=number.get) for x in sorted(_opened(states, r).to) if states[r].to[x][0] not in number and (r, x) not in known]
        queue += new
        known.update(new)
    steps, ends = [], []
    for s in number:
        n = max(1, states[s].arrived)
        steps.append({c: (number[to], math.log(k / n)) for c, (to, k) in states[s].to.items()})
        ends.append(math.log(states[s].ended / n) if states[s].ended else _UNSEEN)
    return Automaton(steps, ends, symbol, _letters(strings, symbol))


@dataclass
class Formats:
    automata: dict[int, Automaton] = field(default_factory=dict)  # by kind, over characters
    least: dict[int, float] = field(default_factory=dict)
    narrow: dict[int, Automaton] = field(default_factory=dict)  # by kind, over symbols
    least_narrow: dict[int, float] = field(default_factory=dict)
    background: dict[str, float] = field(default_factory=dict)  # log-probability of a pair of characters
    unpaired: dict[str, float] = field(default_factory=dict)  # of a pair not met, by its first character

    def ordinary(self, s: str) -> float:
        known, total = self.background, 0.0
        for a, b in zip("^" + s, s + "$"):
            p = known.get(a + b)
            total += self.unpaired.get(a, -math.log(_ALPHABET)) if p is None else p
        return total / (len(s) + 1)

    def gain(self, automaton: Automaton, s: str) -> float:
        return automaton.likelihood(s) - self.ordinary(s)

    def fits(self, s: str) -> bool:
        likely = [(p, least[k]) for automata, least in ((self.automata, self.least), (self.narrow, self.least_narrow))
                  for k, a in automata.items() if (p := a.likelihood(s)) > _UNSEEN]
        if not likely:
            return False
        ordinary = self.ordinary(s)
        return any(p - ordinary >= needed for p, needed in likely)

    def found(self, readings: list[tuple[int, str]]) -> list[Span]:
        """The first reading that fits; parts count one by one."""
        spans: list[Span] = []
        for start, run in readings:
            if not (spans and start < spans[-1][2]) and self.fits(run):
                spans.append((start, 3, start + len(run)))
        return spans

    def spans(self, text: str | None) -> list[Span]:
        text = text or ""
        base = base_spans(text)
        return sorted(base + [span for readings in candidates(text, base) for span in self.found(readings)] if self.automata else base)


def _reached(gains: list[float], quantile: float) -> float:
    """The gain that all but ``quantile`` of the credentials reach, at least none."""
    return max(0.0, sorted(gains)[int(quantile * len(gains))])


def _pairs(strings: Iterable[str]) -> Counter:
    """Pairs of neighbouring characters, start and end included."""
    pairs = Counter()
    for s in strings:
        pairs.update([a + b for a, b in zip("^" + s, s + "$")])
    return pairs


def fit_formats(labelled: list[tuple[int, str]], ordinary: list[str], quantile: float = 0.05) -> Formats:
    """Automata of the labelled credentials (kind, credential), and of ordinary candidates the background (add-one pairs)."""
    return _fit(labelled, _pairs(ordinary), quantile)


def _fit(labelled: list[tuple[int, str]], pairs: Counter, quantile: float = 0.05) -> Formats:
    firsts = Counter()
    for p, n in pairs.items():
        firsts[p[0]] += n
    out = Formats(background={p: math.log((n + 1) / (firsts[p[0]] + _ALPHABET)) for p, n in pairs.items()},
                  unpaired={c: -math.log(n + _ALPHABET) for c, n in firsts.items()})
    for kind in sorted({k for k, _ in labelled}):
        strings = sorted({s for k, s in labelled if k == kind})
        out.automata[kind] = infer(strings)
        out.least[kind] = _reached([out.gain(out.automata[kind], s) for s in strings], quantile)
        # the narrow automaton is held to credentials that it has not seen, where there are enough of them
        apart = {s for i, s in enumerate(sorted(strings, key=_place)) if i % 5 == 0} if len(strings) >= _LEAST_APART else set()
        out.narrow[kind] = infer([s for s in strings if s not in apart], by_symbol=True)
        out.least_narrow[kind] = _reached([out.gain(out.narrow[kind], s) for s in apart or strings], quantile)
    return out


def _place(value: str) -> tuple[bytes, str]:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), value


class _First:
    """The ``size`` distinct values that come first by a hash."""

    def __init__(self, size: int):
        self.size, self.kept, self.last = size, set(), None

    def add(self, values: set[str]) -> None:
        self.kept |= {p for p in map(_place, values) if self.last is None or p < self.last}
        if len(self.kept) > 2 * self.size:
            self.cut()

    def cut(self) -> list[tuple[bytes, str]]:
        first = sorted(self.kept)[:self.size]
        self.kept = set(first)
        if len(first) == self.size and first:
            self.last = first[-1]
        return first


def first_labelled(per_kind: int, longest: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of a task's texts the first ``per_kind`` credentials of each kind, and the first ordinary candidates (kind -1).

    What is first among all texts is first in its task, so no credential is missed and a task returns few rows.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = {kind: _First(per_kind) for kind in range(-1, len(KINDS) - 1)}
        for batch in batches:
            met: dict[int, set[str]] = {kind: set() for kind in first}
            for text in batch["text"]:
                for kind, value in credentials(text):
                    met[kind].add(value)
                met[-1].update(readings[0][1] for readings in candidates(text, base_spans(text)))
            for kind, values in met.items():
                first[kind].add({v for v in values if len(v) <= longest})
        yield pd.DataFrame([(kind, place, value) for kind, f in first.items() for place, value in f.cut()], columns=["kind", "place", "value"])

    return rows


def every_labelled(longest: int | None, held: int = 200_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The credentials of a task's texts (kind, value) and their ordinary candidates (kind -1); a value repeats only after ``held`` others."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[tuple[int, str]] = set()
        taken = lambda: pd.DataFrame([m for m in met if longest is None or len(m[1]) <= longest], columns=["kind", "value"])
        for batch in batches:
            for text in batch["text"]:
                met.update(credentials(text))
                met.update([(-1, readings[0][1]) for readings in candidates(text, base_spans(text))])
                if len(met) > held:
                    yield taken()
                    met.clear()
        yield taken()

    return rows


def labelled(docs: DataFrame, per_kind: int | None = 2_000, longest: int | None = 1_024) -> DataFrame:
    """(kind, value) of the credentials of all documents, ordinary candidates as kind -1, every value once.

    The parameters keep the first values of a kind by a hash, and values up to a length; None keeps all.
    """
    texts = docs.where("text IS NOT NULL").select("text")
    if per_kind is None:
        return texts.mapInPandas(every_labelled(longest), "kind int, value string").distinct()
    values = texts.mapInPandas(first_labelled(per_kind, math.inf if longest is None else longest), "kind int, place binary, value string").distinct()
    order = Window.partitionBy("kind").orderBy("place", "value")  # the rank filter cuts each task's rows first
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind).orderBy("kind", "rank").select("kind", "value")


def _learned_from(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Credentials as they are, and a task's ordinary candidates as counts of their pairs."""
    pairs = Counter()
    for batch in batches:
        ordinary = batch["kind"] < 0
        pairs += _pairs(batch.loc[ordinary, "value"])
        yield batch[~ordinary].assign(n=1)
    yield pd.DataFrame([(-1, p, n) for p, n in pairs.items()], columns=["kind", "value", "n"])


def train(docs: DataFrame, per_kind: int | None = None, longest: int | None = None) -> Formats:
    """Formats from the credentials of all documents. The distinct credentials are collected, and a few thousand counts a task."""
    rows = labelled(docs, per_kind, longest).mapInPandas(_learned_from, "kind int, value string, n long").collect()
    pairs = Counter()
    for r in rows:
        if r["kind"] < 0:
            pairs[r["value"]] += r["n"]
    return _fit([(r["kind"], r["value"]) for r in rows if r["kind"] >= 0], pairs)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(formats: Formats) -> Column:
    """struct(n_assign, n_access, n_hex, n_format, base_sha256, spans) of column ``text``."""
    shared = formats
    names = ["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = shared.spans(text)
            kinds = Counter(k for _, k, _ in spans)
            base = joined([s for s in spans if s[1] < 3])
            rows.append((kinds[0], kinds[1], kinds[2], kinds[3], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=names)

    return scan(F.col("text"))
