"""Tokenizing by units: stretches of a text that a tokenizer encodes alike alone and in place.

Prose repeats its words, so a task encodes each distinct unit once and looks the others up. A unit may stand alone only
where the tokenizer's own definition says so, which is read from its file; otherwise a whole text is one unit. Tests
compare with whole texts encoded at once.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

# A single blank between two characters that no library takes for white space or a control character.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0\u180e\u200b-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
SINGLE_BLANK = re.compile(rf"(?<={_SOLID}) (?={_SOLID})")
CACHED_CHARS = 3_000_000  # of units that a task remembers; it starts anew when they are more
LONGEST_CACHED = 64  # characters; longer units are encoded each time
LEARNED_AT_ONCE = 4_096  # units that are with a library at a time, as its results are large


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordModel:
    """Ids of a word of Latin letters, straight from a library's model.

    No normalizer but lower-casing changes such a word and no splitter cuts it, so only the model is left to run: a third of
    the time.
    """

    WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, tok, lower: bool):
        self.model, self.lower = tok.model, lower
        self.letters = {b: c for c, b in byte_letters().items()}

    def written(self, word: str) -> str:
        word = word.lower() if self.lower else word
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]


def drops_blanks(path: str) -> bool:
    """Whether what ASCII blanks leave stands alone in a tokenizers file: its splitter keeps runs of letters and of signs, never blanks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", " ")
    steps = {"NFC", "Lowercase", "Replace"}  # none of them looks across a blank
    normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    names = {n["type"] for n in normalizer.get("normalizers", [normalizer])}
    rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
    plain = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"]
    kept = plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    by_class = r"\p{L}]+|" in pattern and r"[^\s\p{L}\p{N}]+" in pattern and " " not in pattern and "(?" not in pattern
    return kept and by_class and names <= steps and "Lowercase" in names and not any(re.search(r"\s|^[^<]", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


def starts_at_blanks(path: str) -> bool:
    """Whether a single blank always starts a token of a tokenizers file: byte-level splitting by its usual pattern, no normalizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") is True


class _Places(dict):
    """Unit to place; an unknown unit gets the next place and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh, self.next = [], 0

    def __missing__(self, unit: str) -> int:
        self[unit] = place = self.next
        self.next += 1
        self.fresh.append(unit)
        return place


class UnitTable:
    """Places of units in a table that ``learn`` extends by a list of new units; ``reset`` empties it when it is full."""

    def __init__(self, learn, reset, most: int | None = None):
        self.learn, self.reset, self.known, self.chars = learn, reset, _Places(), 0
        self.most = CACHED_CHARS if most is None else most

    def places(self, units: pa.Array) -> np.ndarray:
        """The place of each of ``units``, which Arrow makes distinct before Python sees them."""
        coded = units.dictionary_encode()
        return self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def _places(self, units: list[str]) -> np.ndarray:
        if self.chars > self.most:
            self.known, self.chars = _Places(), 0
            self.reset()
        places = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            for k in range(0, len(fresh), LEARNED_AT_ONCE):
                self.learn(fresh[k:k + LEARNED_AT_ONCE])
            for u in fresh:
                self.chars += len(u)
                if len(u) > LONGEST_CACHED:
                    del self.known[u]
        return places


def slices(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    """Consecutive rows of a batch that hold about ``most`` bytes in a text column, or one row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(sizes // most, prepend=0) > 0) + 1
    edges = [0, *[int(c) for c in cuts if c < batch.num_rows], batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def per_process(key: tuple, make):
    """One object for all tasks of a Python worker, which Spark uses again: what one task has learned, the next one knows."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("_vigil_per_process", ModuleType("_vigil_per_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each stretch, one stretch after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, dtype):
        self.buffer, self.size = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.buffer):
            grown = np.empty(max(need, 2 * len(self.buffer)), self.buffer.dtype)
            grown[:self.size] = self.buffer[:self.size]
            self.buffer = grown
        self.buffer[self.size:need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.buffer[:self.size]


class IdEncoder:
    """Token ids of texts by one tokenizers file, special strings as the library takes them by default.

    Units are what ASCII blanks leave. Those of a word with signs around it are cut into three by Arrow, and words are
    lower-cased there, so that Python and the library see each distinct word and run of signs once.
    """

    _WORDY = r'^(?P<a>[("]*)(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<s>[,.;:!?)"%$#*&]*)$'
    _PLAIN = re.compile(WordModel.WORD.pattern + r'|[("]*|[,.;:!?)"%$#*&]*')

    def __init__(self, path: str, by_unit: bool = True, remembered: int = 2 * CACHED_CHARS):
        self.tok, self.by_unit = tokenizer(path), by_unit and drops_blanks(path)
        self.words = WordModel(self.tok, lower=True) if self.by_unit else None
        self.vocabulary = self.tok.get_vocab_size()
        self._reset()
        self.table = UnitTable(self._learn, self._reset, remembered)

    def _reset(self) -> None:
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def _learn(self, units: list[str]) -> None:
        ids: list[list[int] | None] = [None] * len(units)
        if self.words:
            plain, words = self._PLAIN.fullmatch, self.words
            ids = [words.ids(words.written(u)) if plain(u) else None for u in units]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.tok.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)):
            ids[k] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts.extend(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each); no text is null."""
        if self.by_unit:
            places, counts = self._cut(texts)
        else:
            places, counts = self.table.places(texts), np.ones(len(texts), np.int64)
        lengths = self.lengths.values[places]
        ids = self.ids.values[gathered(self.starts.values[places], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places of all pieces in order, number of pieces of each text): three a unit, those that are missing are empty strings."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        units = split.flatten().dictionary_encode()
        distinct = units.dictionary
        parts = pc.extract_regex(distinct, self._WORDY)
        whole = pc.is_null(parts)
        empty = pa.scalar("", pa.string())
        part = lambda name: pc.fill_null(pc.struct_field(parts, name), empty)
        middle = pc.if_else(whole, distinct, pc.utf8_lower(part("w")))
        pieces = pa.concat_arrays([x.cast(pa.string()) for x in (part("a"), middle, part("s"))])
        places = self.table.places(pieces).reshape(3, -1).T  # a row per distinct unit
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        return places[units.indices.to_numpy()].ravel(), 3 * counts
