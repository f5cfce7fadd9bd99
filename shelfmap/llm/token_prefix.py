"""Token counts at every prefix of a text by prefix dynamic programming.

The operator stores, per code point of the text, by how much the token count changes when
a prefix grows by it.  Running sums answer every truncation and budget question without
encoding again: ``count_at`` (tokens of a prefix), ``longest_within`` (longest prefix
within a budget), ``windows`` (cuts of a text into parts within a budget).

Counts equal the tokenizers library's for the text up to that point, encoded by itself
without added tokens, special strings in the text handled as its default does.  White
space separates words in this vocabulary, so counts of the parts between ASCII white
space add up; within a word, the last token of every prefix follows from shorter
prefixes (``bpe_paths``), and one more step ends the word there.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_paths import END, PairRules, WordTable
from .common import UNICODE_SPACE, TwoGenerations, free_name, kept, per_text, short_batches

TOKENIZER = "word_bpe_49k.json"
CACHE_PARTS = 300_000
CACHED_CHARS = 64

_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{UNICODE_SPACE}\p{{L}}\p{{N}}]+")

# The same for texts in lower case, with the white space between words as matches of its own.
_WORD_OR_GAP = regex.compile(rf"{_WORD.pattern}|[{UNICODE_SPACE}]+")
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r 0-9a-z]+|[\t-\r ]+")
_SPACE_AT = regex.compile(rf"[{UNICODE_SPACE}]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _octets(word: str) -> str:
    """The word's bytes in UTF-8, as byte-level letters."""
    if word.isascii() and word.isprintable():
        return word
    return "".join([_LETTERS[b] for b in word.encode("utf-8", "replace")])


def _cuts(word: str) -> list[int]:
    """Bytes of each prefix that ends at a code point."""
    return list(accumulate(len(c.encode("utf-8", "replace")) for c in word))


def _blanked(text: str) -> str:
    """Every ASCII white space character as a space."""
    for c in "\n\t\r\x0b\x0c":
        text = text.replace(c, " ")
    return text


def _lower(text: str) -> str:
    """Lower case of each code point by itself, as the tokenizer's normaliser does."""
    return text.lower() if text.isascii() else "".join([c.lower() for c in text])


class PrefixCounter:
    """Changes of the token count per code point of whole texts, distinct words counted once while cached."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = PairRules(set(model["vocab"]), by_pair={m: i for i, m in enumerate(merges)}, end=END)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.table = WordTable(self.rules)
        self.parts = TwoGenerations(CACHE_PARTS)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Signed changes of the count per code point of each lower-cased word, found together."""
        coded = {w: _octets(w) for w in words}
        found = self.table.closed_steps(list(set(coded.values())))
        out = {}
        for w, text in coded.items():
            steps = found.get(text)
            if steps is not None and len(text) == len(w) and w[0] != "'":
                out[w] = steps
                continue
            if steps is None:                                           # a long word
                counts = self.rules.closed(text, _cuts(w))
            else:
                counts = list(accumulate(memoryview(steps).cast("b")))
                if len(text) > len(w):
                    counts = [counts[k - 1] for k in _cuts(w)]
            if len(w) == 3 and w[0] == "'" and w[1].isalpha():          # cut after two: quote and letter part
                counts = [1, self._last("'") + self._last(w[1]), counts[-1]]
            steps = [b - a for a, b in zip([0, *counts], counts)]
            narrow = min(steps) >= -128 and max(steps) <= 127
            out[w] = bytes([s & 255 for s in steps]) if narrow else np.array(steps, dtype=np.int64)
        return out

    def _last(self, word: str) -> int:
        return self.rules.closed(_octets(word), _cuts(word))[-1]

    def _word(self, word: str) -> list[int]:
        """Token counts of each non-empty prefix of one pre-token."""
        steps = self.learn([word])[word]
        return (np.frombuffer(steps, dtype=np.int8) if isinstance(steps, bytes) else steps).cumsum(dtype=np.int64).tolist()

    def _plain(self, text: str) -> list[int]:
        """Counts at each prefix of an already normalised text without special strings."""
        counts, base, at = [], 0, 0
        for m in _WORD.finditer(text):
            counts.extend([base] * (m.start() - at))
            counts.extend([base + c for c in self._word(m.group())])
            base, at = counts[-1], m.end()
        counts.extend([base] * (len(text) - at))
        return counts

    def _ordinary(self, text: str) -> list[int]:
        """Counts at each prefix of a text without special strings."""
        if text.isascii():
            return self._plain(text.lower())
        low = _lower(text)
        if len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            return self._plain(low)
        # Normalising moves positions: compare each prefix's normal form with the whole text's.
        norm = _lower(unicodedata.normalize("NFC", text))
        whole = [0, *self._plain(norm)]
        starts = [m.start() for m in _WORD.finditer(norm)]
        counts, safe, done = [], 0, 0           # nothing combines across a point before an ASCII character
        for k in range(1, len(text) + 1):
            if text[k - 1].isascii():
                done += len(_lower(unicodedata.normalize("NFC", text[safe:k - 1])))
                safe = k - 1
            tail = _lower(unicodedata.normalize("NFC", text[safe:k]))
            if norm.startswith(tail, done):
                counts.append(whole[done + len(tail)])
                continue
            first = starts[max(np.searchsorted(starts, done, side="left") - 1, 0)] if starts else 0
            first = min(first, done)
            rest = self._plain(norm[first:done] + tail)
            counts.append(whole[first] + (rest[-1] if rest else 0))
        return counts

    def _part(self, part: str) -> list[int]:
        """Counts at each prefix of a part without ASCII white space."""
        if self.special is None or "<" not in part:
            return self._ordinary(part)
        counts, base, at = [], 0, 0
        for m in self.special.finditer(part):
            ahead = self._ordinary(part[at:m.end() - 1])     # an unfinished special string is ordinary text
            counts.extend([base + c for c in ahead])
            base += (ahead[m.start() - at - 1] if m.start() > at else 0) + 1
            counts.append(base)
            at = m.end()
        counts.extend([base + c for c in self._ordinary(part[at:])])
        return counts

    def _words(self, text: str) -> list[str] | None:
        """The words of a text and the white space between, lower-cased; None where a character's lower case,
        normal form or a special string needs a closer look."""
        if "<" in text and self.special is not None and self.special.search(text):
            return None
        low = text.lower()
        if text.isascii():
            return _ASCII_WORD.findall(low)
        if len(low) != len(text) or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):   # capital sigma: lower case by place
            return None
        return _WORD_OR_GAP.findall(low)

    def _closer(self, text: str) -> np.ndarray:
        """Changes of a text that ``_words`` refuses, part by part between ASCII white space."""
        rows = [np.diff(np.array([0, *self._part(p)], dtype=np.int64)) for p in _blanked(text).split(" ")]
        gap = np.zeros(1, dtype=np.int64)
        steps = np.concatenate([x for r in rows for x in (r, gap)][:-1])
        return steps if np.abs(steps).max(initial=0) > 127 else steps.astype(np.int8)

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """Per text one signed change per code point: int8, or int64 if a change does not fit."""
        known, cut = self.parts.room(), [self._words(t) for t in texts]
        missing = set().union(*(c for c in cut if c is not None)).difference(known)
        missing = [w for w in missing if self.parts.promote(w) is None]
        new = {w: bytes(len(w)) for w in missing if _SPACE_AT.match(w)}
        new |= self.learn([w for w in missing if w not in new])
        known.update((w, s) for w, s in new.items() if len(w) <= CACHED_CHARS)
        out = []
        for text, words in zip(texts, cut):
            if words is None:
                out.append(self._closer(text))
                continue
            try:
                rows = [known[w] for w in words]
            except KeyError:
                rows = [known[w] if w in known else new[w] for w in words]
            try:
                out.append(np.frombuffer(b"".join(rows), dtype=np.int8))
            except TypeError:                       # a word has wide steps
                out.append(np.concatenate([np.frombuffer(r, dtype=np.int8).astype(np.int64) if isinstance(r, bytes) else r for r in rows]))
        return out


def counter(path: str) -> PrefixCounter:
    return kept(("prefix", path), lambda: PrefixCounter(path))


def _counts(steps: bytes, width: int) -> np.ndarray:
    return np.frombuffer(steps, dtype=np.int8 if width == 1 else np.int64).cumsum(dtype=np.int64)


def count_at(steps: bytes, width: int, chars: int) -> int:
    """Tokens of the first ``chars`` code points, encoded by themselves."""
    return int(_counts(steps, width)[chars - 1]) if chars else 0


def longest_within(steps: bytes, width: int, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    ok = np.flatnonzero(_counts(steps, width) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def windows(steps: bytes, width: int, budget: int) -> list[tuple[int, int]]:
    """``(start, end)`` cuts where the running count passes multiples of ``budget``."""
    counts = np.maximum.accumulate(_counts(steps, width))
    if not len(counts):
        return []
    ends = np.searchsorted(counts, np.arange(budget, int(counts[-1]) + budget, budget), side="right")
    cuts = np.unique(np.concatenate([[0], ends, [len(counts)]]))
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """All input rows and columns plus ``prefix_steps`` (binary), ``step_width`` (1 or 8), ``n_tokens``.

    Null text: as the empty text, 0 tokens and empty steps; empty input: no rows; repeated
    rows count alike; input columns named like a result column are replaced.
    """
    short_batches(df.sparkSession)
    df = df.drop("prefix_steps", "step_width", "n_tokens")

    def make():
        count = counter(tokenizer_path)

        def work(texts):
            rows = [(s.tobytes(), s.dtype.itemsize, int(s.sum(dtype=np.int64))) for s in count.steps([t or "" for t in texts])]
            return pd.DataFrame(rows, columns=["prefix_steps", "step_width", "n_tokens"])
        return work

    s = free_name(df.columns, "counted")
    out = df.withColumn(s, per_text("prefix_steps binary, step_width int, n_tokens long", make, F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], f"{s}.prefix_steps", f"{s}.step_width", f"{s}.n_tokens")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    return {c: b for b, c in _LETTERS.items()}
