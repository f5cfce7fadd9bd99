"""Document statistics shared by the two quality operators.

Words are maximal runs without ASCII white space; a null text counts as empty, for
which every statistic is 0.
"""

from __future__ import annotations

import re

import numpy as np

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = b"#*$%&|<>"
# In this order in every feature row.
FEATURES = ("log_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "top_word_share",
            "same_next_share", "distinct_share", "upper_share", "digit_share", "punct_share", "mark_share",
            "stop_share", "comma_share", "bar_share", "wide_share", "space_share", "line_words", "short_line_share",
            "one_char_share", "long_word_share", "byte_entropy", "word_entropy", "letter_share")


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window found at least twice (first occurrence included)."""
    n = len(codes)
    if n < 4:
        return 0
    pairs = codes[:-1] * kinds + codes[1:]
    if kinds < 2_000_000:
        windows = pairs[:-1] * kinds + codes[2:]
    else:                                   # the product could overflow: number the pairs first
        windows = np.unique(pairs[:-1], return_inverse=True)[1] * np.int64(kinds) + codes[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    if not again.any():
        return 0
    inside = np.zeros(n, dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def duplicate_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif _WORDS.search(line):
            seen.add(line)
    return again


def base_counts(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, list[str], list[str], np.ndarray]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` and the parts they came from."""
    words, lines = _WORDS.findall(text), text.split("\n")
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    counts = (len(words), sum(map(len, words)), int(octets[list(SYMBOLS)].sum()),
              duplicate_lines(lines), repeated_words(codes, max(len(number), 1)))
    return counts, codes, words, lines, octets


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log2(p)).sum())


def features(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five base counts and the feature row of one text."""
    text = text or ""
    counts, codes, words, lines, octets = base_counts(text)
    n, chars, symbols, dup, repeat = counts
    if not n:
        return counts, [0.0] * len(FEATURES)
    size = max(int(octets.sum()), 1)
    per_word = np.bincount(codes)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    spoken = [k for k in lines if k.strip()]
    kinds = len(per_word)
    letters = int(octets[65:91].sum() + octets[97:123].sum() + octets[192:].sum())
    row = [np.log1p(n), chars / n, symbols / size, dup / max(len(spoken), 1), repeat / n, per_word.max() / n,
           float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, kinds / n,
           octets[65:91].sum() / max(letters, 1), octets[48:58].sum() / size,
           (octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum()) / size,
           octets[[33, 63]].sum() / size, octets[46] / n, octets[44] / n, octets[124] / n,
           octets[128:].sum() / size, octets[[9, 10, 11, 12, 13, 32]].sum() / size, n / max(len(spoken), 1),
           sum(len(k) < 30 for k in spoken) / max(len(spoken), 1), (lens == 1).mean(), (lens > 20).mean(),
           _entropy(octets), _entropy(per_word) / np.log2(n + 1), letters / size]
    return counts, [float(v) for v in row]
