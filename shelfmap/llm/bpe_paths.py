"""Byte-pair encodings as paths of mutually compatible tokens.

A token sequence is the encoding of its text exactly if every two neighbours are: if
merging the symbols of the two alone gives the two back.  So every prefix of a text has
one last token, found from the prefixes before it, and an encoding is the one path
through positions along compatible neighbours.

``PairRules`` walks one text; ``WordTable`` walks many short words at once with numpy.
"""

from __future__ import annotations

import numpy as np

MOST_PAIRS = 1 << 20
END = "</w>"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15            # odd multiplier of the rolling hash
SHIFT = 22                           # token numbers stay below 2**SHIFT
LENGTHS = (8, 16, 32, 64)            # words are padded to these lengths


class PairRules:
    """Merge rules: either ranks of symbol pairs, or ranks of the merged pieces."""

    def __init__(self, pieces: set[str], by_pair: dict[tuple[str, str], int] | None = None,
                 by_piece: dict[str, float] | None = None, end: str = ""):
        self.pieces, self.by_pair, self.by_piece, self.end = pieces, by_pair, by_piece, end
        self.longest = max((len(self.body(p)) for p in pieces), default=1)
        self.last_pair: tuple[str, ...] = ()              # what the last merge down to one symbol joined
        self._whole: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def closes(self, token: str) -> bool:
        """Whether the token ends a word (carries the end mark)."""
        return bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)

    def body(self, token: str) -> str:
        return token[:-len(self.end)] if self.closes(token) else token

    def symbols(self, token: str) -> list[str]:
        body = self.body(token)
        return [*body[:-1], body[-1] + self.end] if len(body) < len(token) else list(token)

    def _rank(self, a: str, b: str):
        return self.by_pair.get((a, b)) if self.by_pair is not None else self.by_piece.get(a + b)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the best-ranked pair, leftmost first, until none is left (for short inputs)."""
        symbols = list(symbols)
        ranks = [self._rank(a, b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return symbols
            if len(symbols) == 2:
                self.last_pair = tuple(symbols)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = self._rank(symbols[at], symbols[at + 1])
            if at:
                ranks[at - 1] = self._rank(symbols[at - 1], symbols[at])

    def whole(self, token: str) -> bool:
        """Whether the token's own text is encoded as this token."""
        known = self._whole.get(token)
        if known is None:
            known = token in self.pieces and self.merge(self.symbols(token)) == [token]
            if token in self.pieces:
                self._whole[token] = known
        return known

    def fits(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a`` in an encoding."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def last_tokens(self, text: str, first: int = 0, before: str | None = None) -> list[str | None]:
        """Per position ``i`` the last token of the path from ``first`` to ``i`` (None: no path).

        ``before`` is the token that ends at ``first``, None at a border no token crosses.  A
        character outside the vocabulary is a token by itself.
        """
        n, longest, pieces = len(text), self.longest, self.pieces
        last: list[str | None] = [None] * (n + 1)
        for i in range(first + 1, n + 1):
            for j in range(max(first, i - longest), i):
                t = text[j:i]
                if not self.whole(t) if t in pieces else i - j > 1:
                    continue
                p = before if j == first else last[j]
                if p is None and j == first or p is not None and self.fits(p, t):
                    last[i] = t
                    break
        return last

    def tokens(self, text: str) -> list[str]:
        """The encoding of a text, read back from the last tokens."""
        last, out, i = self.last_tokens(text), [], len(text)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def closed(self, text: str, cuts: list[int]) -> list[int]:
        """Token counts of the prefixes that end at ``cuts``, each encoded as a whole word (with its end mark)."""
        last, count, out = self.last_tokens(text), [0] * (len(text) + 1), []
        for i in range(1, len(text) + 1):
            count[i] = count[i - len(last[i])] + 1
        for k in cuts:
            for j in range(max(0, k - self.longest), k):
                t = text[j:k] + self.end
                if self.whole(t) and (j == 0 or self.fits(last[j], t)):
                    out.append(count[j] + 1)
                    break
        return out


class Splits:
    """Compatibility of many token pairs at once, by undoing their merges.

    Merges go by rank, so the tokens of a pair are built in the order of their ranks.  Undone
    latest first, each step bares the two symbols that met at the border for a while: if
    a rule joins these two and ranks before the merge that was undone last, the encoder
    would have merged across the border.  At equal ranks the left place goes first.

    This needs tokens whose last merge ranks after the merges of its parts, as trained
    vocabularies have them; ``odd`` marks those that are built otherwise, or of such parts.
    """

    def __init__(self, rules: PairRules, names: list[str]):
        number = {t: i for i, t in enumerate(names)}
        parts, own = [], []
        for t in names:
            symbols = rules.symbols(t)
            if len(symbols) > 1:
                rules.merge(symbols)
                parts.append(rules.last_pair)
            else:
                parts.append(None)
        for p in parts:
            for t in p or ():
                if t not in number:                       # a symbol that is no token by itself
                    number[t] = len(number)
                    own.append(None)
        parts += own
        if rules.by_pair is not None:
            pairs = ((a, b, r) for (a, b), r in rules.by_pair.items())
        else:
            pairs = ((p[:k], p[k:], r) for p, r in rules.by_piece.items() for k in range(1, len(p)))
        found = [(number[a] << SHIFT | number[b], r) for a, b, r in pairs if a in number and b in number]
        order = {r: i for i, r in enumerate(sorted({r for _, r in found}))}
        found = sorted((c, order[r]) for c, r in found)
        self.codes = np.array([c for c, _ in found], dtype=np.int64)
        self.ranks = np.array([r for _, r in found], dtype=np.int64)
        by_code = dict(found)
        n = len(parts)
        self.left, self.right, self.rank = np.arange(n), np.arange(n), np.full(n, -1, dtype=np.int64)
        for i, p in enumerate(parts):
            if p is not None:
                self.left[i], self.right[i] = number[p[0]], number[p[1]]
                self.rank[i] = by_code[number[p[0]] << SHIFT | number[p[1]]]
        self.odd = (self.rank >= 0) & (self.rank <= np.maximum(self.rank[self.left], self.rank[self.right]))
        while (more := (self.odd[self.left] | self.odd[self.right]) & ~self.odd).any():
            self.odd |= more

    def fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each token ``after`` may follow the token ``before``."""
        out = np.ones(len(before), dtype=bool)
        if not len(self.codes):
            return out
        at, x, y = np.arange(len(before)), before.astype(np.int64), after.astype(np.int64)
        limit = np.full(len(before), np.iinfo(np.int64).max)
        while len(at):
            code = (x << SHIFT) | y
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            crosses = (self.codes[place] == code) & (self.ranks[place] < limit)
            out[at[crosses]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            goes_on = ~crosses & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, rank_x, rank_y = at[goes_on], x[goes_on], y[goes_on], rank_x[goes_on], rank_y[goes_on]
            undo_left = rank_x > rank_y
            limit = np.where(undo_left, rank_x, rank_y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return out


class WordTable:
    """Last tokens of all prefixes of many short words at once.

    Tokens are found by a 64-bit rolling hash in one sorted table per token length;
    compatible pairs by their splits.
    """

    def __init__(self, rules: PairRules):
        self.rules = rules
        self.names = [p for p in sorted(rules.pieces) if rules.whole(p)]
        bodies: dict[str, list[int]] = {}
        for i, p in enumerate(self.names):
            bodies.setdefault(rules.body(p), [-1, -1])[rules.closes(p)] = i
        self.size = np.array([len(rules.body(p)) for p in self.names], dtype=np.int64)
        self.tables = {}
        for length in sorted({len(b) for b in bodies}):
            own = [b for b in bodies if len(b) == length]
            keys = np.array([self._hash(b) for b in own], dtype=np.uint64)
            order = np.argsort(keys)
            ids = np.array([bodies[b] for b in own], dtype=np.int64)[order]
            self.tables[length] = keys[order], ids[:, 0].copy(), ids[:, 1].copy()
        self.powers = np.array([pow(BASE, n, 1 << 64) for n in range(max(self.tables, default=1) + 1)], dtype=np.uint64)
        self.splits = Splits(rules, self.names)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & MASK
        return h

    def _fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of token numbers is compatible; ``before`` -1 is a word's start."""
        out = before < 0
        rows = np.flatnonzero(~out)
        if not len(rows):
            return out
        code, back = np.unique((before[rows] << SHIFT) | after[rows], return_inverse=True)
        a, b = code >> SHIFT, code & ((1 << SHIFT) - 1)
        good = self.splits.fit(a, b)
        for k in np.flatnonzero(self.splits.odd[a] | self.splits.odd[b]).tolist():
            good[k] = self.rules.fits(self.names[a[k]], self.names[b[k]])
        out[rows] = good[back]
        return out

    def walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(lengths, last token, token count, count as a whole word)`` of words of similar length.

        The last three have a column per prefix length; -1 and 0 where the vocabulary lacks a
        character.  The words must be in descending order of length.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n, rows = int(lengths.max()), len(words)
        flat = np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = flat.reshape(rows, n).T.astype(np.uint64) + np.uint64(1)
        hashes = np.zeros((n + 1, rows), dtype=np.uint64)
        for k in range(n):
            hashes[k + 1] = hashes[k] * np.uint64(BASE) + codes[k]
        last = np.full((n + 1, rows), -1, dtype=np.int64)
        count = np.zeros((n + 1, rows), dtype=np.int64)
        closed = np.zeros((n + 1, rows), dtype=np.int64)
        marks, lengths_down = bool(self.rules.end), sorted(self.tables, reverse=True)
        for k in range(1, n + 1):
            live = int(np.searchsorted(-lengths, -k, side="right"))     # rows at least k long come first
            open_left = np.ones(live, dtype=bool)
            closed_left = np.full(live, marks)
            for length in (m for m in lengths_down if m <= k):
                j, (keys, opens, closes) = k - length, self.tables[length]
                left = open_left | closed_left
                hit = np.flatnonzero(left & (last[j, :live] >= 0) if j else left)
                if not len(hit):
                    continue
                own = hashes[k, hit] - hashes[j, hit] * self.powers[length]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                same = keys[at] == own
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                for ids, found, missing in ((opens, last, open_left), (closes, closed, closed_left)) if marks else ((opens, last, open_left),):
                    token = ids[at]
                    open_ = (token >= 0) & missing[hit]
                    at_rows, token = hit[open_], token[open_]
                    if not len(token):
                        continue
                    fit = self._fit(last[j, at_rows], token)
                    at_rows, token = at_rows[fit], token[fit]
                    missing[at_rows] = False
                    if found is last:
                        last[k, at_rows] = token
                        count[k, at_rows] = count[j, at_rows] + 1
                    else:
                        closed[k, at_rows] = count[j, at_rows] + 1
        return lengths, last.T, count.T, closed.T

    def groups(self, words: list[str]):
        """The words in batches of similar length, longest first in each; longer ones than the last of LENGTHS stay out."""
        low = 0
        for most in LENGTHS:
            part = sorted((w for w in words if low < len(w) <= most), key=len, reverse=True)
            if part:
                yield part
            low = most

    def closed_steps(self, words: list[str]) -> dict[str, bytes]:
        """Per word the signed change of the token count with each character, prefixes encoded as whole words."""
        out = {}
        for part in self.groups(words):
            lengths, _, _, closed = self.walk(part)
            data, n = np.diff(closed, axis=1).astype(np.int8).tobytes(), closed.shape[1] - 1
            for i, (w, m) in enumerate(zip(part, lengths.tolist())):
                out[w] = data[i * n:i * n + m]
        return out

    def encodings(self, words: list[str], numbers: np.ndarray, dtype: str) -> dict[str, bytes]:
        """Per word its encoding, as ``numbers`` of its tokens; words with characters outside the vocabulary stay out."""
        out = {}
        for part in self.groups(words):
            lengths, last, count, _ = self.walk(part)
            rows = np.arange(len(part))
            total = count[rows, lengths]
            starts = np.concatenate([[0], np.cumsum(total)])
            flat, at, left = np.zeros(int(starts[-1]), dtype=dtype), lengths.copy(), total.copy()
            while len(rows):
                rows = rows[left[rows] > 0]
                token = last[rows, at[rows]]
                left[rows] -= 1
                flat[starts[rows] + left[rows]] = numbers[token]
                at[rows] -= self.size[token]
            data, width, ok = flat.tobytes(), np.dtype(dtype).itemsize, (last[np.arange(len(part)), lengths] >= 0).tolist()
            for w, a, b, fine in zip(part, starts.tolist(), starts[1:].tolist(), ok):
                if fine:
                    out[w] = data[a * width:b * width]
        return out
