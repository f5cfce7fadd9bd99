"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

A sentence is a set of strings: its words reduced to lower-case letters (so characters put
between the letters of an insult vanish) and its runs of single letters joined.  Strings
are compared by the gap-weighted subsequence kernel of order three: every three letters in
order count, with weight ``DECAY ** span``, up to a span of ``SPAN`` letters, so inserted or
missing letters lower a match but do not undo it.  Long strings are cut into overlapping
windows.  Kernel values to ``LANDMARKS`` strings give Nyström features, on which a linear
support vector machine is trained.  A sentence counts as its most toxic string, a document by
its TOP most toxic strings, and a logistic curve turns their margins into a score.

The labels mark documents, so training finds the guilty strings itself: first those that, as a whole or by
a letter run, occur in far more toxic documents than expected, then, with each machine,
the string of each toxic document with the greatest margin, and harmless strings with
high margins join the negatives.  Copies of the guilty strings with a letter put in join
the positives, which teaches the machine to bear them.

As all features are explicit, the trained machine is one weight per letter triple, divided
by a string's own kernel norm; distinct words are scored once while cached.  Fitting
takes at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, chosen by hash.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, bounded_sample, free_name, held_out, per_text, short_batches

MAX_TOXIC = 1_500
MAX_CLEAN = 3_000
LANDMARKS = 256
DECAY = 0.7
SPAN = 6
WINDOW = 12
STRIDE = 4
ALPHABET = 64
GRAM = 5
PENALTY = 1e-6
STEPS = 400
ROUNDS = 3
MAX_NEGATIVES = 8_000
MAX_HARMLESS = 100_000
PURITY = 8.0
GUILT = 8.0
SURE_WEIGHT = 0.25
LEAST_SURPLUS = 1.4
SURE_SURPLUS = 2.2
SURE_SHARE = 0.03
NO_STRING = -1.0
TOP = 3
VARIANTS = 4
CACHE_WORDS = 400_000
THRESHOLD = 0.5

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[\W\d_]+")
_RUNS = re.compile(r"(?<!\S)(?:[^\W\d_][\W_]{1,3}){2,}[^\W\d_](?!\w)")
START, STOP = "^", "$"


def letters(word: str) -> str:
    """The word's letters in lower case."""
    return _LETTERS.sub("", word.lower())


def strings(text: str | None) -> set[str]:
    """The words of a text, and its runs of single letters; still to be reduced to letters."""
    text = text or ""
    return {*_WORDS.findall(text), *_RUNS.findall(text)}


def windows(word: str) -> list[str]:
    """The word's letters between end marks, cut into overlapping windows; none for fewer than three letters."""
    s = letters(word)
    if len(s) < 3:
        return []
    s = START + s + STOP
    return [s] if len(s) <= WINDOW else [s[i:i + WINDOW] for i in range(0, len(s) - WINDOW + STRIDE, STRIDE)]


# All index triples of a window whose span fits, with their weights.
_TRIPLES = np.array([(i, j, k) for i in range(WINDOW) for j in range(i + 1, WINDOW)
                     for k in range(j + 1, min(WINDOW, i + SPAN))])
_WEIGHTS = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1)


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged triples per window: ``(triple numbers, weights)``, absent ones with weight 0.

    ``codes`` holds letter codes, -1 beyond a window's end.
    """
    a, b, c = (codes[:, _TRIPLES[:, i]] for i in range(3))
    number = (a * ALPHABET + b) * ALPHABET + c
    number[c < 0] = ALPHABET ** 3
    order = np.argsort(number, axis=1, kind="stable")
    number = np.take_along_axis(number, order, axis=1)
    sums = np.cumsum(np.where(number < ALPHABET ** 3, _WEIGHTS[order], 0.0), axis=1)
    last = np.ones(number.shape, dtype=bool)
    last[:, :-1] = number[:, 1:] != number[:, :-1]
    upto = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(upto, axis=1)
    weight = np.where(last, sums - np.concatenate([np.zeros((len(codes), 1)), before[:, :-1]], axis=1), 0.0)
    weight[number == ALPHABET ** 3] = 0.0
    return np.minimum(number, ALPHABET ** 3 - 1), weight


class Letters:
    """Codes of the letters seen in training; all others share code 0."""

    def __init__(self, words):
        common = Counter(c for w in words for c in w)
        known = [START, STOP, *(c for c, _ in common.most_common() if c not in (START, STOP))]
        self.code = {c: i + 1 for i, c in enumerate(known[:ALPHABET - 1])}

    def __call__(self, parts: list[str]) -> np.ndarray:
        out = np.full((len(parts), WINDOW), -1, dtype=np.int64)
        for r, p in enumerate(parts):
            out[r, :len(p)] = [self.code.get(c, 0) for c in p]
        return out


@dataclass
class ToxicModel:
    """Letter codes, one weight per triple, bias, and the logistic curve of the margin."""

    letters: Letters
    weights: np.ndarray
    bias: float
    curve: np.ndarray | None = None          # weights of the greatest margins, then the shift

    def margins(self, parts: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(parts), 4096):
            number, weight = triples(self.letters(parts[i:i + 4096]))
            norm = np.sqrt((weight ** 2).sum(axis=1))
            out.append((self.weights[number] * weight).sum(axis=1) / np.maximum(norm, 1e-9) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, top: np.ndarray) -> np.ndarray:
        """Scores of documents from their TOP greatest margins, in descending order."""
        return 1 / (1 + np.exp(-np.clip(top @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Scorer:
    """Margins of words, each distinct word computed once while cached."""

    def __init__(self, model: ToxicModel):
        self.model, self.cache = model, TwoGenerations(CACHE_WORDS)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        known, words = self.cache.room(), [strings(t) for t in texts]
        fresh = [w for w in set().union(*words).difference(known) if self.cache.promote(w) is None] if words else []
        parts, owner = [], []
        for i, w in enumerate(fresh):
            cut = windows(w)
            parts.extend(cut)
            owner.extend([i] * len(cut))
        best = np.full(len(fresh), NO_STRING)
        np.maximum.at(best, np.array(owner, dtype=np.int64), self.model.margins(parts))
        new = dict(zip(fresh, best.tolist()))
        known.update((w, m) for w, m in new.items() if len(w) <= 64)
        return np.array([_top([known[w] if w in known else new[w] for w in ws]) for ws in words]).reshape(len(words), TOP)


def _top(margins: list[float]) -> list[float]:
    """The TOP greatest margins, NO_STRING where there are fewer."""
    return [max(m, NO_STRING) for m in heapq.nlargest(TOP, margins)] + [NO_STRING] * max(0, TOP - len(margins))


def _features(parts: list[str], code: Letters, column: np.ndarray, width: int) -> np.ndarray:
    """Normalised explicit kernel features on the landmark triples (dense rows)."""
    out = np.zeros((len(parts), width), dtype=np.float32)
    number, weight = triples(code(parts))
    norm = np.maximum(np.sqrt((weight ** 2).sum(axis=1)), 1e-9)
    col = column[number]
    rows, at = np.nonzero((col >= 0) & (weight > 0))
    np.add.at(out, (rows, col[rows, at]), (weight[rows, at] / norm[rows]).astype(np.float32))
    return out


def _kernel(parts: list[str], code: Letters, column: np.ndarray, land: np.ndarray) -> np.ndarray:
    return np.concatenate([_features(parts[i:i + 512], code, column, land.shape[1]) @ land.T
                           for i in range(0, len(parts), 512)]) if parts else np.zeros((0, len(land)), dtype=np.float32)


def _guilty(toxic: list[list[str]], clean: list[list[str]]) -> tuple[list[str | None], dict[str, int]]:
    """Per toxic document the string that marks toxic documents most (None if none does), and common sure ones.

    A string marks them as a whole or by a letter run in it.  Sure are those that at least
    SURE_SHARE of the toxic documents hold and hardly any clean one; they come with their number.
    """
    def grams(p: str) -> set[str]:
        return {p[i:i + GRAM] for i in range(max(1, len(p) - GRAM + 1))}

    hits, misses = Counter(), Counter()
    for docs, count in ((toxic, hits), (clean, misses)):
        for parts in docs:
            count.update({g for p in parts for g in grams(p)})
    worth = {g: _surplus(n, misses[g], len(toxic), len(clean)) for g, n in hits.items()}
    whole, whole_misses = Counter(), Counter()
    for docs, count in ((toxic, whole), (clean, whole_misses)):
        for parts in docs:
            count.update(set(parts))

    def value(p: str) -> float:
        return max(_surplus(whole[p], whole_misses[p], len(toxic), len(clean)), max(worth[g] for g in grams(p)))

    best = [max(((value(p), p) for p in parts), default=(0.0, None)) for parts in toxic]
    sure = {p: n for p, n in whole.items() if n >= SURE_SHARE * len(toxic)
            and _surplus(n, whole_misses[p], len(toxic), len(clean)) >= SURE_SURPLUS}
    return [p if v >= LEAST_SURPLUS else None for v, p in best], sure


def _surplus(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Toxic documents beyond PURITY times what the clean ones let expect, in units of their spread."""
    return (toxic - PURITY * clean * all_toxic / max(all_clean, 1)) / np.sqrt(toxic + 1)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated full gradients."""
    w, b = np.zeros(z.shape[1]), 0.0
    vw, vb, sw, sb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    total = weight.sum()
    for t in range(1, STEPS + 1):
        slack = np.maximum(0, 1 - y * (z @ w + b)) * weight * y / total
        gw, gb = PENALTY * w - 2 * (z.T @ slack), -2 * slack.sum()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        sw, sb = 0.999 * sw + 0.001 * gw ** 2, 0.999 * sb + 0.001 * gb ** 2
        rate, c1, c2 = 0.1, 1 - 0.9 ** t, 1 - 0.999 ** t
        w = w - rate * (vw / c1) / (np.sqrt(sw / c2) + 1e-9)
        b = b - rate * (vb / c1) / (np.sqrt(sb / c2) + 1e-9)
    return w, float(b)


def fit_strings(toxic: list[list[str]], clean: list[list[str]], share: float) -> ToxicModel | None:
    """Train on the window lists of toxic and clean documents; ``share`` of all labelled ones are toxic."""
    rng = np.random.default_rng(7)
    guilty, sure = _guilty(toxic, clean)
    misses = Counter(p for parts in clean for p in parts)
    harmless = sorted(misses)
    if len(harmless) > MAX_HARMLESS:
        harmless = [harmless[i] for i in np.sort(rng.permutation(len(harmless))[:MAX_HARMLESS])]
    negatives = [harmless[i] for i in rng.permutation(len(harmless))[:MAX_NEGATIVES // 2]]
    code = Letters(p for p in guilty if p)
    model = None
    if not any(guilty):                         # too few documents to tell: take every string of the toxic ones
        seen = set(harmless)
        guilty = [p for parts in toxic for p in parts if p not in seen] or [p for parts in toxic for p in parts]
    for _ in range(ROUNDS):
        if not any(guilty):
            break
        count = Counter(p for p in guilty if p)
        count.update({p: SURE_WEIGHT * n for p, n in sure.items() if p not in count})
        for p in sorted(count):                 # the same strings with a letter put in, or one doubled
            known = sorted(code.code)
            for _ in range(VARIANTS):
                i = int(rng.integers(2, max(3, len(p) - 1)))
                extra = p[i] if rng.random() < 0.5 and p[i:] and p[i] != STOP else known[int(rng.integers(2, len(known)))]
                variant = (p[:i] + extra + p[i:])[:WINDOW]
                if variant not in misses and extra not in (START, STOP):
                    count[variant] += count[p] / VARIANTS
        positives = sorted(count)
        marks = [p for p, _ in count.most_common(LANDMARKS * 3 // 4)]
        marks += negatives[-(LANDMARKS - len(marks)):]          # the newest negatives are the hardest
        marks = sorted(set(marks))
        number, weight = triples(code(marks))
        used = np.unique(number[weight > 0])
        column = np.full(ALPHABET ** 3, -1, dtype=np.int64)
        column[used] = np.arange(len(used))
        land = _features(marks, code, column, len(used))
        values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T      # K^-1/2 of the landmarks
        x = positives + negatives
        z = _kernel(x, code, column, land) @ root
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        # Strings that clean documents hold too weigh against the machine once per such document, and more.
        weigh = np.array([GUILT * count[p] for p in positives] + [PURITY * misses[p] for p in negatives])
        weigh[len(positives):] *= np.where(model.margins(negatives) > 0, 1.0, 1 / PURITY) if model else 1 / PURITY
        w, b = _svm(z, y, weigh)
        table = np.zeros(ALPHABET ** 3)
        table[used] = land.T @ (root @ w)                      # the machine as one weight per triple
        model = ToxicModel(code, table, b)
        hard = model.margins(harmless)
        worst = np.argsort(-hard)[:MAX_NEGATIVES // 4]
        negatives = list(dict.fromkeys([*negatives, *(harmless[i] for i in worst[::-1] if hard[i] > -1)]))[-MAX_NEGATIVES:]
        guilty = [_worst(model, parts) for parts in toxic]
    if model is None:
        return None
    top = np.array([_top(model.margins(p).tolist()) for p in [*toxic, *clean]])
    label = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    model.curve = _logistic(top, label, share)
    return model


def _worst(model: ToxicModel, parts: list[str]) -> str | None:
    """The string with the greatest margin, if the machine finds any toxic."""
    margins = model.margins(parts)
    return parts[int(np.argmax(margins))] if len(margins) and margins.max() > 0 else None


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Non-negative logistic weights of margins and a shift; ``share`` is the classes' true proportion."""
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    theta = np.zeros(a.shape[1])
    free = np.ones(a.shape[1], dtype=bool)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-4 * theta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(a.shape[1])
        step = np.zeros_like(theta)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        theta = theta - 0.5 * step
        bad = theta[:-1] < 0
        theta[:-1][bad], free[:-1][bad] = 0.0, False
    return theta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel | None:
    """Fit on labelled rows that are not held out; None without rows of both labels."""
    short_batches(docs.sparkSession)
    known = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max("toxic").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    picked = [bounded_sample(known.where(F.col("y") == y).select("k", "y"), F.col("k"), most)
              for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]

    def make():
        return lambda texts: pd.DataFrame({"parts": [sorted({p for w in strings(t) for p in windows(w)}) for t in texts]})

    # At most MAX_TOXIC + MAX_CLEAN identifiers are broadcast.
    rows = (docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
            .join(F.broadcast(picked[0].union(picked[1])), "k")
            .select("y", "k", per_text("parts array<string>", make, F.col("t")).alias("s")).select("y", "k", "s.parts").collect())
    rows.sort(key=lambda r: (r[1], r[2]))
    toxic, clean = ([list(r[2]) for r in rows if r[0] == y] for y in (1, 0))
    return fit_strings(toxic, clean, counts[1] / (counts[0] + counts[1])) if any(toxic) and any(clean) else None


def score_toxicity(df: DataFrame, model: ToxicModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All input rows and columns plus ``score`` and ``predicted`` (1 if score >= threshold).

    Null and empty texts hold no string and get the lowest score; without a model every
    score is 0; empty input: no rows; repeated rows score alike; input columns named like a
    result column are replaced.
    """
    short_batches(df.sparkSession)
    df = df.drop("score", "predicted")

    def make():
        scorer = Scorer(model) if model else None

        def work(texts):
            s = model.score(scorer.documents(texts)) if model and texts else np.zeros(len(texts))
            return pd.DataFrame({"score": s})
        return work

    s = free_name(df.columns, "scored")
    out = df.withColumn(s, per_text("score double", make, F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{s}.score").alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
