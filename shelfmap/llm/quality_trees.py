"""Quality rules: monotone gradient-boosted trees over document statistics.

Two fixed rules reject short and repetitive texts; the rest is judged by boosted trees
that are fitted here with numpy on histograms and flattened into node arrays, so that a
batch of rows is scored by a few array look-ups per tree level.  More symbols, repeated
words or repeated lines can never raise a score, more words can never lower it.

Fitting takes at most ``MAX_LABELLED`` labelled rows that are not held out, chosen by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import bounded_sample, free_name, held_out, per_text, short_batches
from .quality_pu import quantile_edges

MAX_LABELLED = 16_000
TREES = 60
DEPTH = 4
RATE = 0.15
L2 = 1.0
LEAST_ROWS = 20
BINS = 48
THRESHOLD = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 0.5
# +1: a larger value never lowers the score; -1: never raises it.
MONOTONE = {"log_words": 1, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_next_share": -1,
            "bar_share": -1}


@dataclass
class FlatTrees:
    """All trees in shared node arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_split(bins, grad, hess, rows, signs, low, high):
    """(gain, feature, bin, left value, right value) of the best split that keeps the order, or None."""
    n_feat, width = bins.shape[1], BINS
    flat = (bins[rows] + np.arange(n_feat) * width).ravel()
    g = np.bincount(flat, np.repeat(grad[rows], n_feat), n_feat * width).reshape(n_feat, width).cumsum(axis=1)
    h = np.bincount(flat, np.repeat(hess[rows], n_feat), n_feat * width).reshape(n_feat, width).cumsum(axis=1)
    c = np.bincount(flat, minlength=n_feat * width).reshape(n_feat, width).cumsum(axis=1)
    gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
    gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
    vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-gr / (hr + L2), low, high)

    def kept(v, gs, hs):              # loss change of a leaf with value v
        return gs * v + 0.5 * (hs + L2) * v * v

    whole = np.clip(-g[:, -1:] / (h[:, -1:] + L2), low, high)
    gain = kept(whole, g[:, -1:], h[:, -1:]) - kept(vl, gl, hl) - kept(vr, gr, hr)
    s = signs[:, None]
    bad = (cl < LEAST_ROWS) | (cr < LEAST_ROWS) | ((s > 0) & (vl > vr)) | ((s < 0) & (vl < vr))
    gain = np.where(bad, -np.inf, gain)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (gain[f, b], f, b, vl[f, b], vr[f, b]) if gain[f, b] > 1e-6 else None


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES) -> FlatTrees:
    """Second-order boosting of the logistic loss; value bounds pass down so that order holds in every subtree."""
    edges = quantile_edges(x, BINS)
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    nodes: list[list] = []
    model_bias, roots, raw = float(np.log(mean / (1 - mean))), [], np.full(len(y), np.log(mean / (1 - mean)))

    def grow(rows, depth, low, high, grad, hess):
        me = len(nodes)
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + L2), low, high))
        nodes.append([0, 0.0, me, me, RATE * value])
        split = _best_split(bins, grad, hess, rows, signs, low, high) if depth < DEPTH else None
        if split is None:
            raw[rows] += RATE * value
            return me
        _, f, b, vl, vr = split
        goes = bins[rows, f] <= b
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(signs[f])]
        left = grow(rows[goes], depth + 1, *bounds[0], grad, hess)
        right = grow(rows[~goes], depth + 1, *bounds[1], grad, hess)
        nodes[me][:4] = [int(f), float(edges[f][b]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    feature, cut, left, right, value = (np.array(c) for c in zip(*nodes))
    return FlatTrees(feature, cut, left, right, value, np.array(roots), model_bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FlatTrees | None:
    """Fit on labelled rows that are not held out; None if there is none."""
    short_batches(docs.sparkSession)
    known = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.min("quality").alias("q")).where("q IS NOT NULL")
    known = bounded_sample(known, F.col("k"), MAX_LABELLED)
    rows = (docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(known), "k")
            .select("q", per_text("x array<double>", _features_only, F.col("t")).alias("s")).select("q", "s.x").collect())
    if not rows:
        return None
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=float)
    return fit_trees(x, y, np.array([MONOTONE.get(f, 0) for f in docstats.FEATURES]))


def _features_only():
    return lambda texts: pd.DataFrame({"x": [docstats.features(t)[1] for t in texts]})


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, tree_score double, kept boolean")


def judge_quality(df: DataFrame, model: FlatTrees | None, text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """All input rows and columns plus the five counts, ``base_failed``, ``tree_score``, ``kept``.

    ``base_failed``: fewer than LEAST_WORDS words, or more than half of the words repeated.
    ``kept``: not base_failed and a tree score of at least ``threshold`` (without a model:
    1).  Null text: no words, so base_failed; empty input: no rows; repeated rows are
    judged alike; input columns named like a result column are replaced.
    """
    short_batches(df.sparkSession)
    result = [c.split()[0] for c in SCHEMA.split(", ")]
    df = df.drop(*result)

    def make():
        def work(texts):
            found = [docstats.features(t) for t in texts]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(len(texts), 5)
            x = np.array([r for _, r in found], dtype=np.float64).reshape(len(texts), -1)
            score = model.score(x) if model and len(x) else np.ones(len(texts))
            failed = (counts[:, 0] < LEAST_WORDS) | (counts[:, 4] > MOST_REPEATED * counts[:, 0])
            data = dict(zip(result[:5], counts.T))
            return pd.DataFrame(data | {"base_failed": failed, "tree_score": score, "kept": ~failed & (score >= threshold)})
        return work

    s = free_name(df.columns, "judged")
    out = df.withColumn(s, per_text(SCHEMA, make, F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{s}.{c}").alias(c) for c in result])
