"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are enough: no row labelled 0 is
used as a negative.  The class prior is estimated first by a classifier of positives
against unlabelled rows: on the half it was not fitted on, the least ratio of the share of
unlabelled rows to the share of positives above a score bounds the share of positives
among the unlabelled rows.  Then the non-negative unbiased risk

    prior * loss+(positives) + max(0, loss-(unlabelled) - prior * loss-(positives))

is minimised and the bias set so that the unlabelled rows' mean score is the prior.  The model is additive over quantile bins of the document statistics, so a
score is one table look-up per statistic.

Fitting takes bounded samples (``MAX_POSITIVES``, ``MAX_UNLABELLED`` rows, chosen by
hash); scoring covers every row and the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import bounded_sample, free_name, held_out, per_text, short_batches

MAX_POSITIVES = 8_000
MAX_UNLABELLED = 12_000
BINS = 24
STEPS = 1000
RATE = 0.08
DECAY = 1e-4
PRIOR_STEPS = 200
PRIOR_DECAY = 3e-3
THRESHOLD = 0.3


@dataclass
class BinnedModel:
    """Scores ``sigmoid(bias + sum of one weight per statistic's bin)``."""

    edges: np.ndarray        # statistics x (BINS - 1), ascending
    weights: np.ndarray      # statistics x BINS
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(bins.shape[1]), bins].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.quantile(x, np.arange(1, bins) / bins, axis=0).T.copy()


def _descend(model: BinnedModel, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, decay: float) -> None:
    """Adam on the non-negative risk; with ``prior`` None, plain logistic loss of positives against unlabelled."""
    shape = model.weights.shape
    cells = np.arange(shape[0]) * shape[1]
    flat_pos, flat_unl = pos + cells, unl + cells
    theta = np.concatenate([model.weights.ravel(), [model.bias]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def spread(flat: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        g = np.bincount(flat.ravel(), weights=np.repeat(per_row, flat.shape[1]), minlength=theta.size - 1)
        return np.concatenate([g, [per_row.sum()]])

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, steps + 1):
        zp = theta[flat_pos].sum(axis=1) + theta[-1]
        zu = theta[flat_unl].sum(axis=1) + theta[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        if prior is None:
            grad = spread(flat_pos, (sp - 1) / len(sp)) + spread(flat_unl, su / len(su))
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            rest = spread(flat_unl, su / len(su)) - prior * spread(flat_pos, sp / len(sp))
            grad = prior * spread(flat_pos, (sp - 1) / len(sp)) + rest if negative >= 0 else -rest
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(shape), float(theta[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from held-out scores of positives against unlabelled.

    The least upper bound over thresholds of (share of unlabelled above + slack) / (share
    of positives above - slack), the slack being each share's sampling error.
    """
    order = np.sort(np.concatenate([pos, unl]))
    cuts = order[:: max(1, len(order) // 200)]
    q_pos = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    q_unl = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    slack = np.sqrt(1 / len(pos)) + np.sqrt(1 / len(unl))
    best = int(np.argmin((q_unl + slack) / np.maximum(q_pos, 1e-9)))
    return float(np.clip(q_unl[best] / max(q_pos[best], 1e-9), 0.05, 0.95))


def fit_pu(pos: np.ndarray, unl: np.ndarray) -> BinnedModel:
    """Estimate the prior by cross-fitting on halves, then minimise the non-negative risk on all."""
    edges = quantile_edges(np.concatenate([pos, unl]))
    blank = np.zeros((edges.shape[0], BINS))
    model = BinnedModel(edges, blank, 0.0, 0.5)
    bp, bu = model.bins(pos), model.bins(unl)
    raw_pos, raw_unl = np.zeros(len(bp)), np.zeros(len(bu))
    for part in (0, 1):                       # each half is scored by the classifier of the other half
        first = BinnedModel(edges, blank.copy(), 0.0, 0.5)
        _descend(first, bp[part::2], bu[part::2], None, PRIOR_STEPS, PRIOR_DECAY)
        raw_pos[1 - part::2], raw_unl[1 - part::2] = first.raw(bp[1 - part::2]), first.raw(bu[1 - part::2])
    prior = estimate_prior(raw_pos, raw_unl) if len(pos) > 1 and len(unl) > 1 else 0.5
    model = BinnedModel(edges, blank, float(np.log(prior / (1 - prior))), prior)
    _descend(model, bp, bu, prior, STEPS, DECAY)
    # The clamp stops the descent before unlikely rows are sure: move the bias until the mean score of
    # the unlabelled rows is the prior, as it is for calibrated scores.
    raw, low, high = model.raw(bu), -30.0, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (1 / (1 + np.exp(-np.clip(raw + mid, -30, 30)))).mean() > prior else (mid, high)
    model.bias += low
    return model


def statistics_rows(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The feature rows of a bounded frame."""
    short_batches(df.sparkSession)
    rows = df.select(per_text("x array<double>", _features_only, F.col(text_col)).alias("s")).select("s.x").collect()
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), len(docstats.FEATURES))


def _features_only():
    return lambda texts: pd.DataFrame({"x": [docstats.features(t)[1] for t in texts]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> BinnedModel | None:
    """Fit on rows that are not held out; None if there is no positive or no unlabelled row."""
    train = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(~held_out("k"))
    good = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.min("quality").alias("q")).where("q = 1")
    good = bounded_sample(good.select("k"), F.col("k"), MAX_POSITIVES)
    pos = statistics_rows(train.join(F.broadcast(good), "k"), "t")   # at most MAX_POSITIVES identifiers
    unl = statistics_rows(bounded_sample(train, F.col("k"), MAX_UNLABELLED), "t")
    if not len(pos) or not len(unl):
        return None
    return fit_pu(pos[:MAX_POSITIVES * 2], unl)


def score_quality(df: DataFrame, model: BinnedModel | None, text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """All input rows and columns plus ``score`` and ``predicted`` (1 if score >= threshold).

    Null text: scored as empty; without a model every score is 0.5; empty input: no rows;
    input columns named like a result column are replaced; repeated rows score alike.
    """
    short_batches(df.sparkSession)
    df = df.drop("score", "predicted")

    def make():
        def work(texts):
            x = np.array([docstats.features(t)[1] for t in texts], dtype=np.float64).reshape(len(texts), -1)
            return pd.DataFrame({"score": model.score(x) if model and len(x) else np.full(len(texts), 0.5)})
        return work

    s = free_name(df.columns, "scored")
    out = df.withColumn(s, per_text("score double", make, F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{s}.score").alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
