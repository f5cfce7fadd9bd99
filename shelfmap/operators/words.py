"""Word-category features (F4-F10): word vectors, context encoding, hit histograms.

Context encoding replaces the reference's scan of every bigram per word with
two equi-joins (bigram's other word -> its vector) and per-word sums, so the
work is linear in the number of bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from shelfmap.operators.som import EPOCHS
from shelfmap.session import reliable_checkpoint

from shelfmap.functions.arrays import gaussian_weights, minmax_scale

WORD_DIMS = 90            # fixed value: random vector length of the word map


def hashed_unit(word, dims: int):
    """Deterministic value in [0, 1) for ``(word, i)``: md5 prefix as a 32-bit fraction."""
    return lambda i: (F.conv(F.substring(F.md5(F.concat(word, F.lit("#"), i.cast("string"))), 1, 8), 16, 10)
                      .cast("double") / F.lit(4294967296.0))


def word_vectors(words: DataFrame, word_col: str = "term", dims: int = WORD_DIMS) -> DataFrame:
    """``(word, vec)`` with ``dims`` reproducible pseudo-random values per word."""
    w = F.col(word_col)
    return words.select(w.alias("word"),
                        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), hashed_unit(w, dims)).alias("vec"))


def context_encoding(words: DataFrame, bigrams: DataFrame, dims: int) -> DataFrame:
    """``(word, enc)`` of length ``2*dims``.

    First half: mean of vec(x) over bigrams ``"w x"`` weighted by the bigram
    total; second half: the same over ``"x w"``.  Bigrams whose other word has
    no vector add 0 but still count in the denominator; no bigrams -> zeros.
    ``words``: ``(word, vec)``; ``bigrams``: ``(term, total)``.
    """
    parts = F.split(F.col("term"), " ")
    bg = bigrams.select(parts.getItem(0).alias("w1"), parts.getItem(1).alias("w2"), "total")
    # both sides stacked: (word, half, other word, total) -> one join, one aggregate
    sides = (bg.select(F.col("w1").alias("word"), F.lit(0).alias("half"), F.col("w2").alias("other"), "total")
             .unionByName(bg.select(F.col("w2").alias("word"), F.lit(1).alias("half"),
                                    F.col("w1").alias("other"), "total")))
    vec = words.select(F.col("word").alias("other"), F.col("vec").alias("ovec"))
    agg = (sides.join(vec, "other", "left")
           .groupBy("word", "half")
           .agg(F.sum("total").alias("den"),
                F.array(*[F.sum(F.col("total") * F.coalesce(F.col("ovec")[i], F.lit(0.0)))
                          for i in range(dims)]).alias("num")))
    zeros = F.array_repeat(F.lit(0.0), dims)

    def mean(half: str):
        return F.when(F.col(f"{half}.den") > 0,
                      F.transform(F.col(f"{half}.num"), lambda x: x / F.col(f"{half}.den"))).otherwise(zeros)

    # a word's two halves meet in one row, so that what lies below is computed once
    both = agg.groupBy("word").agg(*[F.first(F.when(F.col("half") == k, F.struct("den", "num")), ignorenulls=True).alias(name)
                                     for k, name in enumerate(("front", "back"))])
    return (words.select("word").join(both, "word", "left")
            .select("word", F.concat(mean("front"), mean("back")).alias("enc")))


def word_minmax(enc: DataFrame, col: str = "enc", out: str = "scaled") -> DataFrame:
    """min-max of each word over its own values (constant -> zeros)."""
    return enc.withColumn(out, minmax_scale(F.col(col)))


def apply_scale(df: DataFrame, scales: DataFrame, key: str, col: str, inverse: bool = False) -> DataFrame:
    """Apply stored ``(key, lo, hi)`` min-max, or invert it."""
    j = df.join(scales, key, "left")
    span = F.col("hi") - F.col("lo")
    if inverse:
        f = F.transform(F.col(col), lambda x: x * span + F.col("lo"))
    else:
        f = F.when(span == 0, F.transform(F.col(col), lambda x: F.lit(0.0))).otherwise(
            F.transform(F.col(col), lambda x: (x - F.col("lo")) / span))
    return j.withColumn(col, f).drop("lo", "hi")


def md5_cell(word, units: int):
    """Stand-in word -> map unit: md5 prefix modulo the number of units."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % F.lit(units)).cast("int")


def hit_counts(counts: DataFrame, word_cells: DataFrame, cols: int) -> DataFrame:
    """D4/E-6: ``(doc, idx, n)`` - term counts added at ``row * cols + col`` of the term's cell.

    ``counts``: ``(doc, term, n)``; ``word_cells``: ``(term, bmu_col, bmu_row)``;
    unknown terms are dropped by the inner join.
    """
    idx = (F.col("bmu_row") * cols + F.col("bmu_col")).cast("int")
    return (counts.join(word_cells, "term")
            .groupBy("doc", idx.alias("idx")).agg(F.sum("n").alias("n")))


def dense_histogram(docs: DataFrame, hits: DataFrame, units: int, doc: str = "doc") -> DataFrame:
    """one ``units``-long array per document (documents without hits are zeros)."""
    def filled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, n in batches:
            h = np.zeros((len(at), units))
            for row, i, v in zip(h, at, n):
                if i is not None:
                    row[i] = v
            yield pd.Series(list(h))

    filled.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    per_doc = hits.groupBy(doc).agg(F.collect_list(F.struct("idx", F.col("n").cast("double").alias("n"))).alias("m"))
    return (docs.select(doc).join(per_doc, doc, "left")
            .select(doc, F.pandas_udf(filled, "array<double>")(F.col("m")["idx"], F.col("m")["n"]).alias("h")))


def blur_matrix(n: int, fwhm: float = 2.0) -> np.ndarray:
    """The unnormalised Gaussian filter with mirrored edges as an ``n x n`` matrix."""
    weights = gaussian_weights(fwhm, normalized=False)
    r, k = len(weights) // 2, np.zeros((n, n))
    for i in range(n):
        for d, w in enumerate(weights, -r):
            m = (i + d) % (2 * n)
            k[m if m < n else 2 * n - 1 - m, i] += w
    return k


def blurred_histogram(hist: DataFrame, col: str = "h", out: str = "h") -> DataFrame:
    """F7 + F8: Gaussian blur (FWHM 2) then min-max, per document; one matrix product per Arrow batch.

    Min-max is scale-invariant, so the kernel is applied unnormalised: with integer
    counts and the dyadic FWHM-2 kernel every sum is exact.  Histograms have one length.
    """
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kernel = None
        for rows in batches:
            if not len(rows):
                yield rows
                continue
            h = np.stack(rows.to_numpy())
            if kernel is None or len(kernel) != h.shape[1]:
                kernel = blur_matrix(h.shape[1])
            h = h @ kernel
            low, span = h.min(axis=1, keepdims=True), np.ptp(h, axis=1)[:, None]
            yield pd.Series(list(np.divide(h - low, span, out=np.zeros_like(h), where=span != 0)))

    scaled.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return hist.withColumn(out, F.pandas_udf(scaled, "array<double>")(F.col(col)))


WORD_MAP = (15, 21)       # fixed values: word-category map rows x cols
WORD_MIN_DF = 10
MAX_CELL_BYTES = 32 << 20  # of words and their cells that are broadcast to the counts


def word_category_map(stats: DataFrame, bigram_totals: DataFrame, dims: int = WORD_DIMS,
                      rows: int = WORD_MAP[0], cols: int = WORD_MAP[1], epochs: int = EPOCHS,
                      min_df: int = WORD_MIN_DF):
    """F3-F6 + G7 + G9: train the word map on context encodings; return ``(W, word_cells)``.

    ``stats``: ``(term, df)``; ``bigram_totals``: ``(term, total)``, read twice.
    ``word_cells`` is ``(term, bmu_col, bmu_row)`` for every vocabulary word.
    """
    from shelfmap.operators.som import assign_bmu, codebook_frame, train_som
    vocab = reliable_checkpoint(stats.where(F.col("df") >= min_df).select("term"))     # read twice
    enc = word_minmax(context_encoding(word_vectors(vocab, "term", dims), bigram_totals, dims))
    enc = reliable_checkpoint(enc.select("word", "scaled"))     # reused by training and placement
    spark = stats.sparkSession
    W, _ = train_som(enc, "scaled", rows, cols, epochs=epochs)
    cells = assign_bmu(enc.select(F.col("word").alias("term"), "scaled"),
                       codebook_frame(spark, W, rows, cols), "term", "scaled")
    return W, cells.select("term", "bmu_col", "bmu_row")


def document_histograms(docs: DataFrame, counts: DataFrame, word_cells: DataFrame,
                        rows: int = WORD_MAP[0], cols: int = WORD_MAP[1], doc: str = "doc") -> DataFrame:
    """blurred, min-max scaled hit histogram of every document, keyed by ``doc``.

    ``counts`` may give a term of a document in several rows.  Cells that fit MAX_CELL_BYTES go to
    the counts, larger ones are joined as the session chooses.
    """
    word_cells = reliable_checkpoint(word_cells)
    held = word_cells.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    hits = hit_counts(counts, F.broadcast(word_cells) if held <= MAX_CELL_BYTES else word_cells, cols)
    return blurred_histogram(dense_histogram(docs.select(doc), hits, rows * cols, doc))
