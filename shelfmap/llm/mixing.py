"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Every document has a 60-bit hash.  Per source, sizes are summed by the hash's leading
bits; the running sum names the bucket in which the source's budget ends, and only
that bucket is summed again by the next bits, until it holds one hash value.  The
documents below the resulting threshold are taken: no sort, and no shuffle of
documents.  A target above a source's size is met by whole repeats plus one
thresholded repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import WORD_CLASS, free_name, text_or_empty

HASH_BITS = 60
LEVEL_BITS = 12
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
# Sources up to this count are broadcast (under 10 MB); beyond it a salted join is used.
BROADCAST_SOURCES = 100_000
JOIN_SALTS = 64


def text_size(text: Column | str) -> Column:
    """Number of words (maximal runs without ASCII white space); null: 0."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD_CLASS)).cast("long")


def mix_hash(ident: Column, seed: str = "mix") -> Column:
    """60 leading bits of the md5 of identifier and seed; a null identifier hashes as 'null'."""
    key = F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("null")), F.lit(seed))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """One row per source: ``source, source_size, target, repeats, budget``.

    Weights repeat over the sources in code point order, null last.  A target stops at
    MAX_REPEATS times the source's size and the excess is shared again by weight; that
    fixed point is ``min(cap, level * weight)`` for one common level, found from running
    sums over the sources ordered by cap per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    full = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(MAX_REPEATS))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    full = (full.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("open_w", F.sum("w").over(after))
            .withColumn("fits", F.col("cap") * F.col("open_w") <= (F.col("total") - F.col("capped")) * F.col("w"))
            .withColumn("level", F.first(F.when(~F.col("fits"), (F.col("total") - F.col("capped")) / F.col("open_w")),
                                         ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding,
                                                                                 Window.unboundedFollowing))))
    target = F.when(F.col("fits"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    full = full.withColumn("target", target)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (full.withColumn("repeats", repeats.cast("long"))
            .withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
            .select("source", "source_size", "target", "repeats", "budget"))


def with_source_values(rows: DataFrame, values: DataFrame, n_sources: int, on: Column) -> DataFrame:
    """Join one-row-per-source values: broadcast up to BROADCAST_SOURCES, else salted over JOIN_SALTS."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(values), on)
    salt = F.pmod(F.col("h"), F.lit(JOIN_SALTS))
    spread = values.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return rows.withColumn("r_salt", salt).join(spread, on & (F.col("r_salt") == F.col("v_salt")))


def thresholds(sized: DataFrame, share: float = 1.0) -> tuple[DataFrame, int]:
    """``sized`` (source, size, h) -> per source target, repeats and hash threshold, and the source count."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = reliable_checkpoint(source_targets(sizes, share))
    n_sources = state.count()
    found = state.select(F.col("source").alias("v_source"), F.lit(0).cast("long").alias("prefix"),
                         F.col("budget").alias("left"))
    below = Window.partitionBy("source").orderBy("bucket")
    for low in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        on = F.col("source").eqNullSafe(F.col("v_source")) & (F.shiftright("h", low + LEVEL_BITS) == F.col("prefix"))
        hist = (with_source_values(sized, found, n_sources, on)
                .groupBy("source", F.shiftright("h", low).alias("bucket"))
                .agg(F.sum("size").alias("in_bucket"), F.first("left").alias("left"),
                     F.min("h").alias("h_min"), F.max("h").alias("h_max")))
        edge = (hist.withColumn("upto", F.sum("in_bucket").over(below))
                .where(F.col("upto") > F.col("left"))
                .groupBy("source").agg(F.min(F.struct("bucket", "in_bucket", "upto", "left", "h_min", "h_max")).alias("e")))
        found = reliable_checkpoint(edge.select(
            F.col("source").alias("v_source"), F.col("e.bucket").alias("prefix"),
            (F.col("e.left") - F.col("e.upto") + F.col("e.in_bucket")).alias("left"),
            F.col("e.in_bucket").alias("in_bucket"), F.col("e.h_min").alias("h_min"), F.col("e.h_max").alias("h_max")))
        if found.where("h_min < h_max").limit(1).count() == 0:
            break
    # One hash value is left in the bucket where the budget ends: take it if that ends nearer the budget.
    edge = found.select("v_source", (F.col("h_min") + F.when(F.col("in_bucket") < 2 * F.col("left"), 1).otherwise(0))
                        .alias("threshold"))
    full = state.join(edge, state["source"].eqNullSafe(edge["v_source"]), "left")
    return full.select(F.col("source").alias("v_source"), "source_size", "target", "repeats",
                       F.coalesce("threshold", F.lit(0)).alias("threshold")), n_sources


def mix(df: DataFrame, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """All input rows and columns plus ``size, source_size, target, copies, taken``.

    ``copies`` is how often the mix takes the document, ``taken`` its words, repeats
    counted.  Null text: size 0; null source: a source of its own, last in order; a
    source without words has target 0; rows with equal identifiers share a hash and are
    taken together; empty input: no rows.
    """
    result = ("size", "source_size", "target", "copies", "taken")
    sized = df.select(F.col(source_col).alias("source"), text_size(text_col).alias("size"),
                      mix_hash(F.col(id_col)).alias("h"))
    values, n_sources = thresholds(reliable_checkpoint(sized), share)
    inner = df.drop(*result)
    names = inner.columns
    data = inner.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("source"),
                        text_size(text_col).alias("size"), mix_hash(F.col(id_col)).alias("h"))
    joined = with_source_values(data, values, n_sources, F.col("source").eqNullSafe(F.col("v_source")))
    copies = F.col("repeats") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return (joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
            .select("row.*", *result))


def mixed_documents(df: DataFrame, share: float = 1.0, **columns: str) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with the input's columns."""
    n = free_name(df.columns, "copy")
    taken = mix(df, share, **columns).where("copies > 0")
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select(*[F.col(f"`{c}`") for c in df.columns])
