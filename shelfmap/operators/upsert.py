"""Keyed upsert without MERGE.

``merge_batch`` folds a batch of partial records per key - per field the last
non-NULL value in batch order, the frozen field from the first record - with
partial/final ``max_by`` / ``min_by`` aggregates, so a key that holds a third
of the batch is combined map-side.  ``upsert`` applies that to a stored table
with one full outer join on the key (both sides unique per key).

A stored table is a folder of folded batches, ``batch_id=<n>`` each: a batch that is replayed
writes its own folder again, and reading folds the folders per key.  ``latest_per_key`` keeps
the folded record of each key as streaming state instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge_batch(batch: DataFrame, key: str, order: list[str], frozen: tuple[str, ...] = ("sha",)) -> DataFrame:
    """One row per key: latest non-NULL value per field, frozen fields from the first row."""
    ord_key = F.struct(*[F.col(c) for c in order])
    aggs = []
    for c in batch.columns:
        if c == key:
            continue
        if c in frozen:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ord_key)).alias(c))
        else:
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ord_key)).alias(c))
    return batch.groupBy(key).agg(*aggs)


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: list[str],
           frozen: tuple[str, ...] = ("sha",), merged: bool = False) -> DataFrame:
    """Insert new keys; for known keys overwrite supplied fields, never frozen ones."""
    new = batch if merged else merge_batch(batch, key, order, frozen)
    cols = [c for c in stored.columns if c != key]
    extra = [c for c in new.columns if c not in stored.columns and c != key]
    o = stored.alias("o")
    n = new.alias("n")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    sel = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in cols:
        if c in new.columns:
            first, second = (f"o.{c}", f"n.{c}") if c in frozen else (f"n.{c}", f"o.{c}")
            sel.append(F.coalesce(F.col(first), F.col(second)).alias(c))
        else:
            sel.append(F.col(f"o.{c}").alias(c))
    sel += [F.col(f"n.{c}").alias(c) for c in extra]
    return out.select(*sel)


def write_batch(batch: DataFrame, root: str, batch_id: int, key: str, order: list[str],
                frozen: tuple[str, ...] = ("sha",)) -> None:
    """Fold a batch per key and store it under its own id; the same id again replaces it."""
    merge_batch(batch, key, order, frozen).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: T.StructType, key: str, frozen: tuple[str, ...] = ("sha",)) -> DataFrame:
    """The table that the batches under ``root`` make, one row per key, with the columns of ``schema``.

    Later batches win per field, frozen fields come from the first; a column that a batch
    lacks counts as NULL there.  The fold is one partial and one final aggregate.
    """
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(stored).option("basePath", root).parquet(root)
    return merge_batch(rows, key, ["batch_id"], frozen).select(*schema.names)


def fold_batches(spark: SparkSession, root: str, target: str, schema: T.StructType, key: str,
                 frozen: tuple[str, ...] = ("sha",)) -> int:
    """Write the folded batches of ``root`` as the first batch of ``target``; returns its id, the last one folded.

    Later batches then go to ``target``.  ``root`` is left as it is.
    """
    last = spark.read.option("basePath", root).parquet(root).agg(F.max("batch_id")).first()[0]
    read_batches(spark, root, schema, key, frozen).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={last}")
    return last


def latest_per_key(stream: DataFrame, key: str, order: list[str], frozen: tuple[str, ...] = ("sha",)) -> DataFrame:
    """H4 as keyed state: the current record of every key that a micro-batch touches.

    The state of a key holds, per field, the value with the greatest order (least for frozen
    fields) and that order, so records may come late or twice and in any split into
    batches.  Order columns are numbers or strings; the key itself and order columns keep
    the greatest values met.  Rows of a key are read in chunks, never as one frame.
    """
    fields = [f for f in stream.schema.fields if f.name != key]
    ranks = [stream.schema[o].dataType for o in order]
    state = T.StructType([T.StructField(f"{f.name}_{part}", kind) for f in fields
                          for part, kind in (("value", f.dataType), *((f"order{i}", r) for i, r in enumerate(ranks)))])
    width = 1 + len(order)

    def fold(at: tuple, pdfs: Iterator[pd.DataFrame], known: GroupState) -> Iterator[pd.DataFrame]:
        held = list(known.get) if known.exists else [None] * (width * len(fields))
        for pdf in pdfs:
            pdf = pdf.sort_values(order, kind="stable")
            for i, f in enumerate(fields):
                rows = pdf[pdf[f.name].notna()]
                if rows.empty:
                    continue
                first = f.name in frozen
                row = rows.iloc[0 if first else -1]
                now, was = tuple(row[o] for o in order), tuple(held[width * i + 1:width * (i + 1)])
                if held[width * i] is None or (now < was if first else now >= was):
                    held[width * i:width * (i + 1)] = [x.item() if hasattr(x, "item") else x for x in (row[f.name], *now)]
        known.update(tuple(held))
        yield pd.DataFrame([[at[0], *held[::width]]], columns=[key, *(f.name for f in fields)])

    out = T.StructType([stream.schema[key], *fields])
    return stream.groupBy(key).applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)
