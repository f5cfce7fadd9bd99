"""Incremental placement and ingest (H1-H4) on Structured Streaming.

The reference polls its store in an endless loop for unplaced books.  Here
the append-only staging folder is a file stream; the checkpoint remembers
which files were consumed (the "unplaced" state), ``foreachBatch`` places
each micro-batch with the broadcast model and writes it under its own
``batch_id`` folder, so a replayed batch overwrites itself and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.operators.upsert import latest_per_key, write_batch
from shelfmap.session import scratch_path


def staged_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """H1 source: new parquet files of the staging path, with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_placement(stream: DataFrame, place: Callable[[DataFrame], DataFrame], sink: str,
                  checkpoint: str, where=None) -> None:
    """H1-H3: filter, place every micro-batch, write it idempotently; runs until caught up."""
    src = stream.where(where) if where is not None else stream

    def each(batch: DataFrame, batch_id: int) -> None:
        placed = place(batch)
        placed.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_ingest(stream: DataFrame, root: str, key: str, order: list[str], checkpoint: str,
               frozen: tuple[str, ...] = ("sha",)) -> None:
    """H4: continuous ingest of scraped items: each micro-batch folded per key under its own ``batch_id``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, root, batch_id, key, order, frozen)

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_keyed_ingest(stream: DataFrame, root: str, key: str, order: list[str], checkpoint: str,
                     frozen: tuple[str, ...] = ("sha",)) -> None:
    """H4 with the records held as state: each micro-batch writes the whole current record of the keys it touches."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    q = (latest_per_key(stream, key, order, frozen).writeStream.outputMode("update").foreachBatch(each)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def current_records(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The last record of each key that ``run_keyed_ingest`` wrote."""
    rows = spark.read.option("basePath", root).parquet(root)
    fields = [c for c in rows.columns if c not in (key, "batch_id")]
    last = F.max_by(F.struct(*fields), "batch_id").alias("last")
    return rows.groupBy(key).agg(last).select(key, *(F.col(f"last.{c}").alias(c) for c in fields))


def placed(spark: SparkSession, sink: str) -> DataFrame:
    """All placements written so far (``batch_id`` kept as a column)."""
    return spark.read.parquet(sink)


def stream_place_folder(spark: SparkSession, path: str, schema, place, where=None,
                        max_files: int | None = None) -> DataFrame:
    """Convenience: place a staging folder end to end in fresh scratch folders."""
    sink, ckpt = scratch_path(spark, "placed"), scratch_path(spark, "placed-ckpt")
    run_placement(staged_stream(spark, path, schema, max_files), place, sink, ckpt, where)
    return placed(spark, sink).drop("batch_id")


def run_placement_updates(stream: DataFrame, place: Callable[[DataFrame], DataFrame], books: str,
                          members_log: str, checkpoint: str, where=None, key: str = "sha",
                          cells: DataFrame | None = None) -> None:
    """H1-H3: place each micro-batch, then the two keyed updates.

    1. the book's cell: ``(key, bmu_col, bmu_row)`` as a batch of the stored table ``books``
       (``read_batches``), replaced when the batch id comes again;
    2. the cell's member set: the batch's ``(bmu_col, bmu_row, key)`` rows under
       ``members_log/batch_id=<id>`` (overwrite, so a replay rewrites the same rows).
    Cell sets are the distinct rows of the log (``cell_set_add`` semantics).  With ``cells``
    ``(bmu_col, bmu_row)``, only members of those existing cells are logged; the book keeps its
    cell either way.
    """
    src = stream.where(where) if where is not None else stream

    def each(batch: DataFrame, batch_id: int) -> None:
        placed = place(batch).select(key, "bmu_col", "bmu_row").persist()
        listed = placed.join(cells, ["bmu_col", "bmu_row"], "left_semi") if cells is not None else placed
        listed.write.mode("overwrite").parquet(f"{members_log}/batch_id={batch_id}")
        write_batch(placed.withColumn("arrived", F.lit(batch_id)), books, batch_id, key, ["arrived"], frozen=())
        placed.unpersist()

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def cell_sets(spark: SparkSession, members_log: str, key: str = "sha") -> DataFrame:
    """Distinct ``(bmu_col, bmu_row, key)`` of a member log: the cells' member sets."""
    return spark.read.parquet(members_log).select("bmu_col", "bmu_row", key).distinct()
