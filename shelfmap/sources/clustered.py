"""Books laid out by map cell (A17, D1, G14): bucketed tables, so that same-cell work moves no book.

All books of a cell lie in one bucket.  Ranking inside cells and joining books with their
cell's list then need no exchange; the price is that the largest cell is read by one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

CELL = ("bmu_col", "bmu_row")


def write_by_cell(books: DataFrame, path: str, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """Store ``books`` under ``path``, bucketed and sorted by cell, and return the table.

    ``name`` is the catalogue's name for it (a fresh one by default); books without a cell
    are kept, in one bucket of their own kind.
    """
    spark = books.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"books_by_cell_{uuid.uuid4().hex}"
    (books.repartition(buckets, *CELL).write.mode("overwrite").bucketBy(buckets, *CELL).sortBy(*CELL)
     .option("path", path).saveAsTable(name))
    return spark.table(name)
