"""Table scans (A4-A6): parquet reads with pushed filters and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table ``<root>/<name>.parquet``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def scan_books(books: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A4: filter then project; Catalyst pushes both into the parquet scan."""
    out = books if where is None else books.where(where)
    return out.select(*columns) if columns else out


def training_extract(books: DataFrame, min_summary: int = 400, language: str | None = "English",
                     spider: str | None = "goodreads") -> DataFrame:
    """A5: training rows ``(sha, title, summary)``; summary of ``min_summary`` code points or more."""
    cond = F.col("summary").isNotNull() & (F.length("summary") >= min_summary)
    if language is not None:
        cond &= F.col("language") == language
    if spider is not None:
        cond &= F.col("spider") == spider
    return books.where(cond).select("sha", "title", "summary")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a required extract is empty (the reference errors out too)."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def debug_lookup(books: DataFrame, ids: DataFrame, key: str = "sha") -> DataFrame:
    """Books whose key is in ``ids`` and that have a summary (semi join, not a giant IN list)."""
    return (books.join(ids.select(key).distinct(), key, "left_semi")
            .where(F.col("summary").isNotNull())
            .select("book_id", "title", "author", "summary"))


def dealt(df: DataFrame, setting: str = "spark.shelfmap.textPartitions") -> DataFrame:
    """Rows dealt over the number of partitions that the session names; unchanged when it names none.

    For tables stored as one small file, whose scan is a single task.  Tables of many
    splits need no setting: the reader splits files by ``spark.sql.files.maxPartitionBytes``.
    """
    n = df.sparkSession.conf.get(setting, None)
    return df.repartition(int(n)) if n else df
