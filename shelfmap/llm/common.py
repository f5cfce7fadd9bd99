"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space and words of every contract (ASCII only).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

# Members of a regular expression class: Unicode white space, as tokenizer patterns see it.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Rows per Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = "256"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(""))


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds few texts at once.

    A session setting, because Spark reads it when the plan runs; only batch sizes
    change, never results.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, with underscores appended until no input column has that name (any case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


_KEPT: dict = {}


def kept(key, make):
    """State that a Python worker keeps over its tasks, such as a tokenizer and its cache.

    A worker holds the state of one operator at a time: another operator's is let go first.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class TwoGenerations:
    """A bounded cache: at most ``2 * size`` entries, the least recently filled half goes first."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def room(self) -> dict:
        """The dictionary to read and fill; call once per document."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        return self.young

    def promote(self, key):
        """The value of ``key`` from the older half, copied to the younger, or None."""
        value = self.old.get(key)
        if value is not None:
            self.young[key] = value
        return value


def per_text(schema: str, make, *columns: Column) -> Column:
    """A struct column computed from text columns in Arrow batches.

    ``make()`` runs once per task and returns a function from lists (one per column,
    nulls as None) to a pandas DataFrame with the fields of ``schema``.  The function is
    marked non-deterministic so that Spark evaluates it once per row, also under filters.
    """
    def run(batches):
        work = make()
        for batch in batches:
            series = batch if isinstance(batch, tuple) else (batch,)
            yield work(*[[None if v is None or v != v else v for v in s] for s in series])

    if len(columns) == 1:
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run(batches)
        fn = one
    else:
        def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            yield from run(batches)
        fn = many
    # String annotations are not resolvable here, so the types are set as objects.
    fn.__annotations__ = {"batches": Iterator[pd.Series] if len(columns) == 1 else Iterator[tuple[pd.Series, ...]],
                          "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(fn, schema).asNondeterministic()(*columns)


def held_out(ident: Column | str) -> Column:
    """Whether crc32 of the identifier's text is divisible by 5; a null identifier is never held out."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, most: int, rows: int | None = None) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of ``key`` (all rows if there are fewer)."""
    rows = df.count() if rows is None else rows
    if rows <= most:
        return df
    cut = int((most / rows) * (1 << 31))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 31)) < cut).limit(most)
