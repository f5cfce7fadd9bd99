"""Stand-in tables that map the supplied parquet onto the book data model.

Each stand-in has a DataFrame builder and the matching DuckDB CTE text so
that oracle SQL reads exactly the same derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.functions.arrays import explode_indexed, normalize_sum
from shelfmap.sources.tables import dealt, read_table

GRID_ROWS, GRID_COLS = 10, 12          # codebook stand-in: 120 units
HIST_ROWS, HIST_COLS = 15, 21          # word-map grid for hit histograms


def bookdocs(spark: SparkSession, root: str) -> DataFrame:
    """``documents`` as books: title = first line, summary = whole text."""
    d = dealt(read_table(spark, root, "documents"))
    return d.select(
        F.col("doc_id").alias("sha"),
        F.trim(F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("summary"),
        F.col("lang").alias("language"),
        F.col("source").alias("spider"),
    )


BOOKDOCS_SQL = """bookdocs AS (
  SELECT doc_id AS sha, trim(split_part(text, chr(10), 1)) AS title, text AS summary,
         lang AS language, source AS spider
  FROM documents)"""


def bookparts(spark: SparkSession, root: str) -> DataFrame:
    """``part`` as books; ratings = line items per part (NULL if none or key % 7 = 0)."""
    p = read_table(spark, root, "part")
    n = (read_table(spark, root, "lineitem").groupBy("l_partkey")
         .agg(F.count(F.lit(1)).alias("n")))
    return (p.join(n, p.p_partkey == n.l_partkey, "left")
            .select(
                F.col("p_partkey").alias("sha"),
                F.col("p_name").alias("title"),
                F.col("p_brand").alias("author"),
                F.when(F.col("p_partkey") % 7 != 0, F.col("n")).cast("long").alias("ratings_count"),
                (F.col("p_size") % 12).cast("int").alias("bmu_col"),
                (F.col("p_partkey") % 10).cast("int").alias("bmu_row"),
            ))


BOOKPARTS_SQL = """bookparts AS (
  SELECT p.p_partkey AS sha, p.p_name AS title, p.p_brand AS author,
         CAST(CASE WHEN p.p_partkey % 7 <> 0 THEN n.n END AS BIGINT) AS ratings_count,
         CAST(p.p_size % 12 AS INTEGER) AS bmu_col, CAST(p.p_partkey % 10 AS INTEGER) AS bmu_row
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) n
    ON p.p_partkey = n.l_partkey)"""


def training_docs(spark: SparkSession, root: str) -> DataFrame:
    """A5 on bookdocs: English rows with a summary of 400 code points or more."""
    from shelfmap.sources.tables import training_extract
    return training_extract(bookdocs(spark, root), 400, language="en", spider=None)


TRAINING_SQL = BOOKDOCS_SQL + """,
training AS (
  SELECT sha, title, summary FROM bookdocs
  WHERE summary IS NOT NULL AND length(summary) >= 400 AND language = 'en')"""


def dist(spark: SparkSession, root: str) -> DataFrame:
    """``embeddings`` squared and normalised: a probability vector per row."""
    e = read_table(spark, root, "embeddings")
    sq = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    return e.select(F.col("vec_id").alias("sha"), "label", normalize_sum(sq).alias("p"))


DIST_SQL = """dist AS (
  SELECT vec_id AS sha, label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x
           / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS p
  FROM embeddings)"""


def codebook(spark: SparkSession, root: str, rows: int = GRID_ROWS, cols: int = GRID_COLS, vecs: DataFrame | None = None) -> DataFrame:
    """A fixed codebook from all ``embeddings`` (or ``vecs``): unit ``sha % units`` holds the mean of its rows."""
    vecs = vectors(spark, root) if vecs is None else vecs
    unit = (F.col("sha") % (rows * cols)).cast("int")
    mean = (vecs.select(unit.alias("unit"), explode_indexed(F.col("x")))
            .groupBy("unit", "i").agg(F.round(F.avg("v"), 9).alias("v")))
    return (mean.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("iv"))
            .select("unit",
                    (F.col("unit") / cols).cast("int").alias("row"),
                    (F.col("unit") % cols).cast("int").alias("col"),
                    F.transform("iv", lambda s: s["v"]).alias("w")))


CODEBOOK_SQL = f"""codebook AS (
  SELECT unit, CAST(unit // {GRID_COLS} AS INTEGER) AS "row", CAST(unit % {GRID_COLS} AS INTEGER) AS col,
         list(v ORDER BY i) AS w
  FROM (SELECT unit, i, round(avg(v), 9) AS v
        FROM (SELECT CAST(vec_id % {GRID_ROWS * GRID_COLS} AS INTEGER) AS unit, unnest(CAST(embedding AS DOUBLE[])) AS v,
                     generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY unit, i) GROUP BY unit)"""


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """``embeddings`` as ``(sha, x ARRAY<DOUBLE>)`` for map placement."""
    e = read_table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("sha"), F.col("embedding").cast("array<double>").alias("x"))


VECTORS_SQL = """vectors AS (SELECT vec_id AS sha, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
