"""Chunked sitemap sink (A19) and crawl work lists.

Numbering every book densely needs a total order, but a global window runs
in one task.  ``dense_index`` sorts once (range-partitioned), materialises the
sorted rows, counts rows per partition (one row per partition to the driver)
and adds each partition's offset - the same numbers, computed in parallel.
Each output file then holds at most ``chunk`` URLs, so grouping by file is
bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.operators.serve import hash_order
from shelfmap.sources.files import write_files
from shelfmap.session import reliable_checkpoint

CHUNK = 25_000                    # fixed value: URLs per sitemap file
INDEX_LIMIT = 50_000              # sitemap protocol: entries per index document
XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"
LOW_BITS = (1 << 33) - 1


def dense_index(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """1-based dense row number over a total order, without a single-task window."""
    spark = df.sparkSession
    tagged = reliable_checkpoint(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets.append((int(r["_p"]), total))
        total += int(r["_n"])
    off = spark.createDataFrame(offsets or [(0, 0)], "_p long, _off long")
    return (tagged.join(F.broadcast(off), part == F.col("_p"))
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(LOW_BITS)) + 1)
            .drop("_mid", "_p", "_off"))


def sitemap_entries(spark: SparkSession, books: DataFrame, base_url: str, static_urls: list[tuple[str, str]],
                    lastmod: str, chunk: int = CHUNK, key: str = "sha", seed: int = 42,
                    priority: str = "0.80") -> DataFrame:
    """Static URLs then one URL per book (seeded shuffle order): ``(file_num, pos, loc, lastmod, priority)``."""
    ranked = dense_index(books.select(key), [hash_order(F.col(key), seed), F.col(key)])
    pos = F.col("rn") + len(static_urls) - 1                        # 0-based position in the stream
    book_rows = ranked.select(pos.alias("pos"),
                              F.concat(F.lit(base_url), F.col(key).cast("string")).alias("loc"),
                              F.lit(lastmod).alias("lastmod"), F.lit(priority).alias("priority"))
    statics = spark.createDataFrame([(i, loc, lastmod, prio) for i, (loc, prio) in enumerate(static_urls)],
                                    "pos long, loc string, lastmod string, priority string")
    out = statics.unionByName(book_rows)
    return out.withColumn("file_num", (F.floor(F.col("pos") / chunk) + 1).cast("int"))


def sitemap_files(entries: DataFrame) -> DataFrame:
    """One XML document per file (at most ``chunk`` URLs per group)."""
    url = F.concat(F.lit("  <url>\n    <loc>"), F.col("loc"), F.lit("</loc>\n    <lastmod>"), F.col("lastmod"),
                   F.lit("</lastmod>\n    <priority>"), F.col("priority"), F.lit("</priority>\n  </url>\n"))
    per_file = entries.groupBy("file_num").agg(
        F.array_sort(F.collect_list(F.struct("pos", url.alias("x")))).alias("u"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{XMLNS}">\n'
    return per_file.select("file_num", F.concat(F.lit(head), F.array_join(F.transform("u", lambda s: s["x"]), ""),
                                                F.lit("</urlset>\n")).alias("xml"))


def sitemap_index(books: DataFrame, static_urls: list[tuple[str, str]], site: str, lastmod: str,
                  chunk: int = CHUNK) -> DataFrame:
    """Index rows for the files that exist (deviation V6): ``(file_num, loc, lastmod)``.

    Positions are dense, so the files follow from the number of books: one count, no sort.
    """
    files = F.ceil((F.count(F.lit(1)) + F.lit(len(static_urls))) / F.lit(chunk)).cast("int")
    return (books.agg(files.alias("files")).where("files > 0")
            .select(F.explode(F.sequence(F.lit(1), F.col("files"))).alias("file_num"))
            .select("file_num", F.concat(F.lit(site), F.lit("sitemap_books_"), F.col("file_num").cast("string"),
                                         F.lit(".xml")).alias("loc"), F.lit(lastmod).alias("lastmod")))


def index_xml(index: DataFrame, per_index: int = INDEX_LIMIT) -> DataFrame:
    """Index documents ``(index_num, xml)``, at most ``per_index`` files each (protocol limit)."""
    item = F.concat(F.lit("  <sitemap>\n    <loc>"), F.col("loc"), F.lit("</loc>\n    <lastmod>"), F.col("lastmod"),
                    F.lit("</lastmod>\n  </sitemap>\n"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{XMLNS}">\n'
    grouped = (index.withColumn("index_num", (F.floor((F.col("file_num") - 1) / per_index) + 1).cast("int"))
               .groupBy("index_num").agg(F.array_sort(F.collect_list(F.struct("file_num", item.alias("x")))).alias("u")))
    return grouped.select("index_num", F.concat(F.lit(head), F.array_join(F.transform("u", lambda s: s["x"]), ""),
                                                F.lit("</sitemapindex>\n")).alias("xml"))


def write_sitemaps(entries: DataFrame, index: DataFrame, root: str, per_index: int = INDEX_LIMIT) -> DataFrame:
    """``sitemap_books_<n>.xml`` per file and ``sitemap_<n>.xml`` per index document, as named files under ``root``.

    Returns the manifest (``name, bytes, sha256``), which is written last.
    """
    def named(rows: DataFrame, prefix: str, number: str) -> DataFrame:
        return rows.select(F.concat(F.lit(prefix), F.col(number).cast("string"), F.lit(".xml")).alias("name"), F.col("xml").alias("text"))

    every = named(sitemap_files(entries), "sitemap_books_", "file_num").unionByName(
        named(index_xml(index, per_index), "sitemap_", "index_num"))
    return write_files(every, root)


# --- work lists ----------------------------------------------------------------------------

def crawl_list(spark: SparkSession, start: int, end: int, template: str) -> DataFrame:
    """``(id, url)`` for ids ``start .. end-1``; ``template`` has one ``%d``."""
    return spark.range(start, end).select(F.col("id"), F.format_string(template, F.col("id")).alias("url"))


def repair_list(books: DataFrame, spider: str, base_url: str, seed: int = 42) -> DataFrame:
    """Books of one spider without a title -> ``(book_id, url)``, seeded shuffle order."""
    todo = books.where((F.col("spider") == spider) & F.nullif(F.col("title"), F.lit("")).isNull())
    return (todo.select(F.col("sha").alias("book_id"),
                        F.concat(F.lit(base_url), F.col("sha").cast("string")).alias("url"))
            .orderBy(hash_order(F.col("book_id"), seed), F.col("book_id")))


def cover_list(books: DataFrame, spider: str = "goodreads") -> DataFrame:
    """``(sha, image_url)`` of one spider's books with an image."""
    return books.where((F.col("spider") == spider) & F.col("image_url").isNotNull()).select("sha", "image_url")
