"""Pages to stored books (A8-A14 into A16): extractors, housekeeping, one declared schema, keyed upsert.

Each site's extractor gives the fields it finds; ``typed`` brings them to the staging schema,
so rows of all sites make one table, and ``store_books`` folds them into the stored one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmap.functions.scalars import last_segment, page_url
from shelfmap.operators.upsert import upsert
from shelfmap.schema import STAGING_SCHEMA
from shelfmap.sources.extract import housekeeping, html_table_fields, metadata_fields, page_json_fields, take_first


def typed(rows: DataFrame) -> DataFrame:
    """The staging schema's columns in its order and types.

    Missing columns are NULL, others are dropped, a type that doesn't fit is refused; empty
    texts become NULL (absent fields).  Rows without a key are left out.
    """
    texts = {f.name: take_first(F.col(f.name)) for f in STAGING_SCHEMA.fields
             if f.dataType == T.StringType() and f.name in rows.columns}
    return rows.withColumns(texts).where(F.col("book_id").isNotNull()).to(STAGING_SCHEMA)


def json_page_records(pages: DataFrame, project: str, server: str, at: Column | None = None,
                      spider: str = "goodreads") -> DataFrame:
    """``(page_id, url, html)`` pages with embedded JSON; pages without a work are skipped."""
    found = page_json_fields(pages, keep=("url",))
    found = found.withColumn("url", page_url("https://www.goodreads.com/book/show/", last_segment(F.col("url"))))
    return typed(housekeeping(found, project, spider, server, at=at))


def table_page_records(pages: DataFrame, project: str, server: str, at: Column | None = None,
                       spider: str = "gutenberg") -> DataFrame:
    """``(page_id, url, html)`` pages with a catalogue table."""
    found = html_table_fields(pages, keep=("url",))
    ident = last_segment(F.col("url"))
    found = found.withColumns({"book_id": F.concat(F.lit("gb_"), ident), "url": page_url("https://www.gutenberg.org/ebooks/", ident)})
    return typed(housekeeping(found, project, spider, server, at=at))


def metadata_records(responses: DataFrame, project: str, server: str, at: Column | None = None,
                     spider: str = "archive") -> DataFrame:
    """Stored metadata responses ``(json)``."""
    return typed(housekeeping(metadata_fields(responses), project, spider, server, at=at))


def all_records(*sites: DataFrame) -> DataFrame:
    """Records of several sites as one batch."""
    return functools.reduce(lambda a, b: a.unionByName(b), sites)


def store_books(stored: DataFrame, records: DataFrame) -> DataFrame:
    """The stored books after a batch; the latest record per book wins per field, ``sha`` stays."""
    return upsert(stored, records, "book_id", ["date"]).to(STAGING_SCHEMA)
