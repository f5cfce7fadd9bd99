"""Scalar column functions (group S)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmap.functions.text import strip_ws  # noqa: F401  (S3)


def url_authority(url: Column) -> Column:
    """Authority of a URL as written (user, host and port), '' when it has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path of a URL as written; blanks and other unescaped characters are kept."""
    return F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def affiliate_link(url: Column, tag: str) -> Column:
    """``/gp/product/ID`` or ``/dp/ID`` -> ``http://host/<prefix>/ID/ref=nosim?tag=<tag>``, else NULL."""
    path, host = url_path(url), url_authority(url)

    def link(prefix: str) -> Column:
        product = F.regexp_extract(path, rf"(?s){prefix}([^/]*)", 1)
        return F.concat(F.lit("http://"), host, F.lit(prefix), product, F.lit(f"/ref=nosim?tag={tag}"))

    return (F.when(F.contains(path, F.lit("/gp/product/")), link("/gp/product/"))
             .when(F.contains(path, F.lit("/dp/")), link("/dp/")))


def year_prefix(d: Column) -> Column:
    """First four characters of a date string, NULL-safe."""
    return F.nullif(F.substring(d.cast("string"), 1, 4), F.lit(""))


def millis_to_ts(ms: Column) -> Column:
    """Epoch milliseconds -> timestamp, 0 -> NULL."""
    return F.timestamp_millis(F.nullif(ms.cast("long"), F.lit(0)))


def parse_month_day_year(s: Column) -> Column:
    """``Jan 5, 1999`` -> timestamp (NULL on a bad value)."""
    return F.try_to_timestamp(s, F.lit("MMM d, yyyy"))


def free_year(s: Column) -> Column:
    """First run of four digits as January 1 of that year, else NULL (deviation V5)."""
    y = (F.nullif(F.regexp_extract(s, r"(\d{4})", 1), F.lit(""))).try_cast("int")
    return F.make_date(y, F.lit(1), F.lit(1))


def last_segment(url: Column) -> Column:
    """Last ``/``-separated part of a URL."""
    return F.element_at(F.split(url, "/"), -1)


def page_url(prefix: str, id_col: Column, suffix: str = "") -> Column:
    """Page URL from an id."""
    return F.concat(F.lit(prefix), id_col.cast("string"), F.lit(suffix))


def join_words(v: Column) -> Column:
    """A string or an array of strings -> one space-joined string."""
    return F.array_join(v, " ")


def series_fields(series: Column) -> tuple[Column, Column]:
    """User position in the first series and whether there is any series; absent when empty."""
    return F.nullif(F.get(series, 0)["userPosition"], F.lit("")), F.when(F.size(series) > 0, True)
