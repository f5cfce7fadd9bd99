"""Serving queries (group C) and same-cell similar books.

Search, paging and sampling are sort + limit plans (TakeOrderedAndProject);
best-edition dedupe is a partial/final ``min_by`` aggregate, so a title that
holds a third of all rows is combined map-side instead of landing whole in
one task; similar books rank each cell's top-k with a window group limit that
Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmap.functions.predicates import build_predicate, phrase_match
from shelfmap.functions.text import strip

MAX_ROWS = 50          # fixed value: rows per page / query at most
DEFAULT_TIE = "sha"


def order_columns(order_by: str | None, tie: str = DEFAULT_TIE) -> list[Column]:
    """``"-field"`` descending (NULL last), ``"field"``/``"+field"`` ascending (NULL first)."""
    cols: list[Column] = []
    if order_by:
        name = order_by.lstrip("+-")
        cols.append(F.col(name).desc_nulls_last() if order_by.startswith("-")
                    else F.col(name).asc_nulls_first())
    if tie and (not order_by or order_by.lstrip("+-") != tie):
        cols.append(F.col(tie).asc())
    return cols


def capped(n: int | None, cap: int = MAX_ROWS) -> int:
    """C4: ``min(per_page, cap)``; default is the cap."""
    return cap if n is None else max(0, min(int(n), cap))


def all_books(books: DataFrame, filters: dict | None = None, order_by: str | None = None,
              page: int = 1, per_page: int | None = None, columns: list[str] | None = None,
              cap: int = MAX_ROWS, tie: str = DEFAULT_TIE) -> DataFrame:
    """Filtered, ordered, paged search (B*, C1, C3-C5)."""
    n = capped(per_page, cap)
    out = books.where(build_predicate(filters)).orderBy(*order_columns(order_by, tie))
    skip = max(0, (int(page) - 1) * n)
    if skip:
        out = out.offset(skip)
    out = out.limit(n)
    return out.select(*columns) if columns else out


def drop_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exclusion projection."""
    return df.drop(*fields)


def hash_order(key: Column, seed: int | str) -> Column:
    """Seeded, engine-independent shuffle key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def random_books(books: DataFrame, n: int = 10, seed: int = 42, order_by: str | None = None,
                 key: str = DEFAULT_TIE) -> DataFrame:
    """Exactly ``n`` pseudo-random rows (seeded hash order), then sorted."""
    picked = books.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)
    return picked.orderBy(*order_columns(order_by, key)) if order_by else picked


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Whole-table seeded shuffle order."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key))


def title_search(books: DataFrame, phrase: str, n: int | None = None,
                 columns=("sha", "title", "author", "ratings_count")) -> DataFrame:
    """Phrase search on title, most-rated first, capped page."""
    return (books.where(phrase_match(F.col("title"), phrase))
            .orderBy(*order_columns("-ratings_count"))
            .limit(capped(n)).select(*columns))


def book_detail(books: DataFrame, shas: DataFrame, key: str = DEFAULT_TIE) -> DataFrame:
    """C10 (batch form): one row per requested key."""
    return books.join(shas.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def best_per_title(df: DataFrame, ignore_title: str | Column | None = None,
                   rating: str = "ratings_count", pos: str | None = None,
                   tie: str = DEFAULT_TIE) -> DataFrame:
    """C8/E-9: one row per trimmed title, the most-rated (NULL loses, first seen wins ties).

    ``pos`` is the input order; without it the order is ``rating desc, tie``.
    Rows with a NULL title or a title equal to ``ignore_title`` (before stripping)
    are dropped.  Output keeps the input columns plus ``title_key`` and, with ``pos``,
    ``first_pos``: the first position of any row with that title, by which results
    come in order of first appearance.  Aggregation is partial/final, so a hot title
    never sits whole in one task.
    """
    keep = F.col("title").isNotNull()
    if ignore_title is not None:
        ig = ignore_title if isinstance(ignore_title, Column) else F.lit(ignore_title)
        keep &= ~F.col("title").eqNullSafe(ig)
    order_key = F.struct(
        F.col(rating).isNull().alias("k0"),
        (-F.col(rating)).alias("k1"),
        *( [F.col(pos).alias("k2")] if pos else [] ),
        F.col(tie).alias("k3"),
    )
    cols = df.columns
    first = [F.min(pos).alias("first_pos")] if pos else []
    winners = (df.where(keep)
               .withColumn("title_key", strip("title"))
               .groupBy("title_key")
               .agg(F.min_by(F.struct(*cols), order_key).alias("w"), *first))
    return winners.select("title_key", *[F.col(f"w.{c}").alias(c) for c in cols], *(["first_pos"] if pos else []))


def cell_top(books: DataFrame, k: int = MAX_ROWS, rating: str = "ratings_count",
             tie: str = DEFAULT_TIE, cell=("bmu_col", "bmu_row")) -> DataFrame:
    """Top ``k`` books of every cell by rating (desc, NULL last), with rank ``rk``.

    ``row_number() <= k`` plans a WindowGroupLimit on both sides of the shuffle,
    so each map task ships at most ``k`` rows per cell.
    """
    w = Window.partitionBy(*cell).orderBy(F.col(rating).desc_nulls_last(), F.col(tie).asc())
    placed = books.where(F.col(cell[0]).isNotNull() & F.col(cell[1]).isNotNull())
    return placed.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def similar_books(books: DataFrame, sources: DataFrame | None = None, k: int = MAX_ROWS,
                  columns=("sha", "title", "author", "ratings_count")) -> DataFrame:
    """D1 + C8: for each source book, the best edition per title among the top ``k`` of its cell.

    ``sources``: books to answer for (default: every placed book).  Each cell's top ``k``
    become one array, so a source row meets one row of its cell, and title choice
    happens inside that row: no pair is shuffled.  The join carries no hint: Spark
    broadcasts the arrays when their measured size allows, and otherwise joins by
    cell, where adaptive skew handling splits a hot cell's sources.
    Output: ``src_sha, sha, title, author, ratings_count, rk`` with ``rk`` the
    first-appearance position in the cell list (NULL-cell sources give no rows).
    """
    src = (sources if sources is not None else books).select(
        F.col("sha").alias("src_sha"), F.col("title").alias("src_title"), "bmu_col", "bmu_row"
    ).where(F.col("bmu_col").isNotNull() & F.col("bmu_row").isNotNull())
    entry = F.struct("rk", *columns, strip("title").alias("title_key"))
    lists = (cell_top(books, k).groupBy("bmu_col", "bmu_row")
             .agg(F.array_sort(F.collect_list(entry)).alias("top")))
    pairs = src.join(lists, ["bmu_col", "bmu_row"])
    fit = F.filter("top", lambda b: b["title"].isNotNull() & ~b["title"].eqNullSafe(F.col("src_title")))
    pairs = pairs.select("src_sha", fit.alias("fit"), F.transform(fit, lambda b: b["title_key"]).alias("keys"))
    best = F.filter("fit", lambda b, i: F.array_position(F.col("keys"), b["title_key"]) == i + 1)
    return (pairs.select("src_sha", F.inline(best))
            .select("src_sha", *columns, "rk"))
