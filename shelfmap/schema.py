"""Typed schemas of the book table, cells and model tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(),
                     T.DoubleType(), T.BooleanType(), T.TimestampType())

# Shop-link columns of the book record, in declaration order.
SHOP_LINK_COLUMNS = [
    "kindle_link", "amazon_link", "audible_link", "barnes_and_noble_link",
    "abe_books_link", "kobo_link", "google_play_link", "alibris_link",
    "indigo_link", "better_world_books_link", "indie_bounds_link",
    "thrift_books_link",
]

# Shop name as it appears in the page JSON -> link column.
SHOP_NAMES = {
    "Amazon": "amazon_link",
    "Audible": "audible_link",
    "Barnes & Noble": "barnes_and_noble_link",
    "AbeBooks": "abe_books_link",
    "Kobo": "kobo_link",
    "Google Play": "google_play_link",
    "Alibris": "alibris_link",
    "Indigo": "indigo_link",
    "Better World Books": "better_world_books_link",
    "IndieBound": "indie_bounds_link",
    "Thriftbooks": "thrift_books_link",
}

BOOK_FIELDS = [
    ("book_id", S, False), ("title", S, True), ("author", S, True),
    ("author_url", S, True), ("author_image_url", S, True),
    ("author_description", S, True), ("author_follower_count", L, True),
    ("is_gr_author", B, True), ("editor", S, True), ("credits", S, True),
    ("language", S, True), ("summary", S, True), ("image_url", S, True),
    ("genres", T.ArrayType(S), True), ("num_pages", L, True),
    ("format", S, True), ("isbn_10", S, True), ("release", TS, True),
    ("subject", S, True), ("web_url", S, True), ("series_position", S, True),
    ("is_series", B, True), ("average_rating", D, True),
    ("ratings_count", L, True), ("rating_one_count", L, True),
    ("rating_two_count", L, True), ("rating_three_count", L, True),
    ("rating_four_count", L, True), ("rating_five_count", L, True),
    ("text_reviews_count", L, True),
] + [(name, S, True) for name in SHOP_LINK_COLUMNS] + [
    ("url", S, True), ("sha", S, True), ("project", S, True),
    ("spider", S, True), ("server", S, True), ("bmu_col", I, True),
    ("bmu_row", I, True), ("date", TS, False),
]

BOOK_SCHEMA = T.StructType([T.StructField(n, t, nullable) for n, t, nullable in BOOK_FIELDS])

# Staging rows from extractors: same names, every field nullable.
STAGING_SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in BOOK_SCHEMA.fields])

CELL_SCHEMA = T.StructType([
    T.StructField("bmu_col", I, False),
    T.StructField("bmu_row", I, False),
    T.StructField("sha", S, True),
])

CODEBOOK_SCHEMA = T.StructType([
    T.StructField("unit", I, False),
    T.StructField("row", I, False),
    T.StructField("col", I, False),
    T.StructField("w", T.ArrayType(D), False),
])
