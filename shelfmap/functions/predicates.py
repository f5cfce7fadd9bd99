"""Filter predicates (group B) as Spark ``Column`` expressions.

``build_predicate`` turns a filter dict such as
``{"title__contains": "red widget", "ratings_count__gte": 10}`` into one
conjunction that Catalyst can push into the parquet scan.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters folded for phrase search.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
# Base letters by rule: first code point of the canonical decomposition
# (two letters without one are mapped explicitly).
UNACCENTED = "".join({"ł": "l", "ø": "o"}.get(c, unicodedata.normalize("NFD", c)[0]) for c in ACCENTED)

OPERATORS = ("in", "exists", "contains", "lt", "lte", "gt", "gte", "ne", "length_gte", "all")


def fold_accents(col: Column) -> Column:
    """Each accented letter's base letter; a letter stays a letter."""
    return F.translate(col, ACCENTED, UNACCENTED)


def blank_runs(col: Column) -> Column:
    """Every non-letter/digit run as one blank."""
    return F.regexp_replace(col, r"[^\p{L}\p{N}]+", " ")


def normalize_text(col: Column) -> Column:
    """Lower-case, fold accents, turn every non-letter/digit run into one blank."""
    return blank_runs(fold_accents(F.lower(col)))


def phrase_match(col: Column, phrase: str) -> Column:
    """Whole-word, case- and accent-insensitive phrase containment."""
    padded = F.concat(F.lit(" "), normalize_text(col), F.lit(" "))
    needle = F.concat(F.lit(" "), F.trim(normalize_text(F.lit(phrase))), F.lit(" "))
    return col.isNotNull() & F.contains(padded, needle)


def _split(key: str) -> tuple[str, str | None]:
    if "__" in key:
        field, op = key.rsplit("__", 1)
        if op in OPERATORS:
            return field, op
    return key, None


def field_predicate(key: str, value) -> Column | None:
    """One filter entry -> Column; ``None`` values are ignored."""
    if value is None:
        return None
    field, op = _split(key)
    col = F.col(field)
    if op is None:                                   # B1
        return col == F.lit(value)
    if op == "in":                                   # B2
        values = value if isinstance(value, (list, tuple, set)) else [value]
        return col.isin(list(values))
    if op == "exists":                               # B3
        return col.isNotNull() if _truthy(value) else col.isNull()
    if op == "contains":                             # B4
        return phrase_match(col, str(value))
    if op in ("lt", "lte", "gt", "gte"):            # B5
        return {"lt": col < value, "lte": col <= value, "gt": col > value, "gte": col >= value}[op]
    if op == "ne":                                   # B6: NULL rows are kept
        return ~col.eqNullSafe(F.lit(value))
    if op == "length_gte":                           # B7: code points
        return col.isNotNull() & (F.length(col) >= int(value))
    if op == "all":                                  # B8
        values = value if isinstance(value, (list, tuple, set)) else [value]
        return F.forall(F.array(*[F.lit(v) for v in values]), lambda v: v == col)
    raise ValueError(f"unknown filter operator in {key!r}")


def _truthy(value) -> bool:
    if isinstance(value, str):
        return value.strip().lower() == "true"
    return bool(value)


def build_predicate(filters: dict | None) -> Column:
    """AND of every non-None entry; an empty dict matches everything."""
    parts = [p for p in (field_predicate(k, v) for k, v in (filters or {}).items()) if p is not None]
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def search_args(title: str | None = None, summary: str | None = None, filters: dict | None = None) -> dict:
    """Top-level ``title`` / ``summary`` arguments become phrase searches on their own column."""
    out = dict(filters or {})
    if title is not None:
        out["title__contains"] = title
    if summary is not None:
        out["summary__contains"] = summary
    return out


def array_has_all(col: Column, values: list) -> Column:
    """B8 for an array field: every provided value is present."""
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), col)) == 0


# --- B11: relative time cut-off ---------------------------------------------

# Unit letter -> seconds (m = 30 days, M = minutes).
UNIT_SECONDS = {"s": 1, "M": 60, "h": 3600, "d": 86400, "w": 604800,
                "m": 30 * 86400, "y": 365 * 86400}


def relative_cutoff(spec: str, now: datetime) -> datetime | None:
    """``"3d"`` -> ``now - 3 days`` truncated to the hour; None for a bad spec."""
    m = re.fullmatch(r"(\d+)([smMyhdw])", spec or "")
    if not m:
        return None
    cut = now - timedelta(seconds=int(m.group(1)) * UNIT_SECONDS[m.group(2)])
    return cut.replace(minute=0, second=0, microsecond=0)


def relative_cutoff_col(spec: Column, now: Column) -> Column:
    """Column form of ``relative_cutoff`` for a table of specs."""
    n = (F.regexp_extract(spec, r"^(\d+)([smMyhdw])$", 1)).try_cast("long")
    unit = F.regexp_extract(spec, r"^(\d+)([smMyhdw])$", 2)
    secs = F.coalesce(*[F.when(unit == F.lit(u), F.lit(s)) for u, s in UNIT_SECONDS.items()])
    return F.when(n.isNotNull(), F.date_trunc("hour", F.timestamp_seconds(F.unix_timestamp(now) - n * secs)))


# --- B12-B14: request parsing and matching ------------------------------------

def query_param(url: Column, key: str, kind: str = "string") -> Column:
    """Typed query-string parameter, NULL on a bad value."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    if kind == "boolean":
        low = F.lower(raw)
        return F.when(low == "true", True).when(low == "false", False)
    if kind == "year":
        y = (raw).try_cast("int")
        return F.when((y >= 0) & (y <= 9999), y)
    return raw if kind == "string" else (raw).try_cast(kind)


def conditional_key_match(left_year: Column, right_year: Column) -> Column:
    """Year only constrains the match when the left year is known."""
    return left_year.isNull() | (F.substring(left_year, 1, 4) == F.substring(right_year, 1, 4))


# Query-string parameter -> (filter key, kind), in the reference's order.
URL_FILTERS = {
    "book_id": ("book_id_in", "string"), "is_active": ("is_active", "boolean"), "bl": ("location", "string"),
    "title": ("title_contains", "string"), "ami": ("square_meter_gt", "int"), "ama": ("square_meter_lt", "int"),
    "pma": ("price_lt", "int"), "pmi": ("price_gt", "int"), "cma": ("cashflow_lt", "int"), "cmi": ("cashflow_gt", "int"),
    "roima": ("roi_lt", "double"), "roimi": ("roi_gt", "double"),
    "psqma": ("price_per_square_meter_lt", "int"), "psqmi": ("price_per_square_meter_gt", "int"),
    "crma": ("rent_price_lt", "int"), "crmi": ("rent_price_gt", "int"),
    "rsqma": ("rent_per_square_meter_lt", "int"), "rsqmi": ("rent_per_square_meter_gt", "int"),
    "yma": ("year_of_construction_lt", "year"), "ymi": ("year_of_construction_gt", "year"),
    "upmi": ("uptime_date_gt", "relative"), "datemi": ("date_gt", "relative"),
    "price_has_changed": ("price_has_changed", "boolean"), "price_has_increased": ("price_has_increased", "boolean"),
    "pbmv": ("price_below_market_value", "boolean"), "permvmi": ("som_model_percentage_gt", "double"),
    "permvma": ("som_model_percentage_lt", "double"), "spider": ("spider", "string"),
    "is_foreclosure": ("is_foreclosure", "boolean"), "is_erbbaurecht": ("is_erbbaurecht", "boolean"),
}


def url_filters(url: Column, now: Column, spec: dict[str, tuple[str, str]] = URL_FILTERS) -> list[Column]:
    """One typed column per filter key of a request URL, NULL where absent or bad.

    A year of 0 counts as absent and a year bound is January 1; a relative time counts back
    from ``now``; ``is_active`` is true unless the URL says otherwise.
    """
    out = []
    for param, (key, kind) in spec.items():
        if kind == "relative":
            value = relative_cutoff_col(query_param(url, param), now)
        elif kind == "year":
            value = F.make_date(F.nullif(query_param(url, param, "year"), F.lit(0)), F.lit(1), F.lit(1))
        else:
            value = query_param(url, param, kind)
        if key == "is_active":
            value = F.coalesce(value, F.when(F.try_parse_url(url, F.lit("QUERY"), F.lit(param)).isNull(), F.lit(True)))
        out.append(value.alias(key))
    return out


def conditional_match(left: DataFrame, right: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys and, where the left year is known, equal years.

    The equal keys make it a hash or sort-merge join; the year is its extra condition.
    Columns of ``right`` get the prefix ``r_``.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = [F.col(k) == F.col(f"r_{k}") for k in keys]
    return left.join(r, [*on, conditional_key_match(F.col(year).cast("string"), F.col(f"r_{year}").cast("string"))])


def in_list(df: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """B2 for long lists: rows whose field is in the one-column table ``values`` (semi join)."""
    v = values.columns[0]
    return df.join(values.select(F.col(v).alias("_in")).distinct(), df[field] == F.col("_in"), "left_semi")


def path_label(path: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose segment occurs in the path gives the label, else NULL."""
    out = F.lit(None).cast("string")
    for segment, label in reversed(rules):
        out = F.when(F.contains(path, F.lit(segment)), F.lit(label)).otherwise(out)
    return out
