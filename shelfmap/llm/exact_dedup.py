"""Exact dedup by content sort (DataFrame operations only).

Rows are dealt by sampled range splitters over the first bytes and the hash of the
normalised text, each partition is sorted externally by the whole normalised text,
and neighbours that compare equal in full form a run, of which the smallest
identifier stays.  The splitter key is short, so the driver's sample stays small
however long the texts are.

A text that holds at least ``1 / HOT_SHARE`` of all rows (at most ``HOT_SHARE`` such
texts can exist, so their list is bounded) is dealt over ``SALTS`` runs by its
identifier's hash; one partial aggregate per such text joins its runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, text_or_empty

HOT_SHARE = 512
SALTS = 64
PREFIX_CHARS = 24


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input rows and columns plus ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    * null text: as the empty text; null identifier: sorts after all others, and stays
      only if its whole group has null identifiers;
    * repeated rows (same identifier and text): exactly one of them has ``kept``;
    * empty input: no rows; input columns named like a result column are replaced.
    """
    result = ("keep_id", "group_size", "kept", "text_sha256")
    df = df.drop(*result)
    names = df.columns
    head, code, salt, norm, pos = (free_name(names, n) for n in ("head", "code", "salt", "norm", "pos"))
    ident = F.col(id_col)

    keyed = df.withColumn(code, F.xxhash64(normalised(text_col)))
    rows = df.count()
    share = keyed.groupBy(code).count().where(F.col("count") * HOT_SHARE >= rows)
    hot = [r[0] for r in share.where(F.col("count") > 1).select(code).collect()] if rows else []

    # The splitter key is made before the exchange, the sort key after it: only the text itself moves.
    is_hot = F.col(code).isin(hot) if hot else F.lit(False)
    keyed = keyed.withColumn(head, F.substring(normalised(text_col), 1, PREFIX_CHARS)) \
        .withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(ident), F.lit(SALTS))).otherwise(-1))
    dealt = keyed.repartitionByRange(head, code, salt).withColumn(norm, normalised(text_col))

    run = Window.partitionBy(head, code, salt, norm)
    in_run = run.orderBy(ident.asc_nulls_last())
    whole = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (dealt.withColumn(pos, F.row_number().over(in_run))
           .withColumn("keep_id", F.first(ident).over(whole))
           .withColumn("group_size", F.count(F.lit(1)).over(whole))
           .withColumn("text_sha256", F.sha2(F.encode(norm, "UTF-8"), 256)))
    if hot:
        sums = (keyed.where(is_hot).groupBy(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256).alias("hot_sha"))
                .agg(F.min(ident).alias("hot_keep"), F.count(F.lit(1)).alias("hot_size")))
        # At most HOT_SHARE texts reach the share, so this side is bounded.
        out = out.join(F.broadcast(sums), out["text_sha256"] == sums["hot_sha"], "left")
        out = (out.withColumn("keep_id", F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("keep_id")))
               .withColumn("group_size", F.coalesce("hot_size", "group_size")))
    out = out.withColumn("kept", (F.col(pos) == 1) & ident.eqNullSafe(F.col("keep_id")))
    return out.select(*[F.col(f"`{c}`") for c in names], *result)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_groups(df, id_col, text_col).where("kept").select(*[F.col(f"`{c}`") for c in df.columns])
