"""Source divergence audit: a k-squared quadtree over the group-term count matrix.

Terms are counted per (lang, source) group.  Each language keeps the terms that enough of
its documents hold.  The count matrix of a language, groups by kept terms, is cut into
column blocks of about ``BLOCK_TERMS`` terms and row tiles of ``TILE_GROUPS`` groups; a
block and a pair of tiles are one task.  There a k-squared quadtree (each quadrant splits
into two by two) marks the quadrants without any count.  Pairs of groups walk the tree
together: where both are all-zero, their terms have one price, so only the number of terms
is added up; where one has a count, the two leaves are priced term by term.  Partial
values of a pair are added over the blocks by Spark.

All arithmetic is exact: shares are decimals divided in Spark, prices are 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import text_or_empty

SCALE = 1_000_000_000
LEAST_DOCS = 3
TERM_RANKS = 200
BLOCK_TERMS = 4096
TILE_GROUPS = 256
LEAF_GROUPS, LEAF_TERMS = 8, 64
HELD_TERMS = 400_000          # distinct (group, term) entries a task holds before it sends them on

# ASCII letters and every byte of a non-ASCII character make terms; A-Z become a-z; all else parts them.
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` per task; every group also gives one row without a term."""
    counts: dict = {}
    docs: dict = {}

    def sent():
        for (lang, source), held in counts.items():
            names, in_docs = list(held), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(names) + 1)), pa.array([source] * (len(names) + 1)),
                 pa.array([*names, None], pa.binary()).cast(pa.string()), pa.array([*held.values(), 0], pa.int64()),
                 pa.array([*(in_docs[t] for t in names), 0], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for group, text in zip(zip(langs, sources), batch.column(2).cast(pa.binary())):
            found = terms(text.as_py())
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
            counts[group].update(found)
            docs[group].update(set(found))
        if sum(map(len, counts.values())) >= HELD_TERMS:
            yield from sent()
    yield from sent()


def _share(count: Column | str, total: Column | str, vocabulary: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exact."""
    count, total, vocabulary = (F.col(c) if isinstance(c, str) else c for c in (count, total, vocabulary))
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.when(vocabulary > 0, 1 + F.call_function("div", above, (total + vocabulary).cast("decimal(19,0)")))


def _price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares of at most SCALE + 1: the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _tree(held: np.ndarray) -> list[np.ndarray]:
    """Levels of the quadtree, leaves first: whether a quadrant holds any count."""
    rows, columns = (-(-n // leaf) for n, leaf in zip(held.shape, (LEAF_GROUPS, LEAF_TERMS)))
    pad = np.zeros((rows * LEAF_GROUPS, columns * LEAF_TERMS), dtype=bool)
    pad[:held.shape[0], :held.shape[1]] = held
    levels = [pad.reshape(rows, LEAF_GROUPS, columns, LEAF_TERMS).any(axis=(1, 3))]
    while max(levels[-1].shape) > 1:
        last = levels[-1]
        last = np.pad(last, ((0, last.shape[0] % 2), (0, last.shape[1] % 2)))
        levels.append(last.reshape(last.shape[0] // 2, 2, last.shape[1] // 2, 2).any(axis=(1, 3)))
    return levels


def pair_values(shares: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Value of every ordered pair of rows: the sum over columns of floor((p - q)^2 / q).

    ``shares`` holds 0 where a group lacks the term, whose share is then the row's ``bare``.
    """
    held = shares > 0
    order = np.argsort(np.packbits(held, axis=0).T.copy().view(f"V{-(-held.shape[0] // 8)}").ravel(), kind="stable") \
        if held.size else np.arange(held.shape[1])
    shares, held = shares[:, order], held[:, order]           # terms of the same groups side by side
    n, width = shares.shape
    values, empty = np.zeros((n, n), dtype=np.int64), np.zeros((n, n), dtype=np.int64)
    levels = _tree(held) if held.size else []
    stack = [(len(levels) - 1, 0, 0, 0)] if levels else []
    while stack:
        level, i, j, c = stack.pop()
        here = levels[level]
        if i >= here.shape[0] or j >= here.shape[0] or c >= here.shape[1]:
            continue
        rows, columns = LEAF_GROUPS << level, LEAF_TERMS << level
        a, b = slice(i * rows, min((i + 1) * rows, n)), slice(j * rows, min((j + 1) * rows, n))
        cut = slice(c * columns, min((c + 1) * columns, width))
        if not here[i, c] and not here[j, c]:
            empty[a, b] += cut.stop - cut.start
        elif level:
            stack += [(level - 1, 2 * i + x, 2 * j + y, 2 * c + z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
        else:
            p = np.where(held[a, cut], shares[a, cut], bare[a, None])[:, None, :]
            q = np.where(held[b, cut], shares[b, cut], bare[b, None])[None, :, :]
            values[a, b] += ((p - q) * (p - q) // q).sum(axis=2)
    if width:
        gap = bare[:, None] - bare[None, :]
        values += empty * (gap * gap // np.maximum(bare, 1)[None, :])
    return values


def _price_block(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial values of all pairs of groups of two tiles, over the terms of one block."""
    lang, _, low, high = key
    groups = groups.sort_values("at")
    at = groups["at"].to_numpy()
    columns, term = np.unique(cells["term"].to_numpy(dtype=object), return_inverse=True)
    shares = np.zeros((len(at), len(columns)), dtype=np.int64)
    shares[np.searchsorted(at, cells["at"].to_numpy()), term] = cells["share"].to_numpy()
    values = pair_values(shares, groups["bare"].fillna(0).to_numpy().astype(np.int64))
    tile = groups["tile"].to_numpy()
    wanted = at[:, None] != at[None, :]
    if low != high:
        wanted &= tile[:, None] != tile[None, :]
    i, j = np.nonzero(wanted)
    source = groups["source"].to_numpy(dtype=object)
    return pd.DataFrame({"lang": lang, "source": source[i], "item": source[j], "value": values[i, j]})


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart.

    Part ``pair``: the item is each other source of the language, the value the sum over the
    language's kept terms of ``floor((p - q)^2 / q)``, p the source's share of the term and q
    the other's.  Part ``term``: the item is each kept term that the source holds and whose
    share exceeds the language's; the first ``term_ranks`` are returned.  Ranks run from 1
    by value descending, then item ascending.

    Null text, lang or source: as empty.  Repeated rows count as documents of their own.
    A source without terms is a group all the same; a language without kept terms gives
    pairs of value 0 and no terms; a language with one source gives no pairs.  Empty input:
    no rows.  Other columns are not read.
    """
    texts = df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"),
                      text_or_empty(text_col).alias("text"))
    counted = reliable_checkpoint(
        texts.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = (counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"))
    cells = reliable_checkpoint(counted.drop("docs").join(kept, ["lang", "term"]))

    sizes = (cells.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    vocabularies = (cells.groupBy("lang", "term").agg(F.sum("n").alias("n"))
                    .groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total")))
    in_lang = Window.partitionBy("lang")
    groups = (counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
              .join(vocabularies, "lang", "left").fillna(0, ["total", "v", "lang_total"])
              .withColumn("at", F.row_number().over(in_lang.orderBy("source")) - 1)
              .withColumn("tile", F.floor(F.col("at") / TILE_GROUPS).cast("int"))
              .withColumn("tiles", F.max("tile").over(in_lang) + 1)
              .withColumn("blocks", F.ceil(F.greatest("v", F.lit(1)) / BLOCK_TERMS).cast("long"))
              .withColumn("bare", _share(F.lit(0), "total", "v")))
    groups = reliable_checkpoint(groups)

    def met(rows: DataFrame) -> DataFrame:
        """Each row once per pair of tiles that its own tile belongs to."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        return rows.select("*", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    priced = cells.join(groups.select("lang", "source", "total", "v", "lang_total", "at", "tile", "tiles", "blocks"), ["lang", "source"]) \
        .withColumn("share", _share("n", "total", "v"))
    left = met(priced.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))) \
        .select("lang", "block", "low", "high", "at", "term", "share")
    right = met(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))) \
        .select("lang", "block", "low", "high", "at", "tile", "source", "bare")
    key = ["lang", "block", "low", "high"]
    own = right.toDF(*(f"{c}_" for c in right.columns)).toDF(*right.columns)     # both sides stem from the groups
    pairs = (left.groupBy(*key).cogroup(own.groupBy(*key))
             .applyInPandas(_price_block, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    with_q = priced.withColumn("q", _share("lang_n", "lang_total", "v"))
    found = (with_q.where((F.col("n") > 0) & (F.col("share") > F.col("q")))
             .select("lang", "source", F.col("term").alias("item"), _price(F.col("share"), F.col("q")).alias("value")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    result = ("lang", "source", "part", "item", "value", "rank")
    pair_part = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked)).select(*result)
    term_part = (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= term_ranks)
                 .withColumn("part", F.lit("term")).select(*result))
    return pair_part.unionByName(term_part)
