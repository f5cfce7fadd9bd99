"""Nearest documents by Jensen-Shannon distance.

Queries and books are dealt into blocks by hash, and each block of queries meets each block
of books in one task, which keeps only its own top ``k`` per query: no book x query pair
table is ever materialised, and no vector passes the driver.  A final window group limit
merges the blocks' winners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmap.session import reliable_checkpoint
from shelfmap.functions.arrays import explode_indexed, js_distance  # noqa: F401  (js: column form)

MAX_QUERIES = 4_000         # query vectors of a block
MAX_BOOKS = 20_000          # book vectors of a block
LEAST_BOOKS = 500           # a block is not made smaller for the sake of more tasks
ZERO = 1e-9                 # distances at or below count as exact copies
CHUNK_CELLS = 4_000_000     # rows x queries x dims per numpy block


def _js_matrix(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of P to every row of Q (both sum to 1)."""
    out = np.empty((P.shape[0], Q.shape[0]))
    step = max(1, CHUNK_CELLS // max(1, Q.shape[0] * P.shape[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        for s in range(0, P.shape[0], step):
            p = P[s:s + step, None, :]
            q = Q[None, :, :]
            m = (p + q) / 2.0
            tp = np.where(p > 0, p * np.log(p / m), 0.0)
            tq = np.where(q > 0, q * np.log(q / m), 0.0)
            out[s:s + step] = np.sqrt(np.maximum((tp + tq).sum(axis=2) / 2.0, 0.0))
    return out


def _normalize(M: np.ndarray) -> np.ndarray:
    s = M.sum(axis=1, keepdims=True)
    return np.divide(M, s, out=np.zeros_like(M), where=s != 0)


def _topk_rows(ids: np.ndarray, d: np.ndarray, k: int):
    """Indices of the ``k`` smallest ``(d, id)`` (exact tie order)."""
    if d.size > k:
        kth = np.partition(d, k - 1)[k - 1]
        cand = np.nonzero(d <= kth)[0]
    else:
        cand = np.arange(d.size)
    order = np.lexsort((ids[cand], d[cand]))
    return cand[order[:k]]


def js_knn(books: DataFrame, queries: DataFrame, k: int = 10, drop_zero: bool = False,
           id_col: str = "sha", vec_col: str = "p", qid_col: str = "qid", qvec_col: str = "q",
           max_queries: int = MAX_QUERIES, max_books: int = MAX_BOOKS) -> DataFrame:
    """``(qid, sha, d, rank)`` - the ``k`` books nearest to each query.

    ``drop_zero`` skips distance 0 (exact copies), as the reference's G5 does.  Rows without a
    vector are left out.  Queries are sent once to each block of books, books once to each
    block of ``max_queries`` queries; two counts decide how many blocks there are.
    """
    spark = books.sparkSession
    queries = reliable_checkpoint(queries.select(qid_col, qvec_col).where(F.col(qvec_col).isNotNull()))
    books = books.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
    n_queries, n_books = queries.count(), books.count()
    q_blocks = max(1, -(-n_queries // max_queries))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b_blocks = max(1, -(-n_books // max_books), min(tasks, n_books // LEAST_BOOKS))

    def dealt(rows: DataFrame, ident: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64(ident), F.lit(blocks)).alias(own), "*",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    left = dealt(queries, qid_col, "q_block", q_blocks, "b_block", b_blocks).groupBy("q_block", "b_block")
    right = dealt(books, id_col, "b_block", b_blocks, "q_block", q_blocks).groupBy("q_block", "b_block")
    schema = (f"`{qid_col}` {queries.schema[qid_col].dataType.simpleString()}, "
              f"`{id_col}` {books.schema[id_col].dataType.simpleString()}, d double")

    def nearest(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or bs.empty:
            return pd.DataFrame({qid_col: qs[qid_col][:0], id_col: bs[id_col][:0], "d": np.zeros(0)})
        qids, ids = qs[qid_col].to_numpy(), bs[id_col].to_numpy()
        queries_, books_ = (_normalize(np.stack([np.asarray(v, dtype=np.float64) for v in x]))
                            for x in (qs[qvec_col], bs[vec_col]))
        out_q, out_id, out_d = [], [], []
        step = max(1, CHUNK_CELLS // max(1, len(ids)))               # queries per distance block
        for s in range(0, len(qids), step):
            distance = _js_matrix(books_, queries_[s:s + step])
            if drop_zero:
                distance = np.where(distance > ZERO, distance, np.inf)
            for j in range(distance.shape[1]):
                col = distance[:, j]
                sel = _topk_rows(ids, col, k)
                sel = sel[np.isfinite(col[sel])]
                out_q.append(np.repeat(qids[s + j:s + j + 1], len(sel)))
                out_id.append(ids[sel])
                out_d.append(col[sel])
        return pd.DataFrame({qid_col: np.concatenate(out_q), id_col: np.concatenate(out_id), "d": np.concatenate(out_d)})

    found = left.cogroup(right).applyInPandas(nearest, schema)
    w = Window.partitionBy(qid_col).orderBy("d", id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroids(dist: DataFrame, label: str = "label", vec_col: str = "p") -> DataFrame:
    """Mean distribution per label: ``(qid, q)`` - partial/final per (label, dim)."""
    per_dim = (dist.select(F.col(label).alias("qid"), explode_indexed(F.col(vec_col)))
               .groupBy("qid", "i").agg(F.avg("v").alias("v")))
    return (per_dim.groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("iv"))
            .select("qid", F.transform("iv", lambda s: s["v"]).alias("q")))
