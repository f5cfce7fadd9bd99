"""Positional index for phrase search.

One posting ``(id, pos)`` per word, in the normal form of ``normalize_text``.  A task gathers the
postings of each term over a block of its texts, so that a row is exchanged, sorted and written per
term and block instead of per word.  Rows are stored per batch, in folders by a hash of the term and
sorted by term, so a search reads only its terms' folders and row groups, not the texts.  A document
that comes again in a later batch replaces its earlier postings.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmap.functions.predicates import ACCENTED, UNACCENTED, blank_runs, fold_accents

BUCKETS = 64          # folders of an index
SPLITS = 8            # files that a batch writes per folder at most, so that a common term is no single task
BLOCK_BYTES = 8 << 20     # text of a block, about
BATCH_BYTES = 4 << 20     # of an Arrow batch of texts, about
ROW_POSTINGS = 1 << 16    # postings of a row at most
BATCH_POSTINGS = 1 << 18  # postings of an Arrow batch given back, about


def phrase_words(phrase: str) -> list[str]:
    """The words of a phrase, as ``normalize_text`` gives them."""
    folded = phrase.lower().translate(str.maketrans(ACCENTED, UNACCENTED))
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split()


def _blocks(batches):
    """Arrow batches of ``id, text`` cut and put together to blocks of about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.column(1).nbytes))
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            size += held[-1].column(1).nbytes
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _block_postings(block: pa.Table):
    """``term, ids, positions``: the places of each term in a block of texts, in the order of the texts."""
    ids, texts = (c.combine_chunks() for c in block.filter(pc.not_equal(block.column(1), "")).columns)
    words = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    del texts, words
    n = len(coded)
    term = coded.indices.to_numpy().astype(np.int64)
    term <<= 32
    term |= np.arange(n)
    term.sort()                                               # a term's places come together, in order
    place = term.astype(np.int32)
    term >>= 32
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    pos = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    starts = np.union1d(np.flatnonzero(np.diff(term, prepend=-1)), np.arange(0, n, ROW_POSTINGS))
    cuts = np.append(starts, n)
    first = 0
    for last in np.unique(np.append(np.searchsorted(cuts, np.arange(BATCH_POSTINGS, n, BATCH_POSTINGS)), len(starts))):
        at, own = place[cuts[first]:cuts[last]], pa.array((cuts[first:last + 1] - cuts[first]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(term[starts[first:last]])), pa.ListArray.from_arrays(own, ids.take(pa.array(doc[at]))),
             pa.ListArray.from_arrays(own, pa.array(pos[at]))], ["term", "ids", "positions"])
        first = last


def _gather(batches):
    for block in _blocks(batches):
        yield from _block_postings(block)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, ids, positions``: where each word stands, a row per term and block of texts; NULL and empty texts have none.

    The n-th position is one in the n-th id's text.  A term may have several rows in a block.  Accents are
    folded in the terms, not in the texts: folding keeps letters letters, so the words are the same.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)     # read when the plan runs; changes no result
    texts = (docs.where(F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.trim(blank_runs(F.lower(F.col(text_col)))).alias("text")))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)),
                           T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(_gather, schema).withColumn("term", fold_accents(F.col("term")))


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_batch(docs: DataFrame, root: str, batch_id: int, id_col: str = "sha", text_col: str = "title") -> None:
    """Add a batch of documents to the index at ``root``; the same batch id again replaces that batch."""
    at = f"batch_id={batch_id}"
    rows = postings(docs, id_col, text_col).withColumn("bucket", _bucket("term"))
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("term", "ids.list.element")}     # few values come twice in a file
    (rows.repartition("bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPLITS))).sortWithinPartitions("bucket", "term")
     .write.mode("overwrite").options(**plain).partitionBy("bucket").parquet(f"{root}/postings/{at}"))
    docs.select(F.col(id_col).alias("id")).distinct().write.mode("overwrite").parquet(f"{root}/documents/{at}")


def find_phrase(spark: SparkSession, root: str, phrase: str) -> DataFrame:
    """``id`` of every document whose text has the phrase's words in a row.

    A posting of the phrase's k-th word says where the phrase would start; a document matches
    where all words agree on a start.  A phrase without words finds nothing.
    """
    words = phrase_words(phrase)
    rows = spark.read.option("basePath", f"{root}/postings").parquet(f"{root}/postings")
    wanted = F.lit(False)
    for w in sorted(set(words)):                              # the buckets fold to constants, which prune folders
        wanted = wanted | ((F.col("bucket") == _bucket(F.lit(w))) & (F.col("term") == w))
    places = F.filter(F.array(*[F.when(F.col("term") == w, F.lit(k)) for k, w in enumerate(words)]) if words
                      else F.array().cast("array<int>"), lambda k: k.isNotNull())
    placed = rows.where(wanted).select("batch_id", places.alias("places"), F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("positions").alias("pos"))))
    starts = placed.select("id", "batch_id", F.explode("places").alias("k"), "pos")
    found = (starts.groupBy("id", "batch_id", (F.col("pos") - F.col("k")).alias("start"))
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select("id", "batch_id").distinct())
    last = (spark.read.option("basePath", f"{root}/documents").parquet(f"{root}/documents")
            .groupBy("id").agg(F.max("batch_id").alias("batch_id")))
    return found.join(last, ["id", "batch_id"], "left_semi").select("id")


def indexed_search(books: DataFrame, root: str, phrase: str, id_col: str = "sha") -> DataFrame:
    """B4/B10 by index: the ``books`` whose indexed text has the phrase."""
    found = find_phrase(books.sparkSession, root, phrase).withColumnRenamed("id", "found_id")
    return books.join(found, books[id_col] == found["found_id"], "left_semi")
