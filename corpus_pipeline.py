"""The training-data pipeline: five stages over ``documents``, each kept as Parquet.

Each stage reads what the one before kept: the quality classifier drops the documents it
rejects, exact dedup and near-dedup keep one document of each group, mixing repeats or
drops documents to meet the sources' targets, and SentencePiece encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.llm import exact_dedup, mixing, omh, pieces, quality_pu
from shelfmap.llm.common import documents, table
from shelfmap.session import scratch_path

# The workers of five stages share an executor, so the last stage's cache is kept small.
CACHE_UNITS = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; it is fitted on this stage's own input.

    Null texts score as empty ones, rows without an identifier count as unlabelled, and repeated
    rows are kept or dropped together.  Without labels nothing is learnt, and all stay.
    """
    model = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text, the one with the smallest identifier.

    Texts are compared in whole with white space runs as one space, null as empty; null identifiers come
    last; of rows that are the same throughout, one stays.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the least identifier.

    Null and wordless texts are one class; repeated rows stay or go together.
    """
    return omh.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its share of all words.

    A document is taken at most three times; null texts have no words, null sources are one source, the last.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document taken: its piece ids, their count and checksum, and the decoded length.

    Null texts are empty sequences; a document that the mix took twice has two rows.
    """
    coded = pieces.encode_pieces(docs, public_tokenizers.path(pieces.MODEL), cache_units=CACHE_UNITS)
    return coded.select("doc_id", "source", "n_pieces", "ids", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near),
          ("mixing", mixed), ("sentencepiece", encoded)]

# Learned scores, sketches and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = documents(spark, sf_dir), scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
