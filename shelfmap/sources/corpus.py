"""Text-corpus scans (A1-A3): one row per file, whole text, id from the file name.

Tasks list the folders, level by level, and read the files, so the driver holds no list of them: Spark's
own reader keeps every file's status and split on the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.functions.text import clean_text
from shelfmap.operators.serve import hash_order
from shelfmap.session import reliable_checkpoint

LISTED_ROWS = 10_000           # of a folder's entries sent at once
TASK_BYTES = 32 << 20          # of files that a task reads, and
TASK_FILES = 2_000             # files
SENT_BYTES = 8 << 20           # of texts sent at once
PATH_CHARS = "!$&'()*+,-./:;=@_~"      # fixed values: what Java's URI leaves in a path, besides letters and digits


def file_system(uri: str):
    """pyarrow's file system and path of a Hadoop-style URI or plain path (local, HDFS, S3, GCS or ABFS)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """A1: every matching file below ``path`` (recursively) as ``(path, text)``.

    As with Spark's reader, empty files and names that start with an underscore or a dot are passed over, and paths are URL-encoded.
    Spark's reader itself takes what pyarrow cannot list: other stores, single files and paths with wildcards.
    """
    root = _folder(spark, path)
    if root is None:
        df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
              .text(path, wholetext=True))
        return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = _listed(spark, root, spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern())
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(-(-n // TASK_FILES), -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism), 1)
    store_root = file_system(root)[1].rstrip("/")
    shown = _quoted("file:" + store_root if root.startswith("file:") else root.rstrip("/"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, done, held = file_system(root)[0], [], 0
        for pdf in batches:
            for name in pdf["name"]:
                with store.open_input_stream(f"{store_root}/{name}") as source:
                    data = source.read()
                done.append((f"{shown}/{_quoted(name)}", data))
                held += len(data)
                if held >= SENT_BYTES:
                    yield pd.DataFrame(done, columns=["path", "data"])
                    done, held = [], 0
        if done:
            yield pd.DataFrame(done, columns=["path", "data"])

    texts = files.select("name").repartition(tasks, "name").mapInPandas(read, "path string, data binary")
    return texts.select("path", F.col("data").cast("string").alias("text"))


def _folder(spark: SparkSession, path: str) -> str | None:
    """The path with its scheme, if it is one folder that pyarrow can list."""
    from pyarrow import fs
    if not isinstance(path, str) or re.search(r"[*?\[\]{}\\]", path):
        return None
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()
    try:
        store, at = file_system(full)
        return full if store.get_file_info(at).type == fs.FileType.Directory else None
    except (OSError, ValueError):             # pyarrow's errors are among these
        return None


def _quoted(path: str) -> str:
    """A path as Java's URI writes it: letters of other scripts stay."""
    keep = lambda c: c in PATH_CHARS or (c.isalnum() if c < "\x80" else not (c.isspace() or c < "\xa0"))
    return "".join(c if keep(c) else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in path)


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``name, size`` of the files below ``root`` whose own name matches; names are relative to it."""
    def entries(store, at: str):
        from pyarrow import fs
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(at) as found:     # a folder at a time, never a list of all
                for e in found:
                    yield e.name, e.is_dir(), lambda e=e: e.stat().st_size
        else:
            for e in store.get_file_info(fs.FileSelector(at)):
                yield e.base_name, e.type == fs.FileType.Directory, lambda e=e: e.size

    def hidden(name: str) -> bool:            # Spark's rule
        out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
        return out and not name.startswith(("_common_metadata", "_metadata"))

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, at), match = file_system(root), re.compile(pattern, re.DOTALL).fullmatch
        for pdf in batches:
            for folder in pdf["name"]:
                rows = []
                for name, is_folder, size in entries(store, f"{at.rstrip('/')}/{folder}".rstrip("/") or "/"):
                    if not hidden(name) and (is_folder or match(name) and size()):
                        rows.append((f"{folder}/{name}" if folder else name, 0 if is_folder else size(), is_folder))
                    if len(rows) >= LISTED_ROWS:
                        yield pd.DataFrame(rows, columns=["name", "size", "folder"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["name", "size", "folder"])

    level, n, files = spark.createDataFrame([("",)], "name string"), 1, None
    while n:
        found = reliable_checkpoint(level.repartition(n, "name").mapInPandas(children, "name string, size long, folder boolean"))
        own = found.where("NOT folder").select("name", "size")
        files = own if files is None else files.unionByName(own)
        level = found.where("folder").select("name")
        n = min(level.count(), 4 * spark.sparkContext.defaultParallelism)
    return files


def sample_corpus(corpus: DataFrame, max_documents: int | None = None, seed: int = 42,
                  clean: bool = True) -> DataFrame:
    """A1: a seeded subset of ``max_documents`` files (all when None), cleaned with F1."""
    out = corpus
    if max_documents is not None:
        out = out.orderBy(hash_order(F.col("path"), seed), F.col("path")).limit(max_documents)
    return out.withColumn("text", clean_text(F.col("text"))) if clean else out


def with_stem(corpus: DataFrame) -> DataFrame:
    """A2: add the file stem (decoded name without extension) as ``stem``.

    Spark gives paths URL-encoded, with a plus sign as it is.
    """
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return corpus.withColumn("stem", F.regexp_extract(plain, r"([^/]+)\.[^./]*$", 1))


def corpus_books(corpus: DataFrame, marker: str = "gutenberg_books", prefix: str = "gb_") -> DataFrame:
    """A3: book rows ``(book_id, title, summary)``; files under ``marker`` get ``prefix``."""
    s = with_stem(corpus)
    book_id = F.when(F.col("path").contains(marker), F.concat(F.lit(prefix), F.col("stem"))).otherwise(F.col("stem"))
    return s.select(book_id.alias("book_id"), F.lit("").alias("title"), F.col("text").alias("summary"))
