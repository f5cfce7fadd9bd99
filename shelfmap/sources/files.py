"""Named text files as a sink (A19) and as a corpus source (A1-A3).

Tasks write the files; a manifest, written last, names the files that count, so a
reader never sees half of them and a repeated task only writes the same file again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.sources.corpus import file_system, read_corpus

MANIFEST = "_manifest"


def write_files(files: DataFrame, root: str, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """Write one UTF-8 file ``root/<name>`` per row; returns the manifest ``name, bytes, sha256``.

    Names are relative paths and may hold any character; each must occur once.  NULL
    texts make empty files, rows without a name none.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = file_system(root)
        made = set()
        for pdf in batches:
            done = []
            for name, text in zip(pdf["name"], pdf["text"]):
                path, data = f"{folder}/{name}", (text or "").encode("utf-8")
                above = path.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                part = f"{above}/_{uuid.uuid4().hex}"                # whole or not at all under its own name
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, path)
                done.append((name, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(done, columns=["name", "bytes", "sha256"])

    rows = files.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")).where("name IS NOT NULL")
    rows.mapInPandas(write, "name string, bytes long, sha256 string").write.mode("overwrite").parquet(f"{root}/{MANIFEST}")
    return files.sparkSession.read.parquet(f"{root}/{MANIFEST}")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``name, path, text`` of the files below ``root`` that its manifest names."""
    manifest = spark.read.parquet(f"{root}/{MANIFEST}").select("name")
    found = read_corpus(spark, root, pattern)
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    found = found.withColumn("name", F.element_at(F.split(plain, F.concat(F.lit("\\Q"), F.lit(root.rstrip("/").rpartition("/")[2]), F.lit("/\\E")), 2), 2))
    return found.join(manifest, "name", "left_semi").select("name", "path", "text")
