"""Token ids as length-delimited binary records with checksums and an offset index.

A record is ``u64 length | u32 masked crc of the length | payload | u32 masked crc of
the payload``, little-endian; the payload is ``u8 flags | i64 doc_id | ids``.  The ids
take two bytes when the vocabulary allows it, else four.  Beside each record file lies an
index of ``(i64 doc_id, u64 offset, u64 n_tokens)`` per record, so that a reader can seek
to records in any order.  The checksum is CRC-32, rotated right by 15 bits plus a
constant, so that checksums of data that holds checksums stay sound.

Files are written by executors through pyarrow's file systems into the shared folder
under names no other attempt uses.  Spark's committed manifest says which files count, so
a lost or repeated task leaves only files that nobody reads.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import UNICODE_SPACE, TwoGenerations, kept, short_batches, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MASK_DELTA = 0xA282EAD8
HEAD = "<QI"
TAIL = "<I"
BODY = "<Bq"
ENTRY = "<qQQ"
NULL_ID, WIDE_IDS = 1, 2
CACHE_UNITS = 400_000
CACHED_CHARS = 64
LONG_TEXT = 1 << 20
UNITS_AT_ONCE = 100_000

# Unicode white space, as the tokenizer's pattern sees it.
# A unit is a white space run up to its last character, one lone white space character, or a
# word with the one space before it: the tokenizer's own pieces never cross unit borders.
_UNITS = re.compile(f"[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])| ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]")

# Texts of these characters alone are cut into the tokenizer's own pieces, of which there are fewer distinct ones:
# letters, digits, other characters, each with the space before, white space, and the endings of English contractions.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTER}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\t-\\r 0-9{_LETTER}]+"
                     "|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(TAIL, masked_crc(size)) + payload + struct.pack(TAIL, masked_crc(payload))


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a record stream; a damaged or cut record raises ValueError."""
    while head := stream.read(struct.calcsize(HEAD)):
        if len(head) < struct.calcsize(HEAD) or masked_crc(head[:8]) != struct.unpack(HEAD, head)[1]:
            raise ValueError("damaged record length")
        size = struct.unpack(HEAD, head)[0]
        body = stream.read(size + struct.calcsize(TAIL))
        if len(body) < size + struct.calcsize(TAIL) or masked_crc(body[:size]) != struct.unpack(TAIL, body[size:])[0]:
            raise ValueError("damaged record")
        yield body[:size]


def file_system(uri: str):
    """pyarrow's file system and path of a Hadoop-style URI or plain path."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, each distinct unit encoded once while it is cached."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.cache = TwoGenerations(CACHE_UNITS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes of text that each token stands for: a byte-level vocabulary has one letter per byte.
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)

    def _units(self, text: str) -> re.Pattern:
        plain = _PLAIN.fullmatch(text) and not any(s in text for s in self.special)
        return _PIECES if plain else _UNITS

    def _encode(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, from one call: units are laid end to end and cut by their tokens' bytes.

        A unit that starts with the space before its word, or with a word behind a line end,
        borders on a piece of its own there; white space units are encoded by themselves.
        """
        out: dict[str, bytes] = {}
        blank = [u for u in units if u.isspace()]
        for u, e in zip(blank, self.tokenizer.encode_batch_fast(blank, add_special_tokens=False)):
            out[u] = np.array(e.ids, dtype=self.dtype).tobytes()
        words = [u for u in units if not u.isspace()]
        laid = [u if u[0] == " " else "\n" + u for u in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(laid)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.cumsum([len(u.encode("utf-8", "replace")) for u in laid])
        cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, side="left") + 1 if len(laid) else ends
        data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        start = 0
        for u, text, end in zip(words, laid, cuts.tolist()):
            out[u] = data[(start + (text is not u)) * width:end * width]
            start = end
        return [out[u] for u in units]

    def _join(self, texts: list[list[str]]) -> list[bytes]:
        known = self.cache.room()
        missing = set().union(*texts).difference(known)
        fresh = [u for u in missing if self.cache.promote(u) is None]
        new = dict(zip(fresh, self._encode(fresh)))
        known.update((u, b) for u, b in new.items() if len(u) <= CACHED_CHARS)
        out = []
        for units in texts:
            try:
                out.append(b"".join([known[u] for u in units]))
            except KeyError:
                out.append(b"".join([known[u] if u in known else new[u] for u in units]))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; very long texts by stretches of units."""
        short = [t for t in texts if len(t) <= LONG_TEXT]
        done = iter(self._join([self._units(t).findall(t) for t in short]))
        return [next(done) if len(t) <= LONG_TEXT else self._stretches(t) for t in texts]

    def _stretches(self, text: str) -> bytes:
        units, out = (m.group() for m in self._units(text).finditer(text)), []
        while part := list(islice(units, UNITS_AT_ONCE)):
            out.extend(self._join([part]))
        return b"".join(out)


def encoder(path: str) -> UnitEncoder:
    """The Python worker's encoder of a tokenizer file."""
    return kept(("records", path), lambda: UnitEncoder(path))


def _ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, ident = struct.unpack_from(BODY, payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & WIDE_IDS else "<u2", offset=struct.calcsize(BODY))
    return (None if flags & NULL_ID else ident), ids


def write_records(df: DataFrame, root: str, tokenizer_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Write all texts as records in ascending identifier order; returns the manifest.

    Manifest columns: ``part, path, records, tokens, start`` (``start``: tokens of all
    files before).  Null text: an empty sequence, which holds the end id alone; null
    identifiers come first; rows with equal identifiers are ordered by the text's hash; an
    empty table gives an empty manifest.  Other columns are not written.
    """
    spark = df.sparkSession
    short_batches(spark)
    ident, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    dealt = (df.select(ident.alias("doc_id"), text.alias("text"))
             .withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
             .sortWithinPartitions("doc_id", "h"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        width = np.dtype(coder.dtype).itemsize
        end = np.array([END_ID], dtype=coder.dtype).tobytes()
        records = tokens = offset = 0
        with fs.open_output_stream(name + ".rec") as rec, fs.open_output_stream(name + ".idx") as idx:
            for pdf in batches:
                for i, ids in zip(pdf["doc_id"], coder.encode_all(list(pdf["text"]))):
                    null = i is None or i != i
                    ids += end
                    flags = (NULL_ID if null else 0) | (WIDE_IDS if width == 4 else 0)
                    data = frame(struct.pack(BODY, flags, 0 if null else int(i)) + ids)
                    idx.write(struct.pack(ENTRY, 0 if null else int(i), offset, len(ids) // width))
                    rec.write(data)
                    offset += len(data)
                    records += 1
                    tokens += len(ids) // width
        yield pd.DataFrame({"part": [part], "name": [name.rsplit("/", 1)[1]], "records": [records], "tokens": [tokens]})

    manifest = f"{root}/manifest"
    # Nullable integers would become floats in pandas, so identifiers travel as strings.
    (dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
     .mapInPandas(write, "part long, name string, records long, tokens long")
     .where("records > 0").write.parquet(manifest))
    order = Window.orderBy("part")
    return (spark.read.parquet(manifest)
            .withColumn("start", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("nth", F.row_number().over(order) - 1)
            .withColumn("path", F.concat(F.lit(root + "/"), "name")))


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files: ``doc_id, start, n_tokens, ids`` (ids: u32 little-endian)."""
    short_batches(spark)
    files = manifest.count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                fs, name = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(name + ".rec") as stream:
                    for payload in unframe(stream):
                        ident, ids = _ids(payload)
                        rows.append((ident, int(start), len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += len(payload)
                        if held > 1 << 22:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    # One file per task: the manifest has one row per file, so it is small beside the data.
    tasks = spark.range(0, max(files, 1), 1, max(files, 1))
    listed = tasks.join(F.broadcast(manifest), tasks["id"] == manifest["nth"]).select("path", "start")
    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return pdf.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64"})


def read_at(path: str, wanted: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records number ``wanted`` of one file, in that order, by seeking through its index."""
    fs, name = file_system(path)
    with fs.open_input_file(name + ".idx") as idx, fs.open_input_file(name + ".rec") as rec:
        out = []
        for n in wanted:
            idx.seek(n * struct.calcsize(ENTRY))
            rec.seek(struct.unpack(ENTRY, idx.read(struct.calcsize(ENTRY)))[1])
            out.append(_ids(next(unframe(rec))))
        return out


def token_records(df: DataFrame, tokenizer_path: str, root: str | None = None, **columns: str) -> DataFrame:
    """Write the records into a fresh shared folder and read them back."""
    spark = df.sparkSession
    root = root or scratch_path(spark, "records")
    return read_records(spark, write_records(df, root, tokenizer_path, **columns))
