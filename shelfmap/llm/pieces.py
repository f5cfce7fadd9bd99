"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text is a path of pieces.  Short texts are encoded in one go.  A giant text is cut into
chunks of ``CHUNK_CHARS``; a state at a cut is the piece that covers or ends at it.  Every
chunk yields a transfer matrix from the states at its left cut to those at its right cut:
minus the number of pieces that start in the chunk along the path between them, or
nothing (minus infinity) where no path of mutually compatible pieces exists.  Matrices
combine associatively under (max, +), in blocks of ``FAN`` per task and level, so no task
reads a whole giant document's matrices at once.  Going down again, every chunk gets the
best values from the document's start and to its end, so it knows its own entry and exit
states and traces its pieces back independently of the others.

The model is a byte-fallback BPE: its encoding is the only path all of whose neighbours are
compatible (``bpe_paths``), so the scan gives exactly the library's ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .bpe_paths import PairRules, WordTable
from .common import TwoGenerations, free_name, kept, per_text, short_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK_CHARS = 32_768
FAN = 256
CACHE_UNITS = 200_000
CACHED_CHARS = 64
DECODED_AT_ONCE = 1 << 16
BATCH_BYTES = str(4 << 20)      # of an Arrow batch: a giant text's chunks and ids make long rows

# A unit starts at the first of a run of space marks, or is a line end; both are checked against the vocabulary.
_UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_BORDER = re.compile(f"(?<=\n)|(?=\n)|(?<!{SPACE})(?={SPACE})")     # where such a unit starts, but at a text's start
START = ("", 0)          # the state before a document's first and after its last character

State = tuple[str, int]  # the piece, and how many of its characters lie right of the cut
Matrix = dict[tuple[State, State], int]


class PieceCoder:
    """Ids and texts of one SentencePiece BPE model."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import sentencepiece
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rules = PairRules(set(self.ids), by_piece={sp.id_to_piece(i): -sp.get_score(i) for i in normal})
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.ids):
            raise ValueError("a piece crosses a unit border")
        self.dtype = "<u2" if sp.vocab_size() <= 1 << 16 else "<u4"
        shown = [b""] * sp.vocab_size()
        for i in normal:
            shown[i] = sp.id_to_piece(i).replace(SPACE, " ").encode("utf-8")
        for b, i in self.bytes.items():
            shown[i] = bytes([b])
        shown[self.unknown] = b" \xe2\x81\x87 "
        self.shown = shown
        self.cache = TwoGenerations(cache_units)
        self.table = WordTable(self.rules)
        self.numbers = np.array([self.ids[p] for p in self.table.names], dtype=self.dtype)

    @staticmethod
    def normal(text: str) -> str:
        """Space marks for spaces and one in front; the empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def token_ids(self, tokens: list[str]) -> bytes:
        out = []
        for t in tokens:
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in t.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return np.array(out, dtype=self.dtype).tobytes()

    def learn(self, units: list[list[str]]) -> None:
        """Encode the unseen units together."""
        known = self.cache.room()
        fresh = set().union(*units).difference(known)
        fresh = [u for u in fresh if len(u) <= CACHED_CHARS and self.cache.promote(u) is None]
        known.update(self.table.encodings(fresh, self.numbers, self.dtype))

    def _joined(self, units: list[str]) -> bytes:
        known = self.cache.young
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            pass
        out = []
        for unit in units:
            b = known.get(unit)
            if b is None:
                b = self.cache.promote(unit)
                if b is None:
                    b = self.token_ids(self.rules.tokens(unit))
                    if len(unit) <= CACHED_CHARS:
                        known[unit] = b
            out.append(b)
        return b"".join(out)

    def encode_normal(self, text: str) -> bytes:
        """Ids of a normalised stretch between two unit borders."""
        return self._joined(_UNITS.findall(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        units = [_UNITS.findall(self.normal(t)) for t in texts]
        self.learn(units)
        return [self._joined(u) for u in units]

    def decode(self, ids: np.ndarray) -> str:
        runs = (ids[at:at + DECODED_AT_ONCE].tolist() for at in range(0, len(ids), DECODED_AT_ONCE))
        text = b"".join(b"".join(map(self.shown.__getitem__, run)) for run in runs).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # -- chunks: ``text`` is the chunk with context, ``lo`` and ``hi`` its cuts within that

    def states(self, text: str, cut: int) -> list[State]:
        """Every piece that covers or ends at a cut."""
        found = []
        for a in range(max(0, cut - self.rules.longest), cut):
            for b in range(cut, min(len(text), a + self.rules.longest) + 1):
                t = text[a:b]
                if (b - a == 1 and t not in self.ids) or self.rules.whole(t):
                    found.append((t, b - cut))
        return found

    def weight(self, tokens: list[str]) -> int:
        """Ids that a path yields: one per piece, one per byte of a character outside the vocabulary."""
        return sum(1 if t in self.ids else len(t.encode("utf-8", "replace")) if self.bytes else 1 for t in tokens)

    def _ways(self, text: str, lo: int, hi: int, entry: State, ends: bool) -> Iterator[tuple[State, list[str]]]:
        """Each exit state at ``hi`` that a path from ``entry`` at ``lo`` reaches, with the pieces that start between."""
        text, first = text[:hi + self.rules.longest], lo + entry[1]
        last = self.rules.last_tokens(text, first, entry[0] or None)
        last[first] = entry[0]
        for b in range(hi, len(text) + 1):
            t = last[b]
            if t is None or b - len(t) >= hi or ends and b != hi:
                continue
            path, i = [], b
            while i > first:
                path.append(last[i])
                i -= len(last[i])
            yield (START if ends else (t, b - hi)), path[::-1]

    def _walk(self, text: str, first: int, stop: int, entry: str) -> list[str] | None:
        """The path from ``first`` to the unit border ``stop`` after the piece ``entry``, if there is one."""
        last, i, path = self.rules.last_tokens(text[:stop], first, entry or None), stop, []
        while i > first:
            if last[i] is None:
                return None
            path.append(last[i])
            i -= len(last[i])
        return path[::-1]

    @staticmethod
    def _borders(text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last unit border strictly between ``lo`` and ``hi``, if any."""
        found = _BORDER.search(text, lo + 1, hi)
        if found is None or found.start() >= hi:
            return None
        last = hi - 1
        while not _BORDER.match(text, last):
            last -= 1
        return found.start(), last

    def inner(self, text: str, lo: int, hi: int) -> bytes:
        """Ids between the chunk's outer unit borders, on every path the same."""
        span = self._borders(text, lo, hi)
        return self.encode_normal(text[span[0]:span[1]]) if span else b""

    def matrix(self, text: str, lo: int, hi: int, begins: bool, ends: bool, inner: bytes | None = None) -> Matrix:
        """The chunk's transfer matrix; between its outer unit borders all paths share one stretch."""
        entries = [START] if begins else self.states(text, lo)
        span = self._borders(text, lo, hi)
        if span is None:
            return {(e, x): -self.weight(path) for e in entries for x, path in self._ways(text, lo, hi, e, ends)}
        first, last = span
        inner = self.inner(text, lo, hi) if inner is None else inner
        middle = len(inner) // np.dtype(self.dtype).itemsize
        heads = [(e, self._walk(text, lo + e[1], first, e[0])) for e in entries if lo + e[1] <= first]
        tails = [(x, self.weight(path)) for x, path in self._ways(text, last, hi, START, ends)]
        return {(e, x): -(self.weight(h) + middle + t) for e, h in heads if h is not None for x, t in tails}

    def trace(self, text: str, lo: int, hi: int, entry: State, leave: State, ends: bool, inner: bytes | None = None) -> bytes:
        """Ids of the pieces that start in the chunk, on the path between its two states."""
        span, front = self._borders(text, lo, hi), b""
        if span is not None:
            front = self.token_ids(self._walk(text, lo + entry[1], span[0], entry[0])) \
                + (self.inner(text, lo, hi) if inner is None else inner)
            lo, entry = span[1], START
        for x, path in self._ways(text, lo, hi, entry, ends):
            if x == leave:
                return front + self.token_ids(path)
        raise ValueError("no path between the chosen states")


def coder(path: str, cache_units: int = CACHE_UNITS) -> PieceCoder:
    return kept(("pieces", path, cache_units), lambda: PieceCoder(path, cache_units))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    rows: dict[State, list] = {}
    for (y, z), v in b.items():
        rows.setdefault(y, []).append((z, v))
    out: Matrix = {}
    for (x, y), u in a.items():
        for z, v in rows.get(y, ()):
            if u + v > out.get((x, z), -(1 << 62)):
                out[x, z] = u + v
    return out


def _pack(m: Matrix) -> list[tuple]:
    return [(x[0], x[1], y[0], y[1], v) for (x, y), v in m.items()]


def _unpack(rows) -> Matrix:
    return {((r["xp"], int(r["xn"])), (r["yp"], int(r["yn"]))): int(r["v"]) for r in rows}


MATRIX = "array<struct<xp:string,xn:int,yp:string,yn:int,v:long>>"


def _records(m: Matrix) -> list[dict]:
    return [dict(zip(("xp", "xn", "yp", "yn", "v"), r)) for r in _pack(m)]


def _chunks(giant: DataFrame, key: str, text: str, chunk: int, context: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                s = PieceCoder.normal(t)
                rows, held = [], 0
                for no, p in enumerate(range(0, len(s), chunk)):
                    a, b = max(0, p - context), min(len(s), p + chunk)
                    rows.append((k, no, s[a:min(len(s), b + context)], p - a, b - a, p == 0, b == len(s)))
                    held += chunk
                    if held >= 1 << 22:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = ["k", "no", "part", "lo", "hi", "begins", "ends"]
    return giant.select(key, text).mapInPandas(
        cut, "k long, no long, part string, lo int, hi int, begins boolean, ends boolean")


def _scan(mats: DataFrame, most: int) -> DataFrame:
    """Per chunk the values from the document's start and to its end: ``k, no, ahead, behind``.

    ``ahead`` has one entry per left state, ``behind`` one per right state, kept as
    matrices with START as the other side.
    """
    if most <= 1:
        return mats.select("k", "no", F.array(F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in (
            ("xp", "string", ""), ("xn", "int", 0), ("yp", "string", ""), ("yn", "int", 0), ("v", "long", 0))])).alias("ahead"),
            F.array(F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in (
                ("xp", "string", ""), ("xn", "int", 0), ("yp", "string", ""), ("yn", "int", 0), ("v", "long", 0))])).alias("behind"))

    blocks = mats.withColumn("block", F.expr(f"no div {FAN}"))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        total = None
        for m in pdf["m"]:
            total = _unpack(m) if total is None else multiply(total, _unpack(m))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "no": [pdf["block"].iloc[0]], "m": [_records(total)]})

    upper = blocks.groupBy("k", "block").applyInPandas(up, f"k long, no long, m {MATRIX}")
    above = _scan(reliable_checkpoint(upper), -(-most // FAN))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        mats_ = [_unpack(m) for m in pdf["m"]]
        ahead = [_unpack(pdf["ahead"].iloc[0])]
        for m in mats_[:-1]:
            ahead.append(multiply(ahead[-1], m))
        behind = [_unpack(pdf["behind"].iloc[0])]
        for m in reversed(mats_[1:]):
            behind.append(multiply(m, behind[-1]))
        return pd.DataFrame({"k": pdf["k"], "no": pdf["no"], "ahead": [_records(a) for a in ahead],
                             "behind": [_records(b) for b in reversed(behind)]})

    joined = blocks.join(above.select("k", F.col("no").alias("block"), "ahead", "behind"), ["k", "block"])
    return joined.groupBy("k", "block").applyInPandas(down, f"k long, no long, ahead {MATRIX}, behind {MATRIX}")


def encode_giants(giant: DataFrame, key: str, text: str, model_path: str, chunk: int = CHUNK_CHARS,
                  cache_units: int = CACHE_UNITS) -> DataFrame:
    """``k`` and the result columns of texts longer than a chunk; ``key`` must be unique."""
    context = 64
    fields = [f.split()[0] for f in RESULT.split(", ")]
    parts = reliable_checkpoint(_chunks(giant, key, text, chunk, context))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(model_path, cache_units)
        if code.rules.longest > context:
            raise ValueError("pieces longer than the chunks' context")
        for pdf in batches:
            inner = [code.inner(r.part, r.lo, r.hi) for r in pdf.itertuples()]
            m = [_records(code.matrix(r.part, r.lo, r.hi, r.begins, r.ends, i)) for r, i in zip(pdf.itertuples(), inner)]
            yield pd.DataFrame({"k": pdf["k"], "no": pdf["no"], "m": m, "inner": inner})

    mats = reliable_checkpoint(parts.mapInPandas(matrices, f"k long, no long, m {MATRIX}, inner binary"))
    most = mats.agg(F.max("no")).first()[0]
    ends = _scan(mats.drop("inner"), (most or 0) + 1)
    full = parts.join(ends, ["k", "no"]).join(mats, ["k", "no"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(model_path, cache_units)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ahead = {y: v for (_, y), v in _unpack(r.ahead).items()}
                behind = {x: v for (x, _), v in _unpack(r.behind).items()}
                own = {s: v + ahead[s[0]] + behind[s[1]] for s, v in _unpack(r.m).items() if s[0] in ahead and s[1] in behind}
                entry, leave = max(own, key=own.get)
                out.append(code.trace(r.part, r.lo, r.hi, entry, leave, r.ends, r.inner))
            yield pd.DataFrame({"k": pdf["k"], "no": pdf["no"], "ids": out})

    traced = full.mapInPandas(trace, "k long, no long, ids binary")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(pdf.sort_values("no")["ids"])
        return pd.DataFrame([(pdf["k"].iloc[0], *_finish(coder(model_path, cache_units), ids))], columns=["k", *fields])

    # One document's chunks meet again here: the document itself was one row before.  What needs Python
    # is done in this one step, so that a task never keeps two workers with a coder each.
    return traced.groupBy("k").applyInPandas(finish, f"k long, {RESULT}")


RESULT = "n_pieces long, ids binary, ids_crc32 long, decoded string"


def _finish(code: PieceCoder, ids: bytes) -> tuple:
    a = np.frombuffer(ids, dtype=code.dtype)
    wide = a.astype("<u4").tobytes()
    return len(a), wide, zlib.crc32(wide), code.decode(a)


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", chunk: int = CHUNK_CHARS,
                  cache_units: int = CACHE_UNITS) -> DataFrame:
    """All input rows and columns plus ``n_pieces``, ``ids`` (u32 little-endian), ``ids_crc32``, ``decoded``.

    Null and empty texts: no pieces and an empty decoded text; empty input: no rows;
    repeated rows are encoded alike; input columns named like a result column are
    replaced.  ``cache_units`` bounds the distinct units a Python worker keeps (twice).  A decoded text equals the input, except that a space mark in it becomes a space.
    """
    spark = df.sparkSession
    short_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    fields = [f.split()[0] for f in RESULT.split(", ")]
    df = df.drop(*fields)
    names = [F.col(f"`{c}`") for c in df.columns]
    s, key = free_name(df.columns, "coded"), free_name(df.columns, "giant_key")
    is_giant = F.coalesce(F.length(F.col(text_col)) >= chunk, F.lit(False))

    def make():
        code = coder(model_path, cache_units)
        return lambda texts: pd.DataFrame([_finish(code, b) for b in code.encode([t or "" for t in texts])], columns=fields)

    short = df.where(~is_giant).withColumn(s, per_text(RESULT, make, F.col(text_col)))
    # Numbered once and kept, so that the numbers survive the loss of an executor.
    giant = reliable_checkpoint(df.where(is_giant).withColumn(key, F.monotonically_increasing_id()))
    coded = encode_giants(giant, key, text_col, model_path, chunk, cache_units)
    long = giant.join(coded.withColumnRenamed("k", key), key)
    return short.select(*names, *[F.col(f"{s}.{f}").alias(f) for f in fields]).unionByName(long.select(*names, *fields))
