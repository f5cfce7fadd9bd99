"""Substring dedup: words of passages that already occur in an earlier document are removed.

A window is ``WINDOW`` consecutive words.  Three steps, each over all documents:

1. Sieve.  A window's anchor is the least hash of its ``GRAM``-word shingles, so equal windows
   have equal anchors, and a text has about one anchor in five words.  Anchors that occur in
   two distinct texts can hold a recurring window; all others are done.
2. Passages.  The windows of a text with one such anchor form a run of words.  Equal runs are
   merged, and all runs of an anchor meet in one task, where the windows that lie in several
   documents are confirmed by their words.
3. Automata.  A task takes as many anchors as make about ``SHARD_WINDOWS`` windows, compiles
   their confirmed windows into one Aho-Corasick automaton over words, and streams every
   run of these anchors through it: each hit carries the least document that holds the window.

Hits return to their texts, and a word goes if a window over it also starts in a lesser
document.  Copies of a whole text need no windows: all but those with its least identifier
lose all their words (if it has a window).  An anchor with more than ``HOT_RUNS`` runs, such as
one inside a very common line, is split into single windows, each routed by its own hash.

Hashes only choose what is compared; windows are confirmed and located by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, text_or_empty

WINDOW = 13
GRAM = 5
HOT_RUNS = 5000
SHARD_WINDOWS = 50_000
HELD_RUNS = 100_000           # distinct runs a task merges before it sends them on
CHUNK_BYTES = 1 << 20
LAST = (1 << 63) - 1          # a null identifier sorts after all others

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(_BASE)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_STEP = np.array([xxhash.xxh64_intdigest(bytes([i, 1])) | 1 for i in range(WINDOW)], dtype=np.uint64)
_POWERS = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2^64."""
    if n <= CHUNK_BYTES and _POWERS:
        return _POWERS["all"]
    size = max(n, CHUNK_BYTES)
    both = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
                 for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    if size == CHUNK_BYTES:
        _POWERS["all"] = both
    return both


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end; ``buf`` ends with white space."""
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        part = buf[base:int(ends[j - 1])]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[:len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return _mix(out + (ends - starts).astype(np.uint64) * _ODD)


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out += h[i:i + n] * _STEP[i]
    return _mix(out)


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least hash of its shingles."""
    if len(h) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    out, have = _windows(h, GRAM), 1
    while have < WINDOW - GRAM + 1:
        step = min(have, WINDOW - GRAM + 1 - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, word hashes, first word of each text and the end)`` for about CHUNK_BYTES of texts at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and size < CHUNK_BYTES:
            size += len(texts[stop]) + 1
            stop += 1
        buf = np.frombuffer(b" ".join(texts[at:stop]) + b" ", dtype=np.uint8)
        starts, ends = word_spans(buf)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[at:stop])])
        yield at, word_hashes(buf, starts, ends), np.searchsorted(starts, offsets)
        at = stop


def _text_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor, code, runs``: each distinct anchor of a text, for the row that stands for the text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        codes = batch.column("code").to_numpy()
        for at, h, first in _blocks(texts):
            a = anchors(h)
            words = np.diff(first)
            text = np.repeat(np.arange(len(words)), words)[:len(a)]
            whole = np.arange(len(a)) + WINDOW <= first[text + 1] if len(a) else np.zeros(0, dtype=bool)
            a, text = a[whole], text[whole]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]) if len(a) else whole
            a, text = a[new], text[new]
            order = np.lexsort((a, text))
            a, text = a[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])) if len(a) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[new].view(np.int64)), pa.array(codes[at + text[new]]),
                 pa.array(np.diff(np.append(new, len(a))).astype(np.int32))], ["anchor", "code", "runs"])


def text_runs(text: bytes, h: np.ndarray, flags: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``(route, first word, words)`` of each run of windows whose anchor is among the sorted ``flags``."""
    a = anchors(h)
    if not len(a) or not len(flags):
        return
    at = np.minimum(np.searchsorted(flags, a), len(flags) - 1)
    hit = flags[at] == a
    hot_hit = hit & hot[at]
    words = text.split()
    where = np.flatnonzero(hit & ~hot_hit)
    if len(where):
        parts = np.flatnonzero((np.diff(where) != 1) | (np.diff(a[where].view(np.int64)) != 0)) + 1
        for i, j in zip(where[np.concatenate([[0], parts])].tolist(), where[np.concatenate([parts, [len(where)]]) - 1].tolist()):
            yield int(a[i]), i, b" ".join(words[i:j + WINDOW])
    where = np.flatnonzero(hot_hit)
    if len(where):
        route = _windows(h, WINDOW)
        for i in where.tolist():
            yield int(route[i]), i, b" ".join(words[i:i + WINDOW])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator]]:
    for batch in batches:
        rows = batch.select(["code", "first"]).to_pylist()
        flagged = batch.column("flags")
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for at, h, first in _blocks(texts):
            for i in range(len(first) - 1):
                flags = flagged[at + i].values
                name = flags.field("anchor").to_numpy().view(np.uint64)
                order = np.argsort(name)
                hot = flags.field("hot").to_numpy(zero_copy_only=False)
                yield rows[at + i], text_runs(texts[at + i], h[first[i]:first[i + 1]], name[order], hot[order])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distinct_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``route, run, words, low, high``: the distinct runs of a task, with the least and greatest document of each."""
    held: dict = {}

    def sent():
        routes, words = [k[0] for k in held], [k[1] for k in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([_signed(r) for r in routes], pa.int64()),
             pa.array([_signed(xxhash.xxh64_intdigest(w)) for w in words], pa.int64()), pa.array(words, pa.binary()),
             pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            ["route", "run", "words", "low", "high"])

    for row, runs in _runs(batches):
        doc = row["first"]
        for route, _, words in runs:
            had = held.get((route, words))
            held[route, words] = (doc, doc) if had is None else (min(had[0], doc), max(had[1], doc))
        if len(held) >= HELD_RUNS:
            yield sent()
            held.clear()
    yield sent()


def _placed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``route, run, code, first, start``: where each run stands."""
    rows: list[tuple] = []
    names = ["route", "run", "code", "first", "start"]
    kinds = (pa.int64(),) * 4 + (pa.int32(),)

    def sent():
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for row, runs in _runs(batches):
        for route, start, words in runs:
            rows.append((_signed(route), _signed(xxhash.xxh64_intdigest(words)), row["code"], row["first"], start))
        if len(rows) >= HELD_RUNS:
            yield sent()
            rows.clear()
    yield sent()


class _Letters(dict):
    """One character per distinct word of a shard."""

    def __missing__(self, word: bytes) -> str:
        self[word] = letter = chr(len(self) + 1)
        return letter


def locate(runs: list[tuple[bytes, int, int]]) -> list[list[int | None]]:
    """For each ``(words, low, high)`` run and each of its windows the least document that holds it, or None.

    ``low`` and ``high`` are the least and greatest documents of the run.  Windows of one
    document only give None.
    """
    letters = _Letters()
    texts = ["".join(map(letters.__getitem__, words.split(b" "))) for words, _, _ in runs]
    low: dict[str, int] = {}
    high: dict[str, int] = {}
    for text, (_, least, most) in zip(texts, runs):
        for i in range(len(text) - WINDOW + 1):
            window = text[i:i + WINDOW]
            if window in low:
                low[window], high[window] = min(low[window], least), max(high[window], most)
            else:
                low[window], high[window] = least, most
    automaton = ahocorasick.Automaton()
    for window, least in low.items():
        if least < high[window]:
            automaton.add_word(window, least)
    out: list[list[int | None]] = [[None] * (len(text) - WINDOW + 1) for text in texts]
    if len(automaton):
        automaton.make_automaton()
        for text, found in zip(texts, out):
            for end, least in automaton.iter(text):
                found[end - WINDOW + 1] = least
    return out


def _located(shard_windows: int):
    """``route, run, least`` of the runs with a window that an earlier document holds: a function for rows sorted by route."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def sent():
            found = locate([row[2:] for row in held])
            kept = [(row[0], row[1], least) for row, least in zip(held, found)
                    if any(v is not None and v < row[4] for v in least)]
            columns = zip(*kept) if kept else [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["route", "run", "least"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("route", "run", "words", "low", "high"))):
                if row[0] != last and size >= shard_windows:
                    yield sent()
                    held.clear()
                    size = 0
                held.append(row)
                size += row[2].count(b" ") + 2 - WINDOW
                last = row[0]
        if held:
            yield sent()
    return run


def kept_words(text: bytes, covered: list[int] | None, copy: bool) -> tuple[int, int, bytes]:
    """``(words, removed, kept text)``; ``covered`` lists the windows to remove, ``copy`` removes all."""
    words = text.split()
    n = len(words)
    if copy and n >= WINDOW:
        return n, n, b""
    if copy or not covered:
        return n, 0, b" ".join(words)
    gone = np.zeros(n + 1, dtype=np.int32)
    at = np.unique(np.array(covered, dtype=np.int64))
    np.add.at(gone, at, 1)
    np.add.at(gone, at + WINDOW, -1)
    stays = np.cumsum(gone)[:n] == 0
    return n, n - int(stays.sum()), b" ".join(compress(words, stays.tolist()))


def _judge(names: list[str], result: tuple[str, ...]):
    """The input columns ``names`` with the result columns: a function for mapInArrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, place, first, covered = (batch.column(len(names) + i) for i in range(4))
            copy = [a > b for a, b in zip(place.to_pylist(), first.to_pylist())]
            done = [kept_words(t.as_py(), c, b) for t, c, b in zip(text.cast(pa.binary()), covered.to_pylist(), copy)]
            columns = [batch.column(i) for i in range(len(names))]
            more = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                    pa.array([d[2] for d in done], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + more, [*names, *result])
    return run


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS,
                 shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """All input rows and columns plus ``n_words``, ``n_removed`` and ``kept_text``.

    A word is removed if one of the windows over it also starts in a document with a smaller
    identifier (an integer); windows are judged on the input.  ``kept_text`` joins the kept
    words by one space.

    Null text: as empty.  Null identifier: greater than all others.  Rows with one identifier
    don't remove each other's words.  A text of fewer than WINDOW words keeps all.  Empty
    input: no rows.  Input columns named like a result column are replaced.
    """
    result = ("n_words", "n_removed", "kept_text")
    df = df.drop(*result)
    names = df.columns
    code, key, known, found = (free_name([*names, *result], n) for n in ("code", "key", "known", "found"))
    text, place = text_or_empty(F.col(f"`{text_col}`")), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    # Every step joins these rows by the texts' hash, on one exchange that Spark makes once (if there are no more columns).
    keyed = df.withColumn(code, F.xxhash64(text)).withColumn(key, F.unhex(F.md5(text)))
    texts = (keyed.groupBy(F.col(code).alias("code"), F.col(key).alias("key")).agg(F.min(place).alias("first")))
    of_code = texts.groupBy("code").agg(F.collect_list(F.struct("key", "first")).alias("texts"))

    def standing(side: DataFrame, *more: str) -> DataFrame:
        """The rows that stand for their text, with the columns ``more`` of ``side``."""
        name = {c: free_name(keyed.columns, f"{c}_of_side") for c in side.columns}
        rows = keyed.join(side.withColumnsRenamed(name), F.col(code) == F.col(name["code"]))
        first = F.get(F.filter(name["texts"], lambda t: t["key"] == F.col(key)), F.lit(0))["first"]
        return rows.where(place == first).select(F.col(code).alias("code"), first.alias("first"), text.alias("text"),
                                                 *(F.col(name[c]).alias(c) for c in more))

    sieved = standing(of_code).mapInArrow(_text_anchors, "anchor long, code long, runs int")
    shared = (sieved.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs"))
              .where("n > 1").select("anchor", (F.col("runs") > hot_runs).alias("hot")))
    flags = (sieved.select("anchor", "code").join(shared, "anchor").groupBy("code")
             .agg(F.collect_set(F.struct("anchor", "hot")).alias("flags")))
    flagged = standing(of_code.join(flags, "code"), "flags")

    distinct = (flagged.mapInArrow(_distinct_runs, "route long, run long, words binary, low long, high long")
                .repartition("route").groupBy("route", "run", "words").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                .sortWithinPartitions("route"))
    located = distinct.mapInArrow(_located(shard_windows), "route long, run long, least array<long>")
    placed = flagged.mapInArrow(_placed_runs, "route long, run long, code long, first long, start int")
    gone = F.filter(F.transform("least", lambda v, i: F.when(v < F.col("first"), F.col("start") + i)), lambda v: v.isNotNull())
    covered = (placed.join(located, ["route", "run"]).select("code", F.col("first").alias("place"), gone.alias("gone"))
               .where(F.size("gone") > 0).groupBy("code", "place").agg(F.flatten(F.collect_list("gone")).alias("gone"))
               .groupBy("code").agg(F.collect_list(F.struct("place", "gone")).alias("found")))

    whole = of_code.join(covered, "code", "left").select(F.col("code").alias(f"{code}_"), F.col("texts").alias(known), F.col("found").alias(found))
    out = keyed.join(whole, F.col(code) == F.col(f"{code}_")).select(
        *(F.col(f"`{c}`") for c in names), text, place,
        F.get(F.filter(known, lambda t: t["key"] == F.col(key)), F.lit(0))["first"],
        F.get(F.filter(found, lambda t: t["place"] == place), F.lit(0))["gone"])
    out = out.toDF(*names, *(free_name(names, n) for n in ("plain", "place", "least", "gone")))
    fields = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    return out.mapInArrow(_judge(names, result), fields)
