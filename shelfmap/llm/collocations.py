"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A first pass counts the words of each language, and counts leading words in fixed arrays of
``SLOTS`` hash slots.  A second pass makes one suffix (at most ``LONGEST`` words, cut at the
first rare word or at the end of its piece) per position, and routes it by language and its
two leading words; where their slot is over-full, by three, four or all five words, so
that no bucket outgrows a task.  Equal suffixes of a task are merged with their number.

A bucket's suffixes are sorted by multikey three-way quicksort: pointers are parted by the
word at one depth into less, equal and greater; the equal part is a phrase and its size
the phrase's count; it is sorted on at the next depth, down to the longest phrase.  A part
below the least count is abandoned.  Phrases shorter than their suffixes' routing depth
gather in several buckets, so Spark adds those up.

Two tables of fixed size reach the tasks.  A bitmap of ``SIEVE_BITS`` bits tells which words
are frequent: a rare word that passes it costs time, never a wrong count.  The ``CODED``
most frequent words (none longer than ``CODED_BYTES``) have numbers; other words travel as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import text_or_empty

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
SLOTS = 8192
SIEVE_BITS = 1 << 23
BITMAP_BITS = 32768           # bits of one bitmap of Spark's bitmap_construct_agg
BUCKET_ROWS = 300_000         # suffixes a bucket is meant to hold
LEAST_LIMIT = 1000
HELD_ROWS = 400_000           # words, or suffixes, a task merges at once
HELD_WORDS = 200_000          # distinct words a task remembers
CODED = 1 << 18
CODED_BYTES = 64
ID_BITS = 21                  # numbers of CODED words and HELD_WORDS more

BREAK = b"\xff"               # stands for a piece border; never part of UTF-8
_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b
               for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a UTF-8 text, with BREAK at the piece borders."""
    return text.translate(_SPLIT).replace(BREAK, b" \xff ").split()


def word_hash(lang: bytes, word: bytes) -> int:
    """The hash that Spark's xxhash64 gives for the language, a line feed and the word."""
    return xxhash.xxh64_intdigest(lang + b"\n" + word, seed=42)


class Words(dict):
    """Word -> number in one language; 0 for breaks and for words that ``wanted`` refuses.

    Coded words have their numbers from 1, others the next ones from ``first`` on.
    """

    def __init__(self, lang: str, coded: dict[bytes, int] | None = None, first: int = 1, wanted=None):
        super().__init__({BREAK: 0})
        self.lang, self.coded, self.first, self.wanted = lang.encode(), coded or {}, first, wanted
        self.names: list[bytes] = []
        self.own: list[int] = []
        self.of_coded = np.zeros(first, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        at, h = self.coded.get(word), word_hash(self.lang, word)
        if at is not None:
            self.of_coded[at] = h
        elif self.wanted is not None and not self.wanted(h):
            at = 0
        else:
            at = self.first + len(self.names)
            self.names.append(word)
            self.own.append(h)
        self[word] = at
        return at

    def numbers(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens(text)), dtype=np.int32)

    def hashes(self) -> np.ndarray:
        """By number, of the words met so far."""
        return np.concatenate([self.of_coded, np.array(self.own, dtype=np.uint64)])


def suffixes(numbers: np.ndarray) -> np.ndarray:
    """One row per position that starts at least two words: up to LONGEST numbers, then 0."""
    padded = np.concatenate([numbers, np.zeros(LONGEST, dtype=np.int32)])
    starts = np.flatnonzero((padded[:-1] > 0) & (padded[1:] > 0))
    rows = np.stack([padded[starts + i] for i in range(LONGEST)], axis=1)
    ended = np.logical_or.accumulate(rows == 0, axis=1)
    rows[ended] = 0
    return rows


def _prefix_slots(rows: np.ndarray, hashes: np.ndarray, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, hash, slot)`` of the leading 2, 3 ... words of each suffix."""
    h = hashes[rows[:, 0]]
    for d in range(1, LONGEST):
        h = (h ^ (h >> np.uint64(29))) * _ODD + hashes[rows[:, d]]
        x = h * np.uint64(0xBF58476D1CE4E5B9)
        yield d + 1, h, ((x >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)


def _count_words(slot_count: int, held_rows: int):
    """``lang, word, depth, slot, n``: counts of words (depth 1), and of leading words by slot; for mapInArrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        held: dict[str, list] = {}
        slots = np.zeros((LONGEST + 1, slot_count), dtype=np.int64)

        def sent():
            for lang, texts in held.items():
                words, numbers = known[lang], np.concatenate(texts)
                counts = np.bincount(numbers, minlength=len(words.names) + 1)
                for depth, _, slot in _prefix_slots(suffixes(numbers), words.hashes(), slot_count):
                    if depth < LONGEST:
                        slots[depth] += np.bincount(slot, minlength=slot_count)
                counts[0] = 0
                met = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(met), pa.string()), pa.array([words.names[i - 1] for i in met], pa.binary()).cast(pa.string()),
                     pa.array([1] * len(met), pa.int32()), pa.array([0] * len(met), pa.int32()), pa.array(counts[met], pa.int64())],
                    ["lang", "word", "depth", "slot", "n"])
            held.clear()

        words_held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if lang not in known:
                    known[lang] = Words(lang)
                numbers = known[lang].numbers(text.as_py())
                held.setdefault(lang, []).append(np.append(numbers, np.int32(0)))
                words_held += len(numbers) + 1
                if words_held >= held_rows or len(known[lang].names) >= HELD_WORDS:
                    yield from sent()
                    words_held = 0
                    if sum(map(len, known.values())) > HELD_WORDS:
                        known = {}
        yield from sent()
        depth, slot = np.nonzero(slots)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(slot), pa.string()), pa.nulls(len(slot), pa.string()), pa.array(depth, pa.int32()),
             pa.array(slot, pa.int32()), pa.array(slots[depth, slot], pa.int64())], ["lang", "word", "depth", "slot", "n"])
    return run


def quicksorted(rows: np.ndarray, weights: np.ndarray, least: int, shortest: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """Phrases of at least ``shortest`` words whose suffixes weigh ``least`` or more, with that weight."""
    found = []
    parts = [(np.arange(len(rows)), 0)]
    while parts:
        at, depth = parts.pop()
        words = rows[at, depth]
        pivot = np.sort(words[[0, len(words) // 2, -1]])[1]
        less, greater = words < pivot, words > pivot
        for part in (less, greater):
            kept = at[part]
            if len(kept) and weights[kept].sum() >= least:
                parts.append((kept, depth))
        equal = at[~(less | greater)]
        weight = int(weights[equal].sum())
        if pivot and weight >= least:
            if depth + 1 >= shortest:
                found.append((tuple(rows[equal[0], :depth + 1].tolist()), weight))
            if depth + 1 < rows.shape[1]:
                parts.append((equal, depth + 1))
    return found


def _merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the weight of each."""
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=bool)
    return rows[first], np.add.reduceat(weights, np.flatnonzero(first)) if len(rows) else weights


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as planes of their bytes, which compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _bucket_phrases(least: int, coded):
    """Phrases of each bucket's suffixes: a function for mapInArrow over rows sorted by bucket."""
    def phrases(lang: str, depth: int, held: list):
        first = len(coded.value[1])
        names: dict[bytes, int] = {}
        parts, weights = [], []
        for words, ids, weight in held:
            rows, count = _numbers(ids), _numbers(weight)
            if words:
                own = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int32) + first
                rows = np.where(rows < first, rows, own[np.maximum(rows - first, 0)])
            parts.append(rows.reshape(LONGEST, -1).T)
            weights.append(count)
        rows, weight, names = np.concatenate(parts).astype(np.int32), np.concatenate(weights).astype(np.int64), list(names)
        found = quicksorted(rows, weight, least, depth)
        for words in range(2, depth):                         # shared with other buckets: no count is abandoned
            prefix, total = _merged(rows[:, :words], weight)
            whole = prefix[:, -1] > 0
            found += zip(map(tuple, prefix[whole].tolist()), total[whole].tolist())

        def name(w):
            return coded.value[1][w] if w < first else names[w - first]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()),
             pa.array([b" ".join(map(name, p)) for p, _ in found], pa.binary()).cast(pa.string()),
             pa.array([n for _, n in found], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            bucket, lang, depth = (batch.column(i).to_pylist() for i in range(3))
            for i, now in enumerate(zip(bucket, lang, depth)):
                if now != key:
                    if held:
                        yield phrases(key[1], key[2], held)
                    key, held = now, []
                held.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py()))
        if held:
            yield phrases(key[1], key[2], held)
    return run


def _route_suffixes(sieve: bytes, coded, full: np.ndarray, buckets: int, held_rows: int):
    """Merged suffixes of each task by bucket: a function for mapInArrow."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sieve, dtype=np.uint8), bitorder="little").astype(bool)
        first = len(coded.value[1])
        known: dict[str, Words] = {}
        held: dict[str, list] = {}

        def sent():
            for lang, parts in held.items():
                rows = np.concatenate(parts)
                depth, code = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.uint64)
                for words, h, slot in _prefix_slots(rows, known[lang].hashes(), full.shape[1]):
                    here = (depth == 0) & (~full[words, slot] if words < LONGEST else True)
                    depth[here], code[here] = words, h[here]
                bucket = ((code * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                place = bucket * (LONGEST + 1) + depth
                wide = rows.astype(np.int64)
                if first + len(known[lang].names) < 1 << ID_BITS:
                    keys = [(wide[:, 3] << ID_BITS) | wide[:, 4], (wide[:, 0] << 2 * ID_BITS) | (wide[:, 1] << ID_BITS) | wide[:, 2], place]
                else:                                         # one text of very many words
                    keys = [*wide.T[::-1], place]
                order = np.lexsort(keys)
                place, new = place[order], np.zeros(len(order), dtype=bool)
                new[0] = True
                for k in keys:
                    k = k[order]
                    new[1:] |= k[1:] != k[:-1]
                at = np.flatnonzero(new)
                weights, rows, place = np.diff(np.append(at, len(order))), rows[order[at]], place[at]
                ends = np.flatnonzero(np.concatenate([np.diff(place) != 0, [True]])) + 1
                columns: list[list] = [[] for _ in kinds]
                names = known[lang].names
                for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    ids, own = rows[i:j].T.ravel(), []
                    far = ids >= first
                    if far.any():
                        used, number = np.unique(ids[far], return_inverse=True)
                        own, ids[far] = [names[w - first] for w in used.tolist()], number + first
                    for column, value in zip(columns, (int(place[i]) // (LONGEST + 1), lang, int(place[i]) % (LONGEST + 1), own,
                                                       _planes(ids), _planes(weights[i:j]))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["bucket", "lang", "depth", "words", "ids", "weights"])
            held.clear()

        rows_held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if lang not in known:
                    known[lang] = Words(lang, coded.value[0].get(lang), first, lambda h: bits[h % SIEVE_BITS])
                rows = suffixes(known[lang].numbers(text.as_py()))
                if len(rows):
                    held.setdefault(lang, []).append(rows)
                    rows_held += len(rows)
                if rows_held >= held_rows or len(known[lang].names) >= HELD_WORDS:
                    yield from sent()
                    rows_held = 0
                    if sum(map(len, known.values())) > HELD_WORDS:
                        known = {}
        yield from sent()
    return run


def _coded_words(words: DataFrame, most: int) -> tuple[dict[str, dict[bytes, int]], list[bytes]]:
    """Numbers by language of the ``most`` most frequent words, and the words by number from 1."""
    top = (words.where(F.octet_length("word") <= CODED_BYTES).orderBy(F.desc("n"), "lang", "word").limit(most)
           .select("lang", "word").toPandas())
    names = [b"", *(w.encode() for w in top["word"])]
    by_lang: dict[str, dict[bytes, int]] = {}
    for at, lang in enumerate(top["lang"], 1):
        by_lang.setdefault(lang, {})[names[at]] = at
    return by_lang, names


def _frequent_sieve(words: DataFrame) -> bytes:
    """A bitmap of SIEVE_BITS bits over the hashes of (lang, word); its size is fixed."""
    bit = F.pmod(F.xxhash64(F.concat_ws("\n", "lang", "word")), F.lit(SIEVE_BITS))
    parts = (words.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("part"))
             .agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits")).collect())
    out = bytearray(SIEVE_BITS // 8)
    for part in parts:
        out[part["part"] * BITMAP_BITS // 8:(part["part"] + 1) * BITMAP_BITS // 8] = part["bits"]
    return bytes(out)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT,
                  bucket_rows: int = BUCKET_ROWS, least_limit: int = LEAST_LIMIT, slots: int = SLOTS,
                  held_rows: int = HELD_ROWS, coded: int = CODED) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases ``lang, phrase, n`` of 1 to LONGEST words, and ``lang, total`` of all words."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    counted = reliable_checkpoint(
        texts.mapInArrow(_count_words(slots, held_rows), "lang string, word string, depth int, slot int, n long")
        .groupBy("lang", "word", "depth", "slot").agg(F.sum("n").alias("n")))
    every = counted.where("depth = 1").select("lang", "word", "n")
    words = every.where(F.col("n") >= least)

    # LONGEST - 2 times ``slots`` rows at most.
    leading = counted.where("depth > 1").select("depth", "slot", "n").toPandas()
    positions = int(leading.loc[leading["depth"] == 2, "n"].sum())
    buckets = max(-(-positions // bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    limit = max(positions // buckets, least_limit)
    full = np.zeros((LONGEST + 1, slots), dtype=bool)
    full[leading["depth"], leading["slot"]] = leading["n"] > limit

    numbers = spark.sparkContext.broadcast(_coded_words(words, coded))
    routed = texts.mapInArrow(_route_suffixes(_frequent_sieve(words), numbers, full, buckets, held_rows),
                              "bucket long, lang string, depth int, words array<binary>, ids binary, weights binary")
    phrases = (routed.repartition("bucket").sortWithinPartitions("bucket", "lang", "depth")
               .mapInArrow(_bucket_phrases(least, numbers), "lang string, phrase string, n long")
               .groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    frequent = words.select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases)
    return reliable_checkpoint(frequent), every.groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT,
                 top: int = TOP, **sizes) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` best collocations.

    Candidates are phrases of 2 to LONGEST words that occur ``least`` times or more.  The
    score is ``floor(1000 * a * n / (l * r))`` at the phrase's lowest-scoring cut (ties: the
    shortest first part), exact in decimals.  A candidate inside a longer candidate that
    occurs as often is dropped.  Ranks run by score and count descending, then phrase.

    Null text: as empty.  Null lang: ``und``.  Repeated rows count as documents of their
    own.  Texts without words, and empty input, give no rows.  Other columns are not read.
    """
    frequent, totals = phrase_counts(df, text_col, lang_col, least, **sizes)
    words = F.split("phrase", " ")
    candidates = reliable_checkpoint(frequent.withColumn("words", words).where(F.size("words") > 1)
                                     .select("lang", "phrase", "words", F.col("n").alias("a")))

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("cast(1000 * a as decimal(19,0)) * cast(total as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
              .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
              .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))

    inner = candidates.where(F.size("words") > 2).select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("length"))
    inner = inner.select("lang", "words", "a", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    longer = (inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return (kept.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
