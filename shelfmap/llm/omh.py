"""Near-duplicates by Order MinHash and banded alignment.

A text's words are lower-cased and stripped of punctuation at both ends; its k-mers are
windows of five words, labelled by their occurrence number.  Each of ``SKETCHES`` sketches
takes the ``ORDERED`` least hash values among the labelled k-mers and hashes them in their
order in the text, so that equal sketches tell of equal k-mers in equal order (edit
similarity), not only of common content.

Texts with equal normalised words are one node.  Nodes that share a sketch meet in a
bucket.  Two rounds join most of what belongs together: each node is compared with one hub,
the member of its buckets that shares most sketches with others, and then with one hub
outside that hub's component.  A node gives one candidate a round, so links stay fewer than nodes.

Buckets that still hold several components are searched in full, without pairing their members.
Each member orders its occurrence-labelled words by how rare they are, and keeps the first few: as many
as two alike texts can differ in, plus one.  Two alike texts share one of these, so only
members that do are paired; a passage that all of them share comes last and pairs nobody.
A pair must also lie in different components, be of like length, and differ little enough in a
histogram of their words.  What is left is compared by banded alignment of the two word
sequences: a link matches at least 0.8 of the words of both together (words matched in order,
over words of either).  Classes are the connected components of the links: those of all
pairs that share a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import TwoGenerations, free_name, kept, per_text, short_batches
from .components import connected_components, stored

SHINGLE = 5
SKETCHES = 24
ORDERED = 2
SIMILARITY = 0.8
HOT_SHARE = 512
LEADER_SPREAD = 64
RARITY_SLOTS = 1 << 16
BINS = 256
CLASS_ROWS = 20_000           # rows of a bucket that one task pairs; a larger bucket is dealt by words
FIRST_PAIRS = 4
PAIRS_AT_ONCE = 1 << 20
CACHE_WORDS = 200_000
ROWS_AT_ONCE = 1 << 16

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")
_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHasher:
    """64-bit hashes of normalised words, cached per Python worker."""

    def __init__(self):
        self.cache = TwoGenerations(CACHE_WORDS)

    def hashes(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text)
        known = self.cache.room()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        for w in set(words).difference(known):
            if self.cache.promote(w) is None:
                known[w] = xxhash.xxh64_intdigest(_EDGE.sub("", w.lower()) or w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def hasher() -> WordHasher:
    return kept("words", WordHasher)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def kmers(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word windows, each labelled by how often it occurred before."""
    n = max(len(words) - k + 1, 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        h = _mix(h + words[i:i + n]) if len(words) >= k else _mix(h + words[i:i + 1])
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        seen = np.zeros(n, dtype=np.uint64)
        seen[order] = (at - first).astype(np.uint64)
        h = np.where(seen > 0, _mix(h + seen * _ODD), h)      # a first occurrence is labelled alike in every text
    return h


def sketches(grams: np.ndarray, count: int = SKETCHES, ordered: int = ORDERED) -> np.ndarray:
    """One 64-bit value per sketch: its ``ordered`` least labelled k-mers in text order."""
    seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    take = min(ordered, len(grams))
    if len(grams) <= ROWS_AT_ONCE:
        rows = _mix(grams[None, :] ^ seeds[:, None])
        at = np.argpartition(rows, take - 1, axis=1)[:, :take] if take < len(grams) else np.tile(np.arange(len(grams)), (count, 1))
    else:                                        # one sketch at a time for very long texts
        at = np.stack([np.argpartition(_mix(grams ^ s), take - 1)[:take] for s in seeds])
    at = np.sort(at, axis=1)
    out = seeds.copy()
    for i in range(take):
        out = _mix(out + grams[at[:, i]])
    return out


def sequence_key(words: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(words.tobytes())


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether an alignment matches at least ``least`` of the words of both sequences.

    With L words matched in order, L / (len(a) + len(b) - L) >= least allows at most
    (len(a) + len(b)) (1 - least) / (1 + least) unmatched words, so only that many
    diagonals to either side can hold the alignment: the band.  Rows are bit vectors of
    the band's columns.
    """
    total = len(a) + len(b)
    if not total:
        return True
    need = int(np.ceil(least / (1 + least) * total - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    head = 0
    most = min(len(a), len(b))
    diff = np.flatnonzero(a[:most] != b[:most])
    head = int(diff[0]) if len(diff) else most
    a, b = a[head:], b[head:]
    most = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:most] != b[::-1][:most])
    tail = int(diff[0]) if len(diff) else most
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    common, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    return banded_matches(a.tolist(), b.tolist(), len(a) + len(b) - 2 * need) >= need


def banded_matches(a: list[int], b: list[int], band: int) -> int:
    """Most words matched in order within ``band`` diagonals of the main one."""
    block, n, m = max(1024, band), len(a), len(b)
    lo, width, v, done = 0, 0, 0, 0
    for start in range(0, n, block):
        stop = min(n, start + block)
        new_lo, high = min(max(0, start - band), m), min(m, stop + band)
        drop = min(new_lo - lo, width)
        if drop > 0:                              # columns left of the band no longer change
            done += drop - (v & ((1 << drop) - 1)).bit_count()
            v >>= drop
            width -= drop
        lo = new_lo
        grow = high - lo - width
        if grow > 0:
            v |= ((1 << grow) - 1) << width
            width += grow
        places: dict[int, int] = {}
        for j in range(width):
            w = b[lo + j]
            places[w] = places.get(w, 0) | (1 << j)
        mask = (1 << width) - 1
        for i in range(start, stop):
            u = places.get(a[i])
            if u is not None:
                u &= v
                v = ((v + u) | (v - u)) & mask
    return done + width - v.bit_count()


def _join_hot(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of many rows with one value row per key; keys with a large share of the rows are broadcast.

    At most HOT_SHARE keys can hold that share each, so the broadcast side is bounded.
    """
    n = rows.count()
    hot = [r[0] for r in rows.groupBy(key).count().where(F.col("count") * HOT_SHARE >= max(n, HOT_SHARE))
           .where("count > 1").select(key).collect()]
    if not hot:
        return rows.join(values, key, "left")
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(values, key, "left").unionByName(
        rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key, "left"))


def _seqs_udf(text: Column) -> Column:
    def make():
        def work(texts):
            h = [hasher().hashes(t or "") for t in texts]
            return pd.DataFrame({"node": [sequence_key(w) for w in h], "seq": [w.tobytes() for w in h]})
        return work
    return per_text("node binary, seq binary", make, text)


def _sketch_udf(text: Column) -> Column:
    def make():
        def work(texts):
            out = []
            for t in texts:
                w = hasher().hashes(t or "")
                s = sketches(kmers(w)) if len(w) else np.zeros(0, dtype=np.uint64)
                out.append((sequence_key(w), len(w), s.view(np.int64)))
            return pd.DataFrame(out, columns=["node", "n_words", "sketch"])
        return work
    return per_text("node binary, n_words long, sketch array<long>", make, text)


def _verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sequences are alike; ``b`` may be the leader of very many pairs.

    Pairs and leaders are as many as the nodes' share, so the joins are by sorting at every size.
    """
    spread = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LEADER_SPREAD).cast("int").alias("copies"))
    left = pairs.join(spread, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    left = left.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")).hint("merge"), "a")
    right = (spread.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")).hint("merge"), "b")
             .select("b", "seq_b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [alike(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                  for x, y in zip(pdf["seq_a"], pdf["seq_b"])]
            yield pdf.loc[ok, ["a", "b"]]

    return left.drop("copies").join(right.hint("merge"), ["b", "salt"]).select("a", "b", "seq_a", "seq_b") \
        .mapInPandas(verify, "a binary, b binary")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_members(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets with several components, with their label and the bucket's size."""
    m = _labelled(members, labels)
    several = (m.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
               .where("low != high").select("bucket", "size"))
    return m.join(several, "bucket")


def _candidates(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """At most one pair per node: itself and the best hub, of another component, that it can be alike to.

    A bucket's hub is its most popular member; with ``labels``, the most popular one outside the
    first hub's component.
    """
    m = _open_members(members, labels)
    hub = F.max(F.struct("popular", "node", "label", "n_words")).alias("hub")
    hubs = m.groupBy("bucket").agg(hub)
    if labels is not None:
        hubs = (m.join(hubs.select("bucket", F.col("hub.label").alias("main")), "bucket").where("label != main")
                .groupBy("bucket").agg(hub))
    near = F.least("n_words", "hub.n_words") >= F.lit(SIMILARITY) * F.greatest("n_words", "hub.n_words")
    return (m.join(hubs, "bucket").where(F.col("label") != F.col("hub.label")).where(near)
            .groupBy(F.col("node").alias("a")).agg(F.max(F.struct("hub.popular", "hub.node")).alias("best"))
            .select("a", F.col("best.node").alias("b")))


def prefix_sizes(n: int) -> tuple[int, int]:
    """How many of the first words of a text of ``n`` words an alike text must share one of: the longer one, the shorter one.

    With t the similarity, alike texts share ``t / (1 + t) * (n + m)`` words: at least ``2 t / (1 + t) * n`` if n is
    the smaller length, and ``t * n`` at any rate.
    """
    shorter = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9))
    longer = int(np.ceil(SIMILARITY * n - 1e-9))
    return n - shorter + 1, n - longer + 1


def _slot(grams: np.ndarray) -> np.ndarray:
    return (_mix(grams) >> np.uint64(48)).astype(np.int64)          # RARITY_SLOTS of them


def word_features(seq: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """``(first words, how many of them count for the shorter text, histogram)``.

    Words are labelled by occurrence and ordered by the count of their hash slot, then by
    hash: one order for all texts, rare words first.
    """
    grams = kmers(seq, 1)
    shorter, longer = prefix_sizes(len(grams))
    order = np.lexsort((grams, rarity[_slot(grams)]))[:longer]
    bins = np.bincount((_mix(seq) >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return grams[order], shorter, np.minimum(bins, 255).astype(np.uint8)


def paired(label: np.ndarray, n_words: np.ndarray, shorter: np.ndarray, words: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Pairs ``(i, j)``, i below j, of members of one bucket that lie in different components and can be alike."""
    main = np.bincount(label).argmax()
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    rank = np.concatenate([np.arange(len(w)) for w in words])
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    word, owner, rank = word[order], owner[order], rank[order]
    edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
    many = np.flatnonzero(np.diff(edges) > 1)
    found, held = [], 0

    def sifted(codes):
        codes = np.unique(np.concatenate(codes))
        i, j = codes // len(words), codes % len(words)
        gap = np.zeros(len(i), dtype=np.int64)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            gap[cut] = np.abs(bins[i[cut]].astype(np.int16) - bins[j[cut]].astype(np.int16)).sum(axis=1)
        total = n_words[i] + n_words[j]
        ok = gap * (1 + SIMILARITY) <= total * (1 - SIMILARITY) + 1e-6
        return codes[ok], gap[ok]

    out = []
    for at in many.tolist():
        o, r = owner[edges[at]:edges[at + 1]], rank[edges[at]:edges[at + 1]]
        rest = label[o] != main
        if not rest.any():
            continue
        counts = shorter[o] > r
        for k in np.flatnonzero(rest).tolist():               # the rest among themselves once, and each with the main component
            mate = (label[o] != label[o[k]]) & (~rest | (np.arange(len(o)) > k))
            a, b = n_words[o[k]], n_words[o]
            mate &= np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9
            mate &= np.where(a < b, counts[k], np.where(a > b, counts, counts | counts[k]))
            x = o[mate]
            if len(x):
                found.append(np.minimum(x, o[k]) * len(words) + np.maximum(x, o[k]))
                held += len(x)
        if held > PAIRS_AT_ONCE:
            out.append(sifted(found))
            found, held = [], 0
    if found:
        out.append(sifted(found))
    if not out:
        return np.zeros((0, 3), dtype=np.int64)
    codes, gap = (np.concatenate(x) for x in zip(*out))
    codes, at = np.unique(codes, return_index=True)
    return np.stack([codes // len(words), codes % len(words), gap[at]], axis=1)


def _rarity(seqs: DataFrame) -> np.ndarray:
    """Occurrences of labelled words by hash slot: RARITY_SLOTS numbers, however many words there are."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(RARITY_SLOTS, dtype=np.int64)
        for pdf in batches:
            for seq in pdf["seq"]:
                total += np.bincount(_slot(kmers(np.frombuffer(seq, dtype=np.uint64), 1)), minlength=RARITY_SLOTS)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    rows = seqs.select("seq").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(RARITY_SLOTS, dtype=np.int64)
    out[rows["slot"]] = rows["n"]
    return out


def _open_pairs(members: DataFrame, labels: DataFrame, seqs: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Pairs ``a, b, gap`` of nodes that share a bucket, lie in different components and can be alike.

    A pair that shares several open buckets is given by the least of them.
    """
    rows = stored(_open_members(members, labels), "open")
    rarity = _rarity(seqs)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [word_features(np.frombuffer(s, dtype=np.uint64), rarity) for s in pdf["seq"]]
            yield pd.DataFrame({"node": pdf["node"], "words": [g[0].view(np.int64) for g in got],
                                "shorter": [g[1] for g in got], "bins": [g[2].tobytes() for g in got]})

    shaped = seqs.mapInPandas(features, "node binary, words array<long>, shorter int, bins binary")
    # A bucket too large for one task is dealt by word: each part holds the members with words of its class.
    parts = F.when(F.col("size") > class_rows, F.ceil(F.col("size") * F.size("words") / class_rows)).otherwise(1)
    rows = rows.join(shaped, "node").join(rows.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node")
    widest = rows.where(F.col("size") > class_rows).groupBy("bucket").agg(F.max(parts).alias("parts"))
    rows = rows.join(widest, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    part = F.explode(F.array_distinct(F.transform("words", lambda w: F.pmod(w, F.col("parts")))))
    rows = (rows.withColumn("part", part)
            .select("bucket", "part", "parts", "node", "label", "n_words", "shorter", "words", "bins", "buckets")
            .repartition("bucket", "part").sortWithinPartitions("bucket", "part"))

    def pairs(bucket: int, held: list[tuple]) -> pd.DataFrame:
        part, parts, node, label, n_words, shorter, words, bins, buckets = zip(*held)
        label = pd.factorize(pd.Series(label))[0]
        words = [np.asarray(w, dtype=np.int64) for w in words]
        ranks = np.array(shorter)
        if parts[0] > 1:                                      # ranks count only the words of this class
            mine = [w % parts[0] == part[0] for w in words]
            ranks = np.array([int(m[:s].sum()) for m, s in zip(mine, shorter)])
            words = [w[m] for w, m in zip(words, mine)]
        got = paired(label, np.array(n_words), ranks, words, np.stack([np.frombuffer(b, dtype=np.uint8) for b in bins]))
        buckets = [set(x) for x in buckets]
        got = got[[min(buckets[i] & buckets[j]) == bucket for i, j in got[:, :2].tolist()]] if len(got) else got
        a, b = ([node[i] for i in got[:, k]] for k in (0, 1))
        return pd.DataFrame({"a": [min(x) for x in zip(a, b)], "b": [max(x) for x in zip(a, b)], "gap": got[:, 2]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if row[:2] != key:
                    if len(held) > 1:
                        yield pairs(key[0], held)
                    key, held = row[:2], []
                held.append(row[1:])
        if len(held) > 1:
            yield pairs(key[0], held)

    return rows.mapInPandas(search, "a binary, b binary, gap long").groupBy("a", "b").agg(F.min("gap").alias("gap"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after the links ``a, b`` between nodes of the components ``labels``."""
    between = links
    for end in ("a", "b"):
        between = between.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left") \
            .withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
    to = connected_components(between.where("a != b"))
    every = labels.select("node", "label").unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("label"))) \
        .unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")))
    # A node that had a label keeps the least one: a label is the least node of its component.
    every = every.groupBy("node").agg(F.min("label").alias("label"))
    return stored(every.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
                  .select("node", F.coalesce("to", "label").alias("label")), "labels")


def _searched(pairs: DataFrame, labels: DataFrame, seqs: DataFrame) -> DataFrame:
    """Labels after all ``pairs`` are compared or found in one component: the likeliest few of each node first."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))
    pairs = stored(pairs.withColumn("rank", rank), "pairs")
    for some in (pairs.where(F.col("rank") <= FIRST_PAIRS), pairs.where(F.col("rank") > FIRST_PAIRS)):
        for end in ("a", "b"):
            some = some.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
        apart = some.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
        links = stored(_verified(stored(apart, "apart"), seqs), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
    return labels


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, node, class_id, class_size, class_kept``.

    ``node`` stands for the normalised words, ``class_id`` is the least identifier of the
    class (null if all are null), ``class_size`` counts its rows, and ``class_kept`` marks
    the document that stays: the one with the least identifier (of several texts with that
    identifier, the one with the least node).

    Null text: as empty.  All texts without words are one class; a text of fewer than five
    words forms one k-mer.  Repeated rows (same identifier and words) are one document,
    counted as rows and kept or dropped together.  Empty input: no rows.
    """
    short_batches(df.sparkSession)
    base = df.select(F.col(id_col).alias("id"), _sketch_udf(F.col(text_col)).alias("s"))
    base = reliable_checkpoint(base.select("id", "s.node", "s.n_words", "s.sketch"))

    nodes = base.groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    distinct = base.dropDuplicates(["node"]).select("node", "n_words", F.explode("sketch").alias("bucket"))
    shared = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = reliable_checkpoint(distinct.join(shared, "bucket"))
    popular = members.groupBy("node").agg(F.sum("size").alias("popular"))
    members = reliable_checkpoint(members.drop("size").join(popular, "node"))

    wanted = members.select("node").distinct().join(nodes, "node").select("node", "first_id")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    # Sorted at every size: most texts are wanted, so a broadcast of their nodes only pays on small tables.
    texts = (texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["first_id"]))
             .select(F.col("node").alias("want"), _seqs_udf(F.col("t")).alias("s")))
    seqs = reliable_checkpoint(texts.where(F.col("want") == F.col("s.node")).select("s.node", "s.seq").dropDuplicates(["node"]))

    links = stored(_verified(stored(_candidates(members, None), "hubs"), seqs), "links")
    labels = connected_components(links)
    # What follows concerns open buckets only, a small part of the members and of the sequences.
    members = stored(_open_members(members, labels).select(*members.columns), "open")
    seqs = stored(seqs.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "seqs")
    found = stored(_verified(stored(_candidates(members, labels), "hubs"), seqs), "links")
    if not found.isEmpty():
        labels = _joined(labels, found)
    labels = _searched(_open_pairs(members, labels, seqs), labels, seqs)

    classed = reliable_checkpoint(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = classed.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("class_size"))
    by_node = _join_hot(classed.select("node", "label", "first_id"), classes, "label")
    is_first = F.col("first_id").eqNullSafe(F.col("class_id"))
    keeper = by_node.where(is_first).groupBy("label").agg(F.min("node").alias("keeper"))
    by_node = reliable_checkpoint(_join_hot(by_node, keeper, "label").select("node", "class_id", "class_size", "keeper"))
    out = _join_hot(base.select("id", "node"), by_node, "node")
    return out.select("id", "node", "class_id", "class_size",
                      ((F.col("node") == F.col("keeper")) & F.col("id").eqNullSafe(F.col("class_id"))).alias("class_kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one document per class, with the input's columns."""
    gone = (near_classes(df, id_col, text_col).where(~F.col("class_kept"))
            .select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")).distinct())
    n = free_name(df.columns, "words_key")
    keyed = df.withColumn(n, _seqs_udf(F.col(text_col))["node"])
    return keyed.join(gone, F.col(id_col).eqNullSafe(F.col("gone_id")) & (F.col(n) == F.col("gone_node")), "left_anti") \
        .select(*[F.col(f"`{c}`") for c in df.columns])
