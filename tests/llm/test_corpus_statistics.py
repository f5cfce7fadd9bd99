"""Repeated passages, collocations and source divergence against brute force, on hand-made corners."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmap.llm import collocations, divergence, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, words string, first string"


def frame(spark, rows):
    """``(doc_id, text, lang, source)`` rows with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def prose(seed, n, words=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)] + ["Été", "don't", "x,y", "A.B"]
    return " ".join(rng.choice(vocab) for _ in range(n))


def corpus():
    """Copies, near copies, a common passage, nulls, empties, ties, a very long text."""
    passage, rng = prose(1, 60), random.Random(2)
    rows = [(1, prose(3, 300), "en", "a"), (2, prose(3, 300), "en", "a"), (2, prose(3, 300), "en", "b"), (None, prose(3, 300), "en", None),
            (3, None, "en", "a"), (4, "", None, None), (5, " \t\n", "de", ""), (6, "one two", "de", "x"), (7, prose(4, 13), "de", "x"),
            (8, prose(4, 13), "de", "y"), (9, prose(5, 20_000, 3000) + " " + prose(3, 300), "fr", "z"), (None, passage, "en", "a"),
            (10, "a " * 5000, "en", "a"), (11, "a " * 3000 + "b", "en", "b")]
    for i in range(30):
        cut = rng.randrange(40)
        rows.append((20 + i % 25, f"{prose(100 + i, 30)}\n{passage}  {passage[:60 + cut]}\x0b{prose(200 + i, 25)}.", "en", "abc"[i % 3]))
    return rows


def brute_repeats(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    ids = [1 << 63 if r[0] is None else r[0] for r in rows]
    least = {}
    for doc, w in zip(ids, words):
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for r, doc, w in zip(rows, ids, words):
        gone = set()
        for i in range(len(w) - 12):
            if least[tuple(w[i:i + 13])] < doc:
                gone.update(range(i, i + 13))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, shard", [(5000, 50_000), (3, 40)])    # with 3, anchors are split into windows
def test_repeats(spark, hot, shard):
    rows = corpus()
    got = repeats.drop_repeats(frame(spark, rows), hot_runs=hot, shard_windows=shard)
    assert got.columns == ["doc_id", "text", "lang", "source", "words", "first", "n_words", "n_removed", "kept_text"]
    got = sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)
    assert got == brute_repeats(rows)
    assert sum(g[2] for g in got) > 1000


def test_repeats_of_nothing(spark):
    assert repeats.drop_repeats(frame(spark, corpus()).limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_their_place():
    texts = [b"one two  three", b"", b"two\tthree", "zwölf two".encode(), b"x" * 3_000_000 + b" two"]
    got = {}
    for at, h, first in repeats._blocks(texts):
        for i in range(len(first) - 1):
            for word, code in zip(texts[at + i].split(), h[first[i]:first[i + 1]].tolist()):
                assert got.setdefault(word, code) == code
    assert len(set(got.values())) == len(got) == 5


def test_locate_finds_the_least_document_of_each_window():
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(13)]
    runs = [(" ".join(a).encode(), 5, 5), (" ".join(["z", *a[3:18]]).encode(), 2, 9), (" ".join(b).encode(), 1, 1)]
    got = repeats.locate(runs)
    assert got[0] == [None] * 3 + [2] * 3 + [None] * 2
    assert got[1] == [2, 2, 2, 2] and got[2] == [None]       # the run stands in two documents: each of its windows recurs


def brute_phrases(rows, least):
    n, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    n[lang][" ".join(w[i:i + k])] += 1
    return {lang: {p: c for p, c in f.items() if c >= least} for lang, f in n.items()}, total


def brute_collocations(rows, least, top):
    phrases, total = brute_phrases(rows, least)
    out = []
    for lang, f in phrases.items():
        found = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) < 2 or any(c >= a and f" {p} " in f" {q} " and q != p for q, c in f.items()):
                continue
            cuts = [(1000 * a * total[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, limit, top", [(3, 1000, 2000), (2, 1, 7), (4, 20, 50)])   # a small limit routes by more words
def test_collocations(spark, least, limit, top):
    rows = [r for r in corpus() if r[0] != 9]
    got = collocations.collocations(frame(spark, rows), least=least, top=top, bucket_rows=500, least_limit=limit, slots=64, held_rows=3000, coded=1 << 18 if least == 3 else 5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, least, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_collocations_of_little(spark):
    assert collocations.collocations(frame(spark, corpus()).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, "en", "a"), (2, "..", None, "a")]), least=1).count() == 0


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 5, (2000, 5)).astype(np.int32)
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    weights = rng.integers(1, 4, 2000)
    want = Counter()
    for row, weight in zip(rows.tolist(), weights.tolist()):
        for k in range(1, 6):
            if row[k - 1]:
                want[tuple(row[:k])] += weight
    for least in (1, 10, 60):
        got = collocations.quicksorted(rows, weights, least, 1)
        assert dict(got) == {p: n for p, n in want.items() if n >= least} and len(got) == len(dict(got))


def brute_divergence(rows, least_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        mine = sorted(s for l, s in groups if l == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in mine}
        every = {t: sum(count[lang, s][t] for s in mine) for t in kept}

        def share(n, whole):
            return 1 + 10**9 * (n + 1) // (whole + len(kept))

        def price(p, q):
            return (p - q) ** 2 // q

        for s in mine:
            pairs = [(-sum(price(share(count[lang, s][t], total[s]), share(count[lang, o][t], total[o])) for t in kept), o) for o in mine if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            mass = sum(every.values())
            terms = [(-price(share(count[lang, s][t], total[s]), share(every[t], mass)), t) for t in kept
                     if count[lang, s][t] and share(count[lang, s][t], total[s]) > share(every[t], mass)]
            out += [(lang, s, "term", t, -v, i) for i, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile, block, top", [(256, 4096, 200), (2, 16, 5)])
def test_divergence(spark, monkeypatch, tile, block, top):
    monkeypatch.setattr(divergence, "TILE_GROUPS", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rows = corpus() + [(900 + i, "only here here", "xx", f"s{i % 5}") for i in range(2)] + [(950, "alone", "yy", "s")]
    got = divergence.source_divergence(frame(spark, rows), term_ranks=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 3, top)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, corpus()).limit(0)).count() == 0


def test_quadtree_prices_like_the_whole_matrix():
    rng = np.random.default_rng(5)
    shares = np.where(rng.random((19, 300)) < 0.03, rng.integers(1, 10**9, (19, 300)), 0)
    shares[4] = 0
    shares[:, 100:180] = 0
    bare = rng.integers(1, 5000, 19)
    full = np.where(shares > 0, shares, bare[:, None])
    want = [[sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(a, b)) for b in full] for a in full]
    assert divergence.pair_values(shares, bare).tolist() == want


def test_kept_text_digest(spark):
    row = repeats.drop_repeats(spark.createDataFrame([(1, "a  b\tc")], "doc_id long, text string")).first()
    assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
