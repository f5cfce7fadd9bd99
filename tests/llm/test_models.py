"""Classifiers, near-duplicates and the pipeline: brute force, held-out accuracy, edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from shelfmap.llm import components, docstats, exact_dedup, omh, quality_pu, quality_trees, queries, toxicity
from shelfmap.llm.common import held_out

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
    dup = sum(bool(WORD.search(s)) and s in lines[:i] for i, s in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


TEXTS = [None, "", "a", "a b c", "a b c a b c", "a b c\na b c\n\n \n#|x<>", "x x x x x", "é ü\n é ü \né ü", "w " * 5000, "q" * 100_000]


def test_document_statistics():
    for t in TEXTS:
        assert docstats.features(t)[0] == brute_counts(t), (t or "")[:20]
    rng = np.random.default_rng(0)
    for _ in range(60):
        t = " ".join(rng.choice(list("abc"), size=rng.integers(0, 30)))
        assert docstats.features(t)[0] == brute_counts(t)


def labelled(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows if "held_out" in r)
    return rows


def accuracy(rows, label):
    rows = [r for r in rows if r.held_out]
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark):
    assert accuracy(labelled(spark, queries.op6_quality_pu, "quality"), "quality") > 0.9


def test_toxicity_held_out(spark):
    assert accuracy(labelled(spark, queries.op3_toxicity, "toxic"), "toxic") > 0.9


def test_quality_trees(spark):
    got = queries.op7_quality_trees(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        n, chars, symbols, dup, repeat = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert sum(r.kept == bool(quality[r.doc_id]) for r in held) / len(held) > 0.9


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.1 * rng.standard_normal(2000) > 0.5).astype(float)
    model = quality_trees.fit_trees(x, y, np.array([1, -1, 0]), trees=20)
    for f, sign in ((0, 1), (1, -1)):
        for row in rng.random((20, 3)):
            line = np.repeat(row[None], 50, axis=0)
            line[:, f] = np.linspace(-0.2, 1.2, 50)
            assert (sign * np.diff(model.raw(line)) >= -1e-12).all()
    def walk(row):
        total = model.bias
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        return total
    assert np.allclose(model.raw(x[:50]), [walk(r) for r in x[:50]])
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.8


def test_prior_and_risk():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, (4000, 2)), rng.normal(-2, 1, (4000, 2))
    unl = np.concatenate([good[:2100], bad[:900]])
    model = quality_pu.fit_pu(good[2100:], unl)
    assert abs(model.prior - 0.7) < 0.05
    assert (model.score(good) > 0.3).mean() > 0.97 and (model.score(bad) > 0.3).mean() < 0.05


def test_edge_cases_of_scores(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "y")] * 2,
                               "doc_id long, text string, score string, kept string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    pu = quality_pu.fit_pu(np.random.default_rng(0).random((50, len(docstats.FEATURES))), np.random.default_rng(1).random((90, len(docstats.FEATURES))))
    trees = quality_trees.fit(df, labels)
    tox = toxicity.fit_strings([toxicity.windows("idiot")] * 5, [toxicity.windows("flower")] * 5, 0.5)
    for out in (quality_pu.score_quality(df, pu), quality_pu.score_quality(df, None), toxicity.score_toxicity(df, tox),
                toxicity.score_toxicity(df, None)):
        rows = out.collect()
        assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    judged = quality_trees.judge_quality(df, trees).collect()
    assert len(judged) == len(TEXTS) + 2 and not any(r.kept and r.base_failed for r in judged)
    assert quality_pu.fit(df.limit(0), labels) is None and toxicity.fit(df.limit(0), labels) is None
    assert quality_trees.fit(df.limit(0), labels) is None
    for f, m in ((quality_pu.score_quality, pu), (toxicity.score_toxicity, tox), (quality_trees.judge_quality, trees)):
        assert f(df.limit(0), m).count() == 0
    assert spark.range(1).select(held_out(F.lit(None).cast("long"))).first()[0] is False


def test_subsequence_kernel_weights():
    """Merged triples equal a plain sum over all index triples."""
    code = toxicity.Letters(["^idiot$"])
    for word in ("idiot", "abcabc", "aaa", "xyzzyx"):
        (part,) = toxicity.windows(word)
        want = defaultdict(float)
        c = [code.code.get(x, 0) for x in part]
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    want[(c[i] * 64 + c[j]) * 64 + c[k]] += toxicity.DECAY ** (k - i + 1)
        number, weight = toxicity.triples(code([part]))
        got = {int(n): w for n, w in zip(number[0], weight[0]) if w > 0}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_spaced_and_dotted_insults():
    tox = [[*toxicity.windows("idiot"), *toxicity.windows(w)] for w in ("flower", "river", "mountain", "garden", "house")] * 4
    clean = [toxicity.windows(w) + toxicity.windows("people") for w in ("flower", "river", "mountain", "garden", "house", "radio")] * 4
    model = toxicity.fit_strings(tox, clean, 0.5)
    scorer = toxicity.Scorer(model)
    plain, dots, spaced, none = model.score(scorer.documents(["you idiot", "you i.d.i.o.t!", "you i d i o t", "you people"]))
    assert min(plain, dots, spaced) > 0.5 > none


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_decides_like_a_full_table():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a = rng.integers(0, 40, rng.integers(1, 70)).astype(np.uint64)
        b = a[rng.random(len(a)) > rng.random() * 0.25]
        b = np.insert(b, rng.integers(0, len(b) + 1, rng.integers(0, 5)), 99)
        m = lcs(a.tolist(), b.tolist())
        assert omh.alike(a, b) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-12)
    long = rng.integers(0, 10_000, 30_000).astype(np.uint64)
    other = np.delete(long, np.arange(0, 30_000, 11))
    assert omh.alike(long, other) and not omh.alike(long, np.delete(long, np.arange(0, 30_000, 4)))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 10), (20, 21)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4)) and got[12] == 10 and got[21] == 20 and all(got[i] == 100 for i in range(100, 131))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows):
    """Classes of all pairs that a full comparison finds alike."""
    seqs = [omh.hasher().hashes(t or "") for _, t in rows]
    up = list(range(len(rows)))
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if omh.alike(seqs[i], seqs[j]):
                up[find(i)] = find(j)
    return Counter(frozenset(k for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows)))


def test_near_classes(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):                              # one large group of near copies of the first text
        w = list(base)
        for k in rng.integers(0, 120, 4):
            w[k] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"w{j}" for j in rng.integers(0, 900, 80))) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(200 + i, passage + " " + " ".join(f"q{j}" for j in rng.integers(0, 900, 60))) for i in range(15)]
    rows += [(300, None), (301, ""), (302, "  "), (303, "one two"), (304, "One, two!"), (305, "one three"), (306, "one two"), (306, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = omh.near_classes(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.class_id].append(r.id)
    want = sorted(sorted(rows[k][0] for k in group) for group in brute_classes(rows))
    assert sorted(sorted(v) for v in by.values()) == want
    assert all(r.class_id == min(by[r.class_id]) and r.class_size == len(by[r.class_id]) for r in got)
    assert {r.id for r in got if r.class_kept} == set(by)
    kept = omh.drop_near_copies(df.withColumn("class_id", F.lit("x"))).collect()
    assert {r.doc_id for r in kept} == set(by) and kept[0].__fields__ == ["doc_id", "text", "class_id"]
    assert omh.near_classes(df.limit(0)).count() == 0 and omh.drop_near_copies(df.limit(0)).count() == 0


def test_near_classes_of_many_distant_copies(spark):
    """Pairs near 0.8, a few partners among a thousand: every pair that shares a bucket counts."""
    rng = np.random.default_rng(11)
    n, words = 1_100, 200
    texts = [[f"w{i}" for i in range(words)] for _ in range(n)]
    for t, w in enumerate(texts):
        for k in rng.choice(words, rng.integers(13, 16), replace=False):
            w[k] = f"x{t}y{k}"
    seqs = [omh.hasher().hashes(" ".join(w)) for w in texts]
    grid, keys = np.stack(seqs), np.stack([omh.sketches(omh.kmers(w)) for w in seqs])
    up = list(range(n))
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(n):                                  # words are only replaced, so they match in place
        match = (grid[:i] == grid[i]).sum(axis=1)
        for j in np.flatnonzero((match / (2 * words - match) >= 0.8) & (keys[:i] == keys[i]).any(axis=1)):
            up[find(i)] = find(j)
    want = Counter(find(i) for i in range(n))
    assert 50 < n - len(want) and len(want) > 100       # neither all one class nor all alone
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    by = defaultdict(set)
    for r in omh.near_classes(df).collect():
        by[r.class_id].add(r.id)
    groups = defaultdict(set)
    for i in range(n):
        groups[find(i)].add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups.values()))


def test_paired_misses_no_alike_pair():
    """Members of one bucket around 0.8 and far below: every alike pair of different components is among the pairs."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 60, 90).astype(np.uint64)
    seqs = []
    for _ in range(120):
        w = base.copy()
        at = rng.choice(90, rng.integers(0, 30), replace=False)
        w[at] = rng.integers(0, 5000, len(at))
        seqs.append(np.delete(w, rng.choice(90, rng.integers(0, 12), replace=False)))
    rarity = np.zeros(omh.RARITY_SLOTS, dtype=np.int64)
    for w in seqs:
        rarity += np.bincount(omh._slot(omh.kmers(w, 1)), minlength=omh.RARITY_SLOTS)
    label = np.arange(120) % 40
    got = [omh.word_features(w, rarity) for w in seqs]
    pairs = omh.paired(label, np.array([len(w) for w in seqs]), np.array([g[1] for g in got]), [g[0] for g in got], np.stack([g[2] for g in got]))
    assert len({(i, j) for i, j, _ in pairs.tolist()}) == len(pairs)
    near = {(i, j) for i in range(120) for j in range(i + 1, 120) if label[i] != label[j] and omh.alike(seqs[i], seqs[j])}
    assert near and near <= {(i, j) for i, j, _ in pairs.tolist()} and len(pairs) < 0.6 * 120 * 119 / 2


def test_repeated_kmers_keep_the_other_sketches():
    words = np.arange(1, 300, dtype=np.uint64)
    again = np.concatenate([words, words[:6]])          # two k-mers occur twice
    same = omh.sketches(omh.kmers(words)) == omh.sketches(omh.kmers(again))
    assert same.mean() > 0.7


def test_near_classes_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.op9_order_minhash(spark, SF_SMALL).collect()
    by = defaultdict(list)
    for r in got:
        by[r.class_id].append(r.doc_id)
    assert sorted(sorted(v) for v in by.values()) == sorted(sorted(rows[k][0] for k in g) for g in brute_classes(rows))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        kept[name] = rows
        docs = spark.createDataFrame(rows, out.schema)
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(kept["quality classifier"], key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(ids["exact dedup"]) == sorted(first.values())
    groups = brute_classes([(r.doc_id, r.text) for r in kept["exact dedup"]])
    assert sorted(ids["near-dedup"]) == sorted(min(ids["exact dedup"][k] for k in g) for g in groups)
    assert set(ids["mixing"]) <= set(ids["near-dedup"]) and max(Counter(ids["mixing"]).values()) <= 3
    final = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids["mixing"])
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    assert stage[1](spark, docs, SF_SMALL).count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, copies, ties, repeated rows, columns named like results."""
    good = " ".join(f"The {w} of the house went to the {w} river and came back with the wind." for w in ("old", "new", "red", "tall", "small"))
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good + "  ", "en", "a", 2), (None, good, None, None, None), (3, None, "en", "a", 0),
            (4, "", None, "b", 0), (5, " \t\n", "de", None, 3), (6, long, "en", "b", 9), (7, long + " tail", "en", "b", 9), (8, "short text", "fr", "c", 5),
            (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "s", "k", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                 "score string, kept string, class_id string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality classifier", "exact dedup", "near-dedup", "mixing"):
        out = stages[name](spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "exact dedup":
            assert sum(got.values()) == len({norm(r[1]) for r in rows})
            assert got[1, good] == 1 and got[2, good + "  "] == 1 and got[3, None] == 1 and got[4, ""] == 0
        if name == "near-dedup":                        # repeated rows are one document; wordless texts are one class
            assert got[1, good] == 2 and got[3, None] == 1 and got[6, long] == 1 and got[7, long + " tail"] == 0 and got[8, "short text"] == 1
            assert sum(got.values()) == 5
        if name == "mixing":
            assert all(n <= 3 * sum((r[0], r[1]) == key for r in rows) for key, n in got.items())
    coded = stages["sentencepiece"](spark, docs, SF_SMALL).collect()
    assert len(coded) == len(rows) and all(len(r.ids) in (2 * r.n_pieces, 4 * r.n_pieces) for r in coded)
    assert {r.n_pieces for r in coded if r.doc_id in (3, 4)} == {0}

