import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmap.operators import topic_tables as tt, topics


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.0, 50.0])
    assert np.allclose(tt.digamma(x)[1:4], [-1.9635100260214235, -0.5772156649015329, 0.42278433509846713], atol=1e-11)
    assert np.allclose(tt.digamma(x + 1) - tt.digamma(x), 1 / x, atol=1e-9)
    assert np.allclose(tt.trigamma(np.array([1.0, 0.5])), [np.pi ** 2 / 6, np.pi ** 2 / 2], atol=1e-9)


def test_model_in_tables_finds_the_topics(spark, monkeypatch):
    groups = ["river lake boat fish", "sword king castle horse"]
    texts = [(i, " ".join([groups[i % 2]] * (2 + i % 3))) for i in range(40)] + [(40, ""), (40, "unknown words"), (None, groups[0])]
    docs = spark.createDataFrame(texts, "sha int, text string").repartition(3)
    monkeypatch.setattr(topics, "MAX_DRIVER_BYTES", 0)
    monkeypatch.setattr(tt, "BLOCK_DOCS", 5)                                    # several blocks, words in each
    model = topics.fit_topics(docs, k=2, max_iter=10)
    assert isinstance(model, tt.TopicTables) and model.terms.count() == model.weights.count() == 8
    rows = topics.topic_distribution(model, docs).collect()
    p = {r.sha: r.p for r in rows if r.sha != 40}
    assert len(rows) == 43 and [r.p for r in rows if r.sha == 40] == [[0.0, 0.0]] * 2
    best = [int(np.argmax(p[i])) for i in range(40)]
    assert len(set(best[::2])) == len(set(best[1::2])) == 1 and best[0] != best[1] and np.argmax(p[None]) == best[0]
    assert all(sum(v) == pytest.approx(1) and max(v) > 0.8 for v in p.values())

    monkeypatch.setattr(topics, "MAX_DRIVER_BYTES", 1 << 20)                    # Spark ML's optimizer on the same texts
    other = {r.sha: max(r.p) for r in topics.topic_distribution(topics.fit_topics(docs, k=2, max_iter=10), docs).collect()}
    assert all(abs(other[i] - max(p[i])) < 0.1 for i in range(40))

    root = tempfile.mkdtemp(prefix="shelfmap-topics-")
    model.save(root)
    again = {r.sha: r.p for r in topics.topic_distribution(topics.TopicModel.load(root), docs.where(F.col("sha") != 40)).collect()}
    assert all(np.allclose(again[i], p[i], atol=1e-2) for i in range(40))


def test_documents_inferred_together_equal_single_ones(monkeypatch):
    rng = np.random.default_rng(7)
    E = rng.gamma(0.3, 1.0, (60, 12)) + 1e-9
    E = (E / E.max(axis=1, keepdims=True)).astype(np.float32)
    E[40:] = 0
    E[40:50, 3] = E[50:, 5] = 1                                                 # words of one topic alone
    docs = [rng.choice(60, m, replace=False) for m in (1, 2, 3, 30, 60, 5, 8, 13, 40, 40)] + [np.array([], dtype=int), np.array([41]), np.array([55, 42])]
    at, size = np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs])
    n, alpha, begin = rng.integers(1, 9, len(at)).astype(float), rng.uniform(0.004, 0.2, 12), np.cumsum(size) - size
    start = lambda: [np.random.default_rng((1, d)) for d in range(len(docs))]
    alone, calls = tt.infer, []
    monkeypatch.setattr(tt, "infer", lambda *a: calls.append(1) or alone(*a))
    for batch in (1, 2 << 20):                                                  # one by one, and all in step
        monkeypatch.setattr(tt, "BATCH_BYTES", batch)
        found = {d: r for d, *r in tt.infer_block(E, at, n, size, alpha, start())}
        assert sorted(found) == [d for d in range(len(docs)) if size[d]] and not calls
        for d, (gamma, theta, share) in found.items():
            own = slice(begin[d], begin[d] + size[d])
            g, t, s = alone(E[at[own]].astype(float), n[own], alpha, start()[d])
            assert np.allclose(gamma, g, atol=0.05) and gamma.sum() == pytest.approx(n[own].sum() + alpha.sum(), rel=1e-4)
            assert np.allclose(E[at[own]] @ theta * share, n[own], rtol=1e-3)   # every count is shared out
    far = np.full((2, 12), 1e-38, dtype=np.float32)                             # too low for 32-bit floats
    far[0, 0] = far[1, 1] = 1
    (d, gamma, theta, share), = tt.infer_block(far * np.float32(1e-6), np.array([0, 1], np.int32), np.ones(2), np.array([2]), np.full(12, 1e-3), start()[:1])
    assert np.isfinite(gamma).all() and gamma.sum() == pytest.approx(2.012, rel=1e-3)


def test_blocks_hold_all_documents_and_passes_leave_one_matrix(spark, monkeypatch):
    from shelfmap.session import checkpoint_root
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = lambda: {f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("topic-weights")}
    before = stored()
    texts = [(f"d{i % 7}" if i % 5 else None, "river lake river boat" if i % 3 else "lake") for i in range(30)] + [("x", ""), ("y", None)]
    docs = spark.createDataFrame(texts, "key string, text string").coalesce(2)
    monkeypatch.setattr(tt, "BLOCK_TOKENS", 7)
    toks = docs.select("key", F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    blocks = tt.packed(toks, "tokens", ["key"])
    assert blocks.count() > 10 and blocks.selectExpr("inline(arrays_zip(docs, ids))").selectExpr("ids.key").exceptAll(docs.select("key")).count() == 0
    assert blocks.selectExpr("sum(size(docs))").first()[0] == 32
    assert {r.term for r in tt.vocabulary(blocks, 11).collect()} == {"river", "boat", "lake"} and tt.vocabulary(blocks, 21).count() == 1
    model = tt.fit_tables(blocks, tt.vocabulary(blocks, 2), 2, 4, 42, docs=docs)
    assert model.weights.count() == 3 and len(stored() - before) == 1
    same = tt.distributions(model, toks, "key", "tokens", docs)
    other = tt.distributions(model, toks, "key", "tokens")
    key = lambda r: (r.key or "", sum(r.p), r.p[0])
    a, b = sorted(same.collect(), key=key), sorted(other.collect(), key=key)
    assert len(a) == 32 and [r.key for r in a] == [r.key for r in b] and sum(sum(r.p) == 0 for r in a) == 2
    assert all(np.allclose(x.p, y.p, atol=0.02) for x, y in zip(a, b))
