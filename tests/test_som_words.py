import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmap.operators import som, words as wo


def _codebook(spark):
    return spark.createDataFrame([(0, 0, 0, [0.0, 0.0]), (1, 0, 1, [2.0, 0.0]), (2, 1, 0, [0.0, 2.0])],
                                 "unit int, row int, col int, w array<double>")


def test_nearest_unit_ties_to_lowest(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0])], "sha int, x array<double>")
    top = som.assign_bmu(x, _codebook(spark), top_n=2).orderBy("rank").collect()
    assert [r.unit for r in top] == [0, 1]
    assert top[0].d == pytest.approx(1.0)


def test_cells_cover_every_book_once(spark):
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, rng.random(2).tolist()) for i in range(50)], "sha int, x array<double>")
    a = som.assign_bmu(x, _codebook(spark)).select("sha", "bmu_col", "bmu_row")
    members = som.cell_members(a, spark, rows=2, cols=2)
    placed = members.where(F.col("sha").isNotNull())
    assert placed.count() == 50 and placed.select("sha").distinct().count() == 50
    assert members.select("bmu_col", "bmu_row").distinct().count() == 4        # empty cell kept
    lists = som.cell_member_lists(members, max_list=5)
    assert lists.select(F.sum(F.size("matched_list"))).first()[0] == 50
    assert lists.select(F.max(F.size("matched_list"))).first()[0] <= 15      # hash buckets of ~5


def test_cell_set_add_no_duplicates(spark):
    old = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "bmu_col int, bmu_row int, sha int")
    new = spark.createDataFrame([(0, 0, 2), (0, 0, 3), (9, 9, 4)], "bmu_col int, bmu_row int, sha int")
    out = som.cell_set_add(old, new, spark, 2, 2)
    assert sorted(r.sha for r in out.collect()) == [1, 2, 3]


def test_umatrix_toroid(spark):
    cb = spark.createDataFrame([(u, u // 2, u % 2, [float(u), 0.0]) for u in range(4)],
                               "unit int, row int, col int, w array<double>")
    u = {r.unit: r.u for r in som.umatrix(cb, 2, 2).collect()}
    assert u[0] == pytest.approx((1 + 2 + 3) / 3)


def test_som_training_error_falls_and_is_deterministic(spark):
    from shelfmap.plans import standins as st
    data = st.dist(spark, "/root/testdata/sf0.001")
    W1, e1 = som.train_som(data, "p", 4, 5, epochs=5)
    W2, e2 = som.train_som(data, "p", 4, 5, epochs=5)
    assert W1.shape == (4, 5, 64)
    assert e1[-1] <= e1[0]
    assert np.allclose(W1, W2, atol=1e-9)


def test_fft_smoothing_equals_dense_kernel():
    rows, cols, dim = 4, 5, 3
    rng = np.random.default_rng(1)
    S, N = rng.random((rows, cols, dim)), rng.random((rows, cols))
    h = som.neighbourhood_kernel(rows, cols, 1.5)
    num, den = som.smooth(S, N, h)
    dense_num = np.zeros_like(S)
    for r in range(rows):
        for c in range(cols):
            for r2 in range(rows):
                for c2 in range(cols):
                    dense_num[r, c] += h[(r - r2) % rows, (c - c2) % cols] * S[r2, c2]
    assert np.allclose(num, dense_num)


def test_context_encoding_fixture(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    bigrams = spark.createDataFrame([("a b", 3), ("a c", 1)], "term string, total long")
    enc = {r.word: r for r in wo.word_minmax(wo.context_encoding(words, bigrams, 2)).collect()}
    assert enc["a"].enc == pytest.approx([0, 0.75, 0, 0]) and enc["a"].scaled == pytest.approx([0, 1, 0, 0])
    assert enc["b"].enc == pytest.approx([0, 0, 1, 0]) and enc["b"].scaled == pytest.approx([0, 0, 1, 0])


def test_word_vector_value(spark):
    df = spark.createDataFrame([("word",)], "term string")
    vec = wo.word_vectors(df, "term", 8).first().vec
    assert vec[7] == pytest.approx(0.6707447289954871, abs=1e-15)


def test_registered_word_queries_have_all_dimensions(spark):
    from conftest import SF_SMALL
    from shelfmap.plans import catalog
    vecs, encs, scaled = (f(spark, SF_SMALL).groupBy("word").agg(F.count("i").alias("n"), F.countDistinct("i").alias("d"),
                                                                 F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
                          for f in (catalog.word_vectors, catalog.kaski_encoding, catalog.word_minmax))
    assert vecs and all(r.n == r.d == 90 for r in vecs)
    assert encs and all(r.n == r.d == 180 for r in encs)
    assert all(r.n == r.d == 180 and (r.lo, r.hi) in ((0, 1), (0, 0)) for r in scaled)


def test_training_resumes_from_stored_epochs(spark):
    import tempfile
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.random((90, 3))], "x array<double>").repartition(5)
    whole, errors = som.train_som(df, "x", 3, 4, epochs=6)
    state = tempfile.mkdtemp(prefix="shelfmap-map-") + "/map"
    stopped = som.som_epoch

    def fails_after(n, calls=[0]):  # noqa: B006
        def epoch(*a, **k):
            calls[0] += 1
            if calls[0] > n:
                raise RuntimeError("lost")
            return stopped(*a, **k)
        return epoch

    som.som_epoch = fails_after(4)
    try:
        with pytest.raises(RuntimeError):
            som.train_som(df, "x", 3, 4, epochs=6, state=state, save_every=2)
    finally:
        som.som_epoch = stopped
    again, rest = som.train_som(df, "x", 3, 4, epochs=6, state=state, save_every=2)
    assert len(rest) == 3 and np.allclose(again, whole) and abs(rest[-1] - errors[-1]) < 1e-9
    assert np.allclose(som.train_som(df, "x", 3, 4, epochs=6, state=state)[0], whole)       # done: only measured


def test_epoch_sums_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X, W = rng.random((200, 4)), rng.random((6, 4))
    df = spark.createDataFrame([(v.tolist(),) for v in X], "x array<double>").repartition(9)
    monkeypatch.setattr(som, "MAX_SUM_BYTES", 0)                            # two branches
    S, N, err = som._epoch_sums(spark, df, W)
    d = np.linalg.norm(X[:, None] - W[None], axis=2)
    best = d.argmin(axis=1)
    assert N.tolist() == np.bincount(best, minlength=6).tolist() and abs(err - d.min(axis=1).mean()) < 1e-9
    assert np.allclose(S, [X[best == u].sum(axis=0) for u in range(6)])
    S, N, err = som._epoch_sums(spark, df.limit(0), W)
    assert not S.any() and not N.any() and err == 0.0


def test_nearest_unit_equals_the_exact_search():
    rng = np.random.default_rng(4)
    X, W = rng.random((400, 5)), rng.random((30, 5))
    X[::3], W[10:20], W[3], X[7] = 0, 0, W[25], W[25]                       # ties between many units, and between two
    best, d = som.nearest_unit(X, W, np.einsum("ij,ij->i", W, W))
    every = np.linalg.norm(X[:, None] - W[None], axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and np.allclose(d, every.min(axis=1))
    assert best[0] == 10 and best[7] == 3


def test_training_sends_the_driver_few_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.random((400, 4))], "x array<double>").repartition(40)
    first, seen, sums = rng.random((2, 3, 4)), [], som._epoch_sums

    def watched(spark, data, Wf, parts=None, sent=None):
        seen.append((data.rdd.getNumPartitions(), parts, sent))
        return sums(spark, data, Wf, parts, sent)

    whole, errors = som.train_som(df, "x", 2, 3, epochs=4, initial=first)
    monkeypatch.setattr(som, "_epoch_sums", watched)
    monkeypatch.setattr(som, "MAX_SENT_BYTES", 3000)                        # 2 x 3 x 4 doubles, five passes: three rows
    few, again = som.train_som(df, "x", 2, 3, epochs=4, initial=first)
    assert len(seen) == 5 and all(n == parts == spark.sparkContext.defaultParallelism and sent == 3 for n, parts, sent in seen)
    assert np.allclose(few, whole) and np.allclose(again, errors)


def test_document_histograms_take_a_row_per_occurrence(spark):
    docs = spark.createDataFrame([(1,), (2,), (None,)], "doc int")
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "x", 5), (None, "a", 1)], "doc int, term string, n long")
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "x", 5), (None, "a", 1)], "doc int, term string, n long")
    cells = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "term string, bmu_col int, bmu_row int")
    dense = {r.doc: r.h for r in wo.dense_histogram(docs, wo.hit_counts(rows, cells, 2), 2).collect()}
    assert dense == {1: [2.0, 1.0], 2: [0.0, 0.0], None: [0.0, 0.0]}
    one, other = ({r.doc: r.h for r in wo.document_histograms(docs, c, cells, 1, 2).collect()} for c in (counts, rows))
    assert one == other and one[2] == [0.0, 0.0]


def test_training_passes_make_no_query_plan(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.random((300, 4))] + [(None,)], "x array<double>").repartition(5)
    first, planned, make = rng.random((2, 3, 4)), [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda *a, **k: planned.append(1) or make(*a, **k))
    whole, errors = som.train_som(df, "x", 2, 3, epochs=4, initial=first)
    assert len(planned) == 1                                                # the vectors are put into blocks once
    monkeypatch.setattr(som, "MAX_CLOSURE_BYTES", 0)                        # the codebook is broadcast
    again, same = som.train_som(df, "x", 2, 3, epochs=4, initial=first)
    assert np.array_equal(again, whole) and same == errors and len(errors) == 5
