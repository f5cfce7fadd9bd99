import math

import pytest
from pyspark.sql import functions as F

from shelfmap.functions import arrays as ar
from shelfmap.functions import text as tx
from shelfmap.operators import text as txo


def test_stop_list():
    words = tx.stop_words()
    assert len(words) == 318 and len(set(words)) == 318


@pytest.mark.parametrize("raw,expected", [
    ("Visit https://www.x.com/a, or mail me@x.com: it's 2 BIG_ones “ok”", "visit  or mail  its  bigones  ok"),
    ("Größe 42, {v}[1]", "gr e  v"),
    ("\t a.b@c d \n", "d"),
    ("", ""),
])
def test_clean_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.clean_text(F.col("t")).alias("c")).first().c == expected


def test_tokens_keep_unicode_and_drop_stop_words(spark):
    df = spark.createDataFrame([(1, "Die Größe, naïve aß the a x2 _ok")], "d int, text string")
    toks = txo.tokenize(df, "text").first().tokens
    assert toks == ["die", "größe", "naïve", "aß", "x2", "_ok"]


def test_alpha_tokens(spark):
    df = spark.createDataFrame([("ab1cd _xy a longwordlongwordlong ok",)], "t string")
    assert df.select(tx.alpha_tokens(F.col("t")).alias("a")).first().a == ["ab", "cd", "ok"]


def test_bigrams_after_stop_words(spark):
    df = spark.createDataFrame([(1, "red and blue car")], "d int, text string")
    bg = txo.add_bigrams(txo.tokenize(df, "text"), "tokens", "bigrams").first().bigrams
    assert bg == ["red blue", "blue car"]


def test_prune_dictionary(spark):
    stats = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 8), ("e", 3)], "term string, df long")
    kept = txo.prune_dictionary(stats, 10, 2, 0.85, keep_n=2).collect()
    assert [r.term for r in kept] == ["d", "e"]        # c above floor(8.5)=8, a below 2


def _js(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(ar.js_distance(F.col("a"), F.col("b")).alias("d")).first().d


def test_js_fixture(spark):
    assert _js(spark, [1.0, 0.0], [0.0, 1.0]) == pytest.approx(0.832555, abs=1e-6)
    assert _js(spark, [0.5, 0.5], [1.0, 0.0]) == pytest.approx(0.464501, abs=1e-6)
    assert _js(spark, [2.0, 1.0, 1.0], [0.5, 0.25, 0.25]) == pytest.approx(0.0, abs=1e-9)
    assert _js(spark, [1.0, 0.0], [0.0, 1.0]) <= math.sqrt(math.log(2)) + 1e-12


def test_js_matrix_matches_column_form(spark):
    import numpy as np
    from shelfmap.operators.similarity import _js_matrix
    P = np.array([[1.0, 0.0], [0.5, 0.5]])
    Q = np.array([[0.0, 1.0], [1.0, 0.0]])
    D = _js_matrix(P, Q)
    assert D[0, 0] == pytest.approx(0.832555, abs=1e-6) and D[1, 1] == pytest.approx(0.464501, abs=1e-6)
    assert np.allclose(D, _js_matrix(Q, P).T)


@pytest.mark.parametrize("inp,blur,scaled", [
    ([0, 0, 0, 1, 0, 0, 0], [.000917, .029358, .234862, .469725, .234862, .029358, .000917],
     [0, .060665, .499022, 1, .499022, .060665, 0]),
    ([2, 0, 0, 0], [1.409174, .528440, .060550, .001835], [1, .374185, .041721, 0]),
])
def test_blur_then_minmax(spark, inp, blur, scaled):
    df = spark.createDataFrame([([float(x) for x in inp],)], "h array<double>")
    row = df.select(ar.gaussian_blur(F.col("h")).alias("b"),
                    ar.minmax_scale(ar.gaussian_blur(F.col("h"), normalized=False)).alias("s")).first()
    assert row.b == pytest.approx(blur, abs=1e-6)
    assert row.s == pytest.approx(scaled, abs=1e-6)


def test_minmax_constant(spark):
    df = spark.createDataFrame([([3.0, 3.0, 3.0],)], "h array<double>")
    assert df.select(ar.minmax_scale(F.col("h")).alias("s")).first().s == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, 1, None, None]])
def test_vocabulary_counts_rows_that_share_a_document(spark, ids):
    tokens = [["a", "b", "a"], ["b", "a", "c"], ["a"], ["c", "c", "a"]]
    df = spark.createDataFrame(list(zip(ids, tokens)), "sha int, tokens array<string>")
    got = txo.vocabulary(df, "sha", "tokens", min_df=1)
    want = {r.term: (r.df, r.total) for r in txo.term_stats(txo.term_counts(df, "sha", "tokens")).collect()}
    assert {r.term: (r.df, r.total) for r in got.collect()} == want
    assert {r.term for r in txo.vocabulary(df, "sha", "tokens", min_df=2).collect()} == {t for t, (n, _) in want.items() if n > 1}
    if ids[0] != ids[1]:                      # terms are summed and exchanged once, not by document first
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
