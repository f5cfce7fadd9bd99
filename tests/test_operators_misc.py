"""Hand-row tests for operators without a registered query of their own."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmap.functions import predicates as pr
from shelfmap.operators import serve, som, upsert as up, words as wo
from shelfmap.sources import extract as ex, sitemap as sm, tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_url_params_and_labels(spark):
    df = spark.createDataFrame([("https://x.org/fr/1?page=3&flag=true&year=12345",), ("https://x.org/en/2?page=x",)],
                               "url string")
    rows = df.select(pr.query_param(F.col("url"), "page", "int").alias("p"),
                     pr.query_param(F.col("url"), "flag", "boolean").alias("f"),
                     pr.query_param(F.col("url"), "year", "year").alias("y"),
                     pr.path_label(F.col("url"), [("/fr/", "french"), ("/en/", "english")]).alias("l")).collect()
    assert [(r.p, r.f, r.y, r.l) for r in rows] == [(3, True, None, "french"), (None, None, None, "english")]


def test_conditional_key_match(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "a", "2020-01"), (3, "a", "2021")], "id int, k string, y string")
    right = spark.createDataFrame([("a", "2020-05")], "k string, ry string")
    got = left.join(right, "k").where(pr.conditional_key_match(F.col("y"), F.col("ry")))
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_relative_cutoff_column(spark):
    df = spark.createDataFrame([("2h",), ("bad",)], "spec string")
    now = F.lit("2024-05-10 13:45:12").cast("timestamp")
    out = [r.c for r in df.select(pr.relative_cutoff_col(F.col("spec"), now).alias("c")).collect()]
    assert str(out[0]) == "2024-05-10 11:00:00" and out[1] is None


def test_lookup_detail_shuffle(spark):
    books = spark.createDataFrame([("b1", "s1", "T", "A", "x"), ("b2", "s2", "U", "B", None)],
                                  "book_id string, sha string, title string, author string, summary string")
    ids = spark.createDataFrame([("s1",), ("s2",), ("s1",)], "sha string")
    assert [r.book_id for r in tables.debug_lookup(books, ids).collect()] == ["b1"]
    assert serve.book_detail(books, ids).count() == 2
    order1 = [r.sha for r in serve.shuffled(books, "sha", 7).collect()]
    order2 = [r.sha for r in serve.shuffled(books, "sha", 7).collect()]
    assert order1 == order2 and sorted(order1) == ["s1", "s2"]
    assert serve.drop_fields(books, ["summary"]).columns == ["book_id", "sha", "title", "author"]


def test_housekeeping_take_first_search_cover(spark):
    df = spark.createDataFrame([("b1", "", None, "c")], "book_id string, a string, b string, c string")
    r = ex.housekeeping(df, "proj", "spider1", "host").select(
        "sha", "project", ex.take_first(F.col("a"), F.col("b"), F.col("c")).alias("t")).first()
    assert len(r.sha) == 32 and r.project == "proj" and r.t == "c"
    resp = spark.createDataFrame([('{"items":[{"identifier":"i1"},{"identifier":"i2"}],"cursor":"z"}',)], "json string")
    assert [r.url for r in ex.search_expansion(resp).collect()] == [
        "https://archive.org/metadata/i1", "https://archive.org/metadata/i2"]
    books = spark.createDataFrame([("s1", "goodreads", "u"), ("s2", "goodreads", None), ("s3", "x", "v")],
                                  "sha string, spider string, image_url string")
    assert [r.sha for r in sm.cover_list(books).collect()] == ["s1"]


def test_apply_and_invert_scale(spark):
    df = spark.createDataFrame([("w", [2.0, 4.0])], "word string, v array<double>")
    scales = spark.createDataFrame([("w", 2.0, 6.0)], "word string, lo double, hi double")
    fwd = wo.apply_scale(df, scales, "word", "v")
    assert fwd.first().v == [0.0, 0.5]
    assert wo.apply_scale(fwd, scales, "word", "v", inverse=True).first().v == [2.0, 4.0]


def test_activation_map(spark):
    cb = spark.createDataFrame([(0, 0, 0, [0.0, 0.0]), (1, 0, 1, [3.0, 4.0])], "unit int, row int, col int, w array<double>")
    x = spark.createDataFrame([(1, [0.0, 0.0])], "sha int, x array<double>")
    assert som.activation_map(x, cb).first().dist == pytest.approx([0.0, 5.0])


def test_hot_key_reductions_are_partial(spark):
    rows = [("hot", i % 3, i) for i in range(300)] + [(f"t{i}", 1, 1000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "title string, ratings_count int, sha int")
    assert "partial_min_by" in _plan(serve.best_per_title(df))
    batch = df.withColumnRenamed("title", "book_id")
    assert "partial_max_by" in _plan(up.merge_batch(batch, "book_id", ["sha"], frozen=()))


def test_placement_replay_changes_nothing(spark):
    from shelfmap.streaming import placement as sp
    src = tempfile.mkdtemp(prefix="shelfmap-src-") + "/staging"
    spark.createDataFrame([(1, [0.0, 0.1]), (2, [1.9, 0.0])], "sha int, x array<double>").write.parquet(src)
    cb = spark.createDataFrame([(0, 0, 0, [0.0, 0.0]), (1, 0, 1, [2.0, 0.0])], "unit int, row int, col int, w array<double>")
    sink, ckpt = tempfile.mkdtemp(prefix="shelfmap-sink-"), tempfile.mkdtemp(prefix="shelfmap-ck-")
    place = lambda b: som.assign_bmu(b, cb).drop("rank")
    stream = lambda: sp.staged_stream(spark, src, "sha int, x array<double>")
    sp.run_placement(stream(), place, sink, ckpt)
    first = sorted((r.sha, r.unit) for r in sp.placed(spark, sink).collect())
    sp.run_placement(stream(), place, sink, ckpt)          # replay: no new files, no new batch
    assert sorted((r.sha, r.unit) for r in sp.placed(spark, sink).collect()) == first == [(1, 0), (2, 1)]


def test_placement_with_keyed_updates(spark):
    from shelfmap.streaming import placement as sp
    src = tempfile.mkdtemp(prefix="shelfmap-src-") + "/staging"
    schema = "sha int, x array<double>"
    spark.createDataFrame([(1, [0.0, 0.1]), (2, [1.9, 0.0])], schema).write.parquet(src)
    cb = spark.createDataFrame([(0, 0, 0, [0.0, 0.0]), (1, 0, 1, [2.0, 0.0])], "unit int, row int, col int, w array<double>")
    books = tempfile.mkdtemp(prefix="shelfmap-books-")
    log, ckpt = tempfile.mkdtemp(prefix="shelfmap-log-"), tempfile.mkdtemp(prefix="shelfmap-ck-")
    place = lambda b: som.assign_bmu(b, cb)
    sp.run_placement_updates(sp.staged_stream(spark, src, schema), place, books, log, ckpt)
    spark.createDataFrame([(3, [2.1, 0.0])], schema).write.mode("append").parquet(src)
    sp.run_placement_updates(sp.staged_stream(spark, src, schema), place, books, log, ckpt)
    cells = sorted((r.bmu_col, r.sha) for r in sp.cell_sets(spark, log).collect())
    assert cells == [(0, 1), (1, 2), (1, 3)]
    table = T.StructType.fromDDL("sha int, bmu_col int, bmu_row int")
    placed = sorted((r.sha, r.bmu_col) for r in up.read_batches(spark, books, table, "sha", ()).collect())
    assert placed == [(1, 0), (2, 1), (3, 1)]


def test_dealt_only_by_setting(spark):
    df = spark.range(0, 1000).coalesce(1)
    assert tables.dealt(df).rdd.getNumPartitions() == 1
    spark.conf.set("spark.shelfmap.textPartitions", "3")
    assert tables.dealt(df).rdd.getNumPartitions() == 3
    spark.conf.unset("spark.shelfmap.textPartitions")


def test_topk_and_pushdown_plans(spark):
    from shelfmap.plans import catalog
    from conftest import SF_SMALL

    def formatted(df):
        return df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    sim = formatted(catalog.QUERIES["similar_books_same_cell"](spark, SF_SMALL))
    assert sim.count("WindowGroupLimit") >= 2                      # partial + final around the shuffle
    knn = formatted(catalog.QUERIES["js_knn"](spark, SF_SMALL))
    assert knn.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in knn
    flt = formatted(catalog.QUERIES["filter_summary_length"](spark, SF_SMALL))
    assert "EqualTo(lang,en)" in flt and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in flt


def test_knn_in_blocks_is_whole_and_starts_no_job_per_block(spark):
    import numpy as np
    from shelfmap.operators import similarity as sim
    rng = np.random.default_rng(8)
    vecs = rng.random((300, 6))
    vecs[7] = vecs[3]
    books = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(900, None)], "sha long, p array<double>")
    queries = books.where("sha < 60 or sha = 900").toDF("qid", "q")
    d = sim._js_matrix(vecs / vecs.sum(1, keepdims=True), vecs[:60] / vecs[:60].sum(1, keepdims=True))
    for drop, sizes in ((False, {}), (True, {"max_queries": 7, "max_books": 40})):
        got = sim.js_knn(books, queries, k=4, drop_zero=drop, **sizes).collect()
        assert len(got) == 60 * 4
        for q in range(60):
            order = [i for i in np.lexsort((np.arange(300), d[:, q])) if not drop or d[i, q] > sim.ZERO][:4]
            assert [r.sha for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == order
    spark.sparkContext.setJobGroup("knn", "knn")
    sim.js_knn(books, queries, max_queries=2)                        # 30 blocks of queries
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("knn"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 6                                                 # the queries stored and counted, the books counted
    assert sim.js_knn(books, queries.limit(0)).count() == 0 and sim.js_knn(books.limit(0), queries).count() == 0
