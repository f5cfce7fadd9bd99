from pyspark.sql import functions as F

from shelfmap.functions import predicates as pr
from shelfmap.operators import serve


def test_accent_tables_align():
    assert len(pr.ACCENTED) == len(pr.UNACCENTED)


def test_null_rules(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    got = lambda f: sorted([r.x for r in df.where(pr.build_predicate(f)).collect()], key=lambda v: (v is None, v))
    assert got({"x": 1}) == [1]
    assert got({"x__ne": 1}) == [3, None]
    assert got({"x__exists": False}) == [None]
    assert got({"x__exists": "true"}) == [1, 3]
    assert got({"x__gte": 1, "x__lt": 3}) == [1]
    assert got({"x": None}) == [1, 3, None]          # None entries are ignored
    desc = [r.x for r in df.orderBy(*serve.order_columns("-x", tie=None)).collect()]
    assert desc == [3, 1, None]


def test_phrase_search(spark):
    rows = ["Red Widget", "big red widget", "red big widget", "redwidget", "Réd  WIDGET!", None]
    df = spark.createDataFrame([(r,) for r in rows], "title string")
    hits = [r.title for r in df.where(pr.phrase_match(F.col("title"), "red widget")).collect()]
    assert hits == ["Red Widget", "big red widget", "Réd  WIDGET!"]


def test_length_in_code_points(spark):
    df = spark.createDataFrame([("a😀ß",), ("ab",), (None,)], "s string")
    assert df.where(pr.build_predicate({"s__length_gte": 3})).count() == 1


def test_has_all(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],)], "g array<string>")
    assert df.where(pr.array_has_all(F.col("g"), ["a", "b"])).count() == 1


def test_relative_cutoff():
    from datetime import datetime
    now = datetime(2024, 5, 10, 13, 45, 12)
    assert pr.relative_cutoff("2h", now) == datetime(2024, 5, 10, 11, 0)
    assert pr.relative_cutoff("1m", now) == datetime(2024, 4, 10, 13, 0)
    assert pr.relative_cutoff("30M", now) == datetime(2024, 5, 10, 13, 0)
    assert pr.relative_cutoff("bad", now) is None


def test_best_per_title(spark):
    rows = [("A", None, 0), ("A ", 5, 1), ("B", 2, 2), ("B", 2, 3), ("C", 1, 4), (None, 9, 5), ("C ", 4, 6)]
    df = spark.createDataFrame([(t, r, p, f"s{p}") for t, r, p in rows],
                               "title string, ratings_count int, pos int, sha string")
    out = serve.best_per_title(df, ignore_title="C", pos="pos").orderBy("pos").collect()
    assert [(r.title, r.ratings_count, r.pos) for r in out] == [("A ", 5, 1), ("B", 2, 2), ("C ", 4, 6)]


def test_paging_and_cap(spark):
    df = spark.createDataFrame([(i, f"t{i}", i % 5) for i in range(120)], "sha int, title string, ratings_count int")
    page2 = serve.all_books(df, order_by="-ratings_count", page=2, per_page=500).collect()
    assert len(page2) == 50
    first = serve.all_books(df, order_by="-ratings_count", page=1, per_page=10).collect()
    assert [r.ratings_count for r in first] == [4] * 10 and first[0].sha == 4


def test_similar_books(spark):
    books = spark.createDataFrame(
        [(1, "A", 10, 0, 0), (2, "B", 5, 0, 0), (3, "B ", 7, 0, 0), (4, "A", 1, 0, 0), (5, "X", 3, 1, 1),
         (6, "Z", 2, None, None)],
        "sha int, title string, ratings_count int, bmu_col int, bmu_row int").withColumn("author", F.lit("a"))
    out = {(r.src_sha, r.sha) for r in serve.similar_books(books).collect()}
    assert (1, 3) in out and (1, 1) not in out and (1, 4) not in out   # own title ignored
    assert (2, 1) in out and (2, 3) in out                                # 'B ' differs from 'B' before trim
    assert not any(s == 6 for s, _ in out)                                # unplaced source
    assert {(5, o) for s, o in out if s == 5} == set()                    # only itself in its cell


def test_search_args(spark):
    df = spark.createDataFrame([("Red Widget", "a tale"), ("blue", "red widget story")], "title string, summary string")
    assert df.where(pr.build_predicate(pr.search_args(title="red widget"))).count() == 1
    assert df.where(pr.build_predicate(pr.search_args(summary="widget story"))).first().title == "blue"
