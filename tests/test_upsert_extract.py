import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmap.functions import scalars as sc
from shelfmap.operators import upsert as up
from shelfmap.sources import extract as ex
from shelfmap.sources import sitemap as sm


def test_upsert_fixture_and_idempotence(spark):
    stored = spark.createDataFrame([("k1", "s1", "T", 10, 0)], "book_id string, sha string, title string, pages int, o int")
    batch = spark.createDataFrame([("k1", "s9", None, 12, 1), ("k2", "s2", "U", None, 2)],
                                  "book_id string, sha string, title string, pages int, o int")
    once = up.upsert(stored, batch, "book_id", ["o"])
    rows = sorted((r.book_id, r.sha, r.title, r.pages) for r in once.collect())
    assert rows == [("k1", "s1", "T", 12), ("k2", "s2", "U", None)]
    twice = sorted((r.book_id, r.sha, r.title, r.pages) for r in up.upsert(once, batch, "book_id", ["o"]).collect())
    assert twice == rows


def test_batch_fold_is_per_field(spark):
    batch = spark.createDataFrame([("k", "a", "T", None, 1), ("k", "b", None, 5, 2)],
                                  "book_id string, sha string, title string, pages int, o int")
    r = up.merge_batch(batch, "book_id", ["o"]).first()
    assert (r.sha, r.title, r.pages) == ("a", "T", 5)


ITEMS = "book_id string, sha string, title string, o int"


def stored(spark, root, schema=ITEMS):
    return up.read_batches(spark, root, T.StructType.fromDDL(schema), "book_id")


def test_batches_replay(spark):
    root = tempfile.mkdtemp(prefix="shelfmap-vt-")
    b1 = spark.createDataFrame([("k1", "s1", "T", 1)], ITEMS)
    b2 = spark.createDataFrame([("k1", "s9", "T2", 2), ("k2", "s2", "U", 3)], ITEMS)
    for batch_id, rows in ((0, b1), (1, b2), (1, b2)):                       # the second batch comes twice
        up.write_batch(rows, root, batch_id, "book_id", ["o"])
    rows = sorted((r.book_id, r.sha, r.title) for r in stored(spark, root).collect())
    assert rows == [("k1", "s1", "T2"), ("k2", "s2", "U")]


def test_batches_take_new_columns_and_fold(spark):
    root, folded = tempfile.mkdtemp(prefix="shelfmap-vt-"), tempfile.mkdtemp(prefix="shelfmap-vt-")
    wide = f"{ITEMS}, pages int"
    up.write_batch(spark.createDataFrame([("a", "s1", "T", 1)], ITEMS), root, 0, "book_id", ["o"])
    up.write_batch(spark.createDataFrame([("a", "s2", 12, 2), ("b", "s3", 7, 2)], "book_id string, sha string, pages int, o int"),
                   root, 1, "book_id", ["o"])
    want = [("a", "s1", "T", 12), ("b", "s3", None, 7)]
    pick = lambda where: sorted((r.book_id, r.sha, r.title, r.pages) for r in stored(spark, where, wide).collect())
    assert pick(root) == want
    assert up.fold_batches(spark, root, folded, T.StructType.fromDDL(wide), "book_id") == 1 and pick(folded) == want
    up.write_batch(spark.createDataFrame([("b", "s9", "U", 3)], ITEMS), folded, 2, "book_id", ["o"])
    assert pick(folded) == [("a", "s1", "T", 12), ("b", "s3", "U", 7)] and pick(root) == want


def test_affiliate_links(spark):
    df = spark.createDataFrame([("https://www.shop.com/gp/product/B01/ref=x?y=1",), ("https://www.shop.com/s?k=1",),
                                (None,)], "u string")
    out = [r.l for r in df.select(sc.affiliate_link(F.col("u"), "t-20").alias("l")).collect()]
    assert out == ["http://www.shop.com/gp/product/B01/ref=nosim?tag=t-20", None, None]


def test_dates(spark):
    df = spark.createDataFrame([("Jan 5, 1999", "1884", 0), ("bad", "May 1884", 1000), (None, "2010-05-12", None)],
                               "a string, b string, ms long")
    rows = df.select(F.date_format(sc.parse_month_day_year(F.col("a")), "yyyy-MM-dd").alias("a"),
                     sc.free_year(F.col("b")).cast("string").alias("b"),
                     sc.millis_to_ts(F.col("ms")).isNull().alias("n")).collect()
    assert [(r.a, r.b, r.n) for r in rows] == [("1999-01-05", "1884-01-01", True), (None, "1884-01-01", False),
                                               (None, "2010-01-01", True)]


def test_catalogue_table(spark):
    html = ('<table class="bibrec"><tr><th>Author</th><td><a href="/ebooks/author/1">Doe, Jane</a></td></tr>'
            '<tr><th>Title</th><td>A Tale\n</td></tr><tr><th>Release Date</th><td>Jan 5, 1999</td></tr>'
            '<tr><th>Title</th><td>Second</td></tr></table>')
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    r = {x.page_id: x for x in ex.html_table_fields(df).collect()}
    assert (r[1].author, r[1].title) == ("Doe, Jane", "A Tale")
    assert r[1].author_url == "https://gutenberg.org/ebooks/author/1"
    assert str(r[1].release)[:10] == "1999-01-05"
    assert r[2].title is None


def test_page_json_and_shop_links(spark):
    js = ('{"props":{"pageProps":{"apolloState":{"Work:kca://work/1":{"details":{"publicationTime":0,'
          '"originalTitle":"Orig"},"stats":{"ratingsCount":0,"ratingsCountDist":[1,2,3,4,5]}},'
          '"Book:kca://book/1":{"title":"","primaryContributorEdge":{"node":{"__ref":"Contributor:kca://author/9"}},'
          '"links({})":{"primaryAffiliateLink":{"__typename":"KindleLink","url":"k"},'
          '"secondaryAffiliateLinks":[{"name":"Kobo","url":"u1"},{"name":"Kobo","url":"u2"},{"name":"Other","url":"u3"}]}},'
          '"Contributor:kca://author/9":{"name":"Ann","followers":{"totalCount":7}}}}}}')
    html = f'<script id="__NEXT_DATA__" type="application/json">{js}</script>'
    df = spark.createDataFrame([(1, "https://x/book/show/77", html), (2, "https://x/2", "<p/>")],
                               "page_id int, url string, html string")
    rows = ex.page_json_fields(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.book_id, r.title, r.author, r.author_follower_count) == ("gr_77", "Orig", "Ann", 7)
    assert (r.release, r.ratings_count, r.rating_four_count) == (None, None, 4)
    assert (r.kindle_link, r.kobo_link, r.amazon_link, r.audible_link) == ("k", "u1", None, None)


def test_metadata_string_or_list(spark):
    df = spark.createDataFrame([('{"metadata":{"identifier":"x1","creator":["A","B"],"date":"2010-05-12"}}',),
                                ('{"metadata":{"identifier":"x2","creator":"C","subject":["s","t"]}}',)], "json string")
    r = {x.book_id: x for x in ex.metadata_fields(df).collect()}
    assert r["x1"].author == "A B" and str(r["x1"].release) == "2010-01-01"
    assert r["x2"].author == "C" and r["x2"].subject == "s t"


def test_front_matter_isbn_files(spark):
    text = "Title: First\nAuthor: Someone\nTitle: Second Title: dup\nLanguage: English\n"
    df = spark.createDataFrame([(text,)], "text string")
    r = ex.front_matter(df).first()
    assert (r.fm_title, r.fm_author, r.fm_language, r.fm_produced_by) == ("Second", "Someone", "English", None)
    vol = spark.createDataFrame([('{"items":[{"volumeInfo":{}},{"volumeInfo":{"industryIdentifiers":'
                                  '[{"type":"ISBN_13","identifier":"9"},{"type":"ISBN_10","identifier":"1"}]}}]}',),
                                 ('{"items":[]}',)], "j string")
    assert [x.i for x in vol.select(ex.first_isbn10(F.col("j")).alias("i")).collect()] == ["1", None]


@pytest.mark.parametrize("n_books,sizes", [(1, {1: 5}), (2, {1: 5, 2: 1})])
def test_sitemap_chunks(spark, n_books, sizes):
    books = spark.createDataFrame([(i,) for i in range(n_books)], "sha int")
    static = [("s0", "1.00"), ("s1", "0.80"), ("s2", "0.80"), ("s3", "0.80")]
    e = sm.sitemap_entries(spark, books, "b/", static, "2024-01-01", chunk=5)
    got = {r.file_num: r.n for r in e.groupBy("file_num").agg(F.count("*").alias("n")).collect()}
    assert got == sizes
    assert sorted(r.file_num for r in sm.sitemap_index(books, static, "x/", "d", chunk=5).collect()) == sorted(sizes)
    idx = sm.index_xml(sm.sitemap_index(books, static, "x/", "d", chunk=5), per_index=1).collect()
    assert len(idx) == len(sizes) and all(r.xml.count("<sitemap>") == 1 for r in idx)
    xml = {r.file_num: r.xml for r in sm.sitemap_files(e).collect()}
    assert xml[1].count("<url>") == 5 and xml[1].index("s0") < xml[1].index("s3")


def test_dense_index(spark):
    df = spark.range(0, 1000).repartition(7).withColumn("k", (F.col("id") * 7919) % 1000)
    idx = sm.dense_index(df, [F.col("k")])
    assert sorted(r.rn for r in idx.collect()) == list(range(1, 1001))
    assert all(r.rn == r.k + 1 for r in idx.collect())


def test_stream_ingest_upserts_once(spark):
    from shelfmap.streaming import placement as sp
    src = tempfile.mkdtemp(prefix="shelfmap-stage-")
    schema = "book_id string, sha string, title string, o int"
    spark.createDataFrame([("k1", "s1", "T", 1)], schema).write.mode("append").parquet(src)
    root, ckpt = tempfile.mkdtemp(prefix="shelfmap-vt-"), tempfile.mkdtemp(prefix="shelfmap-ck-")
    ingest = lambda: sp.run_ingest(sp.staged_stream(spark, src, schema), root, "book_id", ["o"], ckpt)
    ingest()
    spark.createDataFrame([("k1", "s9", "T2", 2)], schema).write.mode("append").parquet(src)
    ingest()
    ingest()                                                                 # nothing new: no change
    assert [(r.book_id, r.sha, r.title) for r in stored(spark, root).collect()] == [("k1", "s1", "T2")]


def test_keyed_state_takes_late_and_repeated_records(spark):
    from shelfmap.streaming import placement as sp
    src, root = tempfile.mkdtemp(prefix="shelfmap-stage-"), tempfile.mkdtemp(prefix="shelfmap-rec-")
    ckpt = tempfile.mkdtemp(prefix="shelfmap-ck-")
    batches = [[("k1", "s2", "T2", 5), ("k1", "s3", None, 6), ("k2", None, "U", 1)],
               [("k1", "s1", "T1", 1), ("k1", "s2", "T2", 5), ("k3", "s7", None, 2)],          # late, repeated, new
               [("k2", "s4", None, 9), ("k1", None, "T9", 9)]]
    every = []
    for rows in batches:
        every += rows
        spark.createDataFrame(rows, ITEMS).write.mode("append").parquet(src)
        for _ in range(2):                                                   # the second run has nothing new
            sp.run_keyed_ingest(sp.staged_stream(spark, src, ITEMS), root, "book_id", ["o"], ckpt)
        got = sorted(map(tuple, sp.current_records(spark, root, "book_id").select("book_id", "sha", "title", "o").collect()))
        want = up.merge_batch(spark.createDataFrame(every, ITEMS), "book_id", ["o"])
        assert got == sorted(map(tuple, want.select("book_id", "sha", "title", "o").collect()))
    assert got[0] == ("k1", "s1", "T9", 9)


def test_cell_lookup(spark):
    from shelfmap.operators import som
    members = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (1, 0, "c"), (1, 1, None)],
                                    "bmu_col int, bmu_row int, sha string")
    books = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "sha string, title string")
    assert sorted(r.sha for r in som.cell_lookup(members, books, 0, 0).collect()) == ["a", "b"]


def test_catalogue_table_all_fields(spark):
    html = ('<table class="bibrec"><tr><th>Summary</th><td>\tA short one. <i>x</i></td></tr>'
            '<tr><th>Credits</th><td>Team</td></tr><tr><th>Editor</th><td></td></tr>'
            '<tr><th>Editor</th><td>Ed Smith</td></tr><tr><th>Original Language</th><td>French</td></tr>'
            '<tr><th>Release Date</th><td>bad date</td></tr></table>')
    r = ex.html_table_fields(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (r.summary, r.credits, r.editor, r.language) == ("A short one.", "Team", "Ed Smith", "French")
    assert r.release is None and r.author is None and r.author_url is None
