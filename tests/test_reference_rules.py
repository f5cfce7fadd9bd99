"""Hand rows from the reference's rules, the versioned store, and plan checks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from shelfmap.functions import predicates as pr, scalars as sc, text as tx
from shelfmap.operators import serve, som, text as txo, topics, upsert as up
from shelfmap.plans import catalog
from shelfmap.sources import corpus, extract as ex, sitemap, stages


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("text,want", [("see http now www end", "see http now www end"), ("a http://x.y/z b", "a  b"),
                                       ("www.site.org tail", "tail"), ("mail me@x.org now", "mail  now")])
def test_clean_text_keeps_bare_words(spark, text, want):
    assert one(spark, text, tx.clean_text) == want


def test_entities_are_decoded(spark):
    html = ("<title> Tom &amp; Jerry &#8211; caf&eacute; </title><table class='x'></table>"
            '<table class="bibrec"><tr><th>Author</th><td><a href="/a?x=1&amp;y=2">R&uuml;d &amp; Co</a></td></tr>'
            "<tr><th>Title</th><td>A &lt;b&gt; Tale</td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    r = {x.page_id: x for x in ex.html_table_fields(df, keep=("html",)).select(
        "*", ex.page_title(F.col("html")).alias("t")).collect()}
    assert (r[1].t, r[1].author, r[1].title) == ("Tom & Jerry – café", "Rüd & Co", "A <b> Tale")
    assert r[1].author_url == "https://gutenberg.org/a?x=1&y=2" and r[2].t is None and r[2].title is None


def test_page_json_web_url_editor_and_empty_lists(spark):
    work = {"details": {"webUrl": "https://x.org/work/1"}, "stats": {"ratingsCount": 3}}
    book = {"title": "T", "bookGenres": [], "bookSeries": [{"userPosition": ""}], "details": {"publisher": "House"}}
    state = {"props": {"pageProps": {"apolloState": {"Work": work, "Book": book}}}}
    html = f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>'
    df = spark.createDataFrame([(1, "https://x.org/book/1", html)], "page_id int, url string, html string")
    r = ex.page_json_fields(df).first()
    assert (r.web_url, r.editor, r.genres, r.series_position, r.is_series) == ("https://x.org/work/1", "House", None, None, True)
    assert "publisher" not in r.__fields__


def test_book_in_two_cells_keeps_the_last(spark):
    books = spark.createDataFrame([("a", 1), ("b", 2)], "sha string, n int")
    members = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (2, 2, None)], "bmu_col int, bmu_row int, sha string")
    got = sorted((r.sha, r.bmu_col, r.bmu_row) for r in som.members_to_books(books, members).collect())
    assert got == [("a", 1, 0), ("b", None, None)]


def test_titles_are_stripped_and_come_in_first_appearance_order(spark):
    rows = [("B", 1, 0), ("A\n", 5, 1), ("\tA", 7, 2), ("B ", 9, 3)]
    df = spark.createDataFrame([(t, r, p, f"s{p}") for t, r, p in rows], "title string, ratings_count int, pos int, sha string")
    got = serve.best_per_title(df, pos="pos").orderBy("first_pos").collect()
    assert [(r.title_key, r.pos, r.first_pos) for r in got] == [("B", 3, 0), ("A", 2, 1)]
    books = df.select("*", F.lit("x").alias("author"), F.lit(0).alias("bmu_col"), F.lit(0).alias("bmu_row"))
    best = {(r.src_sha, r.sha, r.rk) for r in serve.similar_books(books).collect()}
    assert {x for x in best if x[0] == "s0"} == {("s0", "s3", 1), ("s0", "s2", 2)}


def test_file_stem_is_decoded(spark):
    folder = tempfile.mkdtemp(prefix="shelfmap-corpus-") + "/gutenberg_books"
    os.makedirs(folder)
    for name in ("My Böok 1.txt", "a+b%20c.txt"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("text")
    read = corpus.read_corpus(spark, folder)
    assert sorted(r.stem for r in corpus.with_stem(read).collect()) == ["My Böok 1", "a+b%20c"]
    assert sorted(r.book_id for r in corpus.corpus_books(read).collect()) == ["gb_My Böok 1", "gb_a+b%20c"]


def test_front_matter_is_stripped(spark):
    df = spark.createDataFrame([("Title:\tFoo\t\nAuthor:  Bar \n",)], "text string")
    r = ex.front_matter(df).first()
    assert (r.fm_title, r.fm_author) == ("Foo", "Bar")


@pytest.mark.parametrize("url,want", [
    ("http://shop.com:8080/dp/B1/x", "http://shop.com:8080/dp/B1/ref=nosim?tag=t"),
    ("https://shop.com/a b/gp/product/B2?q=1", "http://shop.com/gp/product/B2/ref=nosim?tag=t"),
    ("https://shop.com/s?u=/dp/B3", None), ("https://shop.com/dp/", "http://shop.com/dp//ref=nosim?tag=t")])
def test_affiliate_link_parts(spark, url, want):
    assert one(spark, url, lambda c: sc.affiliate_link(c, "t")) == want


def test_url_filters_and_conditional_match(spark):
    now = F.lit("2024-05-10 13:45:12").cast("timestamp")
    url = "https://x.org/s?ami=10&ama=bad&ymi=1999&yma=0&is_active=false&datemi=2h&roima=1.5&title=x"
    df = spark.createDataFrame([(url,), ("https://x.org/s",)], "u string")
    a, b = df.select(*pr.url_filters(F.col("u"), now), F.col("u")).orderBy(F.length("u").desc()).collect()
    assert (a.square_meter_gt, a.square_meter_lt, a.roi_lt, a.title_contains, a.is_active) == (10, None, 1.5, "x", False)
    assert str(a.year_of_construction_gt) == "1999-01-01" and a.year_of_construction_lt is None
    assert str(a.date_gt) == "2024-05-10 11:00:00" and b.is_active is True and b.date_gt is None
    left = spark.createDataFrame([(1, 50, 2, "buy", "1990-01-01"), (2, 50, 2, "buy", None), (3, 9, 9, "x", None)],
                                 "id int, square_meter int, rooms int, action string, built string")
    right = spark.createDataFrame([(7, 50, 2, "buy", "1990-06-01"), (8, 50, 2, "buy", "1991-01-01")], left.schema)
    got = {(r.id, r.r_id) for r in pr.conditional_match(left, right, ["square_meter", "rooms", "action"], "built").collect()}
    assert got == {(1, 7), (2, 7), (2, 8)}
    ids = spark.createDataFrame([(1,), (3,), (3,)], "v int")
    assert sorted(r.id for r in pr.in_list(left, "id", ids).collect()) == [1, 3]


def test_vocabulary_is_whole_or_refused(spark):
    docs = spark.createDataFrame([(i, " ".join(f"term{j}" for j in range(i, i + 60))) for i in range(40)], "sha int, text string")
    toks = txo.tokenize(docs)
    assert len(txo.fit_vectorizer(toks, min_df=1).vocabulary) == 99
    with pytest.raises(ValueError, match="98 terms|97 terms|max_driver_bytes"):
        topics.fit_topics(docs, k=2, max_iter=1, max_driver_bytes=100)


def test_dictionary_cut_orders_only_ties(spark):
    stats = spark.createDataFrame([("a", 9), ("b", 7), ("e", 5), ("c", 5), ("d", 5), ("f", 1)], "term string, df int")
    got = sorted(r.term for r in txo.prune_dictionary(stats, 100, 2, 0.85, 4).collect())
    assert got == ["a", "b", "c", "d"]
    assert txo.prune_dictionary(stats, 100, 2, 0.85, 50).count() == 5


def test_topic_model_stage(spark):
    docs = spark.createDataFrame([(i, " ".join(["red", "blue", "green", "tale", "story"][i % 5 - 3:] + ["river" * (i % 2), "mountain"[:6 + i % 3]])) for i in range(12)], "sha int, text string")
    root = tempfile.mkdtemp(prefix="shelfmap-stage-")
    fitted = []
    def fit():
        fitted.append(1)
        return topics.fit_topics(docs, k=2, max_iter=2, alpha=True)
    a = stages.model_stage(spark, "topics", fit, topics.TopicModel, root=root)
    b = stages.model_stage(spark, "topics", fit, topics.TopicModel, root=root)
    assert len(fitted) == 1 and b.alpha and b.vectorizer.vocabulary == a.vectorizer.vocabulary
    pa, pb = ({r.sha: r.p for r in topics.topic_distribution(m, docs).collect()} for m in (a, b))
    assert all(abs(x - y) < 1e-6 for k in pa for x, y in zip(pa[k], pb[k]))


def plan(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_plans(spark):
    assert plan(spark, "cell_members").count("MapInPandas") <= 2                 # node and its detail
    assert "src_sha" not in "".join(x for x in plan(spark, "similar_books_same_cell").split("\n") if "hashpartitioning" in x)
    assert plan(spark, "page_fields").split("\n\n(1)")[0].count("Scan parquet") == 1
    for name in ("page_fields", "catalogue_fields"):                            # the table's rows are found once
        df = catalog.QUERIES[name](spark, SF_SMALL)
        assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") <= 2
    assert "Sort" not in plan(spark, "sitemap_index") and plan(spark, "sitemap_index").count("SinglePartition") >= 1


def test_sitemap_index_counts_files(spark):
    books = spark.range(0, 48).select(F.col("id").alias("sha"))
    got = sitemap.sitemap_index(books, [("u", "1.0")] * 3, "https://x.org/", "2024-01-01", chunk=25).collect()
    assert sorted(r.file_num for r in got) == [1, 2, 3]
    assert sitemap.sitemap_index(books.limit(0), [], "https://x.org/", "2024-01-01").count() == 0


def test_members_only_of_existing_cells(spark):
    from shelfmap.streaming import placement as sp
    src = tempfile.mkdtemp(prefix="shelfmap-src-") + "/staging"
    schema = "sha int, bmu_col int, bmu_row int"
    spark.createDataFrame([(1, 0, 0), (2, 5, 5)], schema).write.parquet(src)
    books = tempfile.mkdtemp(prefix="shelfmap-books-")
    log, ckpt = tempfile.mkdtemp(prefix="shelfmap-log-"), tempfile.mkdtemp(prefix="shelfmap-ck-")
    cells = spark.createDataFrame([(0, 0)], "bmu_col int, bmu_row int")
    sp.run_placement_updates(sp.staged_stream(spark, src, schema), lambda b: b, books, log, ckpt, cells=cells)
    assert [(r.bmu_col, r.sha) for r in sp.cell_sets(spark, log).collect()] == [(0, 1)]
    assert sorted(r.sha for r in up.read_batches(spark, books, T.StructType.fromDDL("sha int, bmu_col int"), "sha", ()).collect()) == [1, 2]


def test_quantization_error_belongs_to_the_returned_map(spark):
    df = spark.createDataFrame([([float(i % 7), float(i % 3)],) for i in range(80)], "x array<double>")
    W, errors = som.train_som(df, "x", 2, 3, epochs=3)
    again = som._epoch_sums(spark, df, W.reshape(6, 2))[2]
    assert len(errors) == 4 and abs(errors[-1] - again) < 1e-12
