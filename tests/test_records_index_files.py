"""Typed records, positional index, cell-clustered books and named files."""

import json
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfmap.functions.predicates import phrase_match
from shelfmap.operators import phrases, serve
from shelfmap.plans import catalog
from shelfmap.schema import STAGING_SCHEMA
from shelfmap.sources import clustered, files, records


def folder(name):
    return tempfile.mkdtemp(prefix=f"shelfmap-{name}-") + "/out"


def test_records_of_three_sites_share_one_schema(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    state = {"props": {"pageProps": {"apolloState": {"Work": {"stats": {"ratingsCount": 0}}, "Book": {"title": "", "bookGenres": []}}}}}
    page = f'<script id="__NEXT_DATA__">{json.dumps(state)}</script>'
    pages = spark.createDataFrame([(1, "https://x.org/book/show/7", page), (2, "https://x.org/book/show/8", "<p>404</p>"), (3, None, None)],
                                  "page_id int, url string, html string")
    one = records.json_page_records(pages, "p", "s", at)
    two = records.table_page_records(pages.where("page_id = 2"), "p", "s", at)
    answers = [(json.dumps({"metadata": {"identifier": "a1", "creator": "One", "date": "1884", "isbn": "0000000001"}}),),
               (json.dumps({"metadata": {"identifier": "a2", "creator": ["One", "Two"], "title": ""}}),), ("not json",), (None,)]
    three = records.metadata_records(spark.createDataFrame(answers, "json string"), "p", "s", at)
    rows = {r.book_id: r for r in records.all_records(one, two, three).collect()}
    assert sorted(rows) == ["a1", "a2", "gb_8", "gr_7"] and one.schema == three.schema == STAGING_SCHEMA
    assert rows["gr_7"].title is None and rows["gr_7"].ratings_count is None and rows["gr_7"].genres is None
    assert rows["gr_7"].url == "https://www.goodreads.com/book/show/7" and rows["gb_8"].url == "https://www.gutenberg.org/ebooks/8"
    assert (rows["a1"].author, rows["a2"].author, rows["a2"].title, rows["a1"].isbn_10) == ("One", "One Two", None, "0000000001")
    stored = records.store_books(records.store_books(spark.createDataFrame([], STAGING_SCHEMA), three), three.withColumns(
        {"sha": F.lit("other"), "title": F.lit("T"), "author": F.lit(None).cast("string"), "date": F.lit("2024-02-01").cast("timestamp")}))
    got = {r.book_id: r for r in stored.collect()}
    assert got["a1"].sha == rows["a1"].sha and got["a1"].title == "T" and got["a1"].author == "One" and str(got["a1"].date)[:10] == "2024-02-01"


def test_typed_refuses_a_wrong_type(spark):
    with pytest.raises(Exception, match="num_pages|CAST|INVALID"):
        records.typed(spark.createDataFrame([("k", ["x"])], "book_id string, num_pages array<string>")).collect()


TITLES = [(1, "The Red, red widget"), (2, "Red widget red"), (3, "A rêd-WIDGET"), (4, "widget red"), (5, None), (6, ""), (7, "redwidget red 2 widgets"),
          (8, "to be or not to be"), (9, "to be or not to go")]


@pytest.mark.parametrize("phrase", ["red widget", "Red", "red red", "to be or not to be", "not to", "widget, red", "2", "absent", "red absent"])
def test_index_finds_what_the_scan_finds(spark, phrase):
    root = folder("index")
    books = spark.createDataFrame(TITLES, "sha int, title string")
    phrases.index_batch(books, root, 0)
    got = sorted(r.sha for r in phrases.indexed_search(books, root, phrase).collect())
    assert got == sorted(r.sha for r in books.where(phrase_match(F.col("title"), phrase)).collect())


def test_index_replaces_documents_that_come_again(spark):
    root, schema = folder("index"), "sha int, title string"
    phrases.index_batch(spark.createDataFrame([(1, "red widget"), (2, "red widget")], schema), root, 0)
    for _ in range(2):                                                       # a batch that comes twice counts once
        phrases.index_batch(spark.createDataFrame([(2, "blue bolt"), (3, "red widget")], schema), root, 1)
    assert sorted(r.id for r in phrases.find_phrase(spark, root, "red widget").collect()) == [1, 3]
    assert [r.id for r in phrases.find_phrase(spark, root, "Blue  BOLT!").collect()] == [2]
    assert phrases.find_phrase(spark, root, " , ").count() == 0


def test_index_search_reads_only_its_terms(spark):
    root = folder("index")
    phrases.index_batch(spark.createDataFrame(TITLES, "sha int, title string"), root, 0)
    plan = phrases.find_phrase(spark, root, "red widget")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_keeps_a_row_per_term_and_block(spark):
    texts = [("a", "Red  wídget, RED"), ("b", None), ("c", " ,"), ("d", "widget"), (None, "red ŁÓ 2"), ("a", "red"), ("e", "")]
    df = spark.createDataFrame(texts, "k string, body string").coalesce(1)
    rows = [(r.term, r.ids, r.positions) for r in phrases.postings(df, "k", "body").collect()]
    assert sorted(rows) == [("2", [None], [2]), ("lo", [None], [1]), ("red", ["a", "a", None, "a"], [0, 2, 0, 0]),
                            ("widget", ["a"], [1]), ("widget", ["d"], [0])]        # wídget and widget are folded after they are gathered
    assert phrases.postings(df.where("body IS NULL OR k = 'c'"), "k", "body").count() == 0


def test_blocks_rows_and_batches_of_an_index_are_bounded(monkeypatch):
    texts = ["a b a", "", "b " * 9 + "c", "a", "c b a"]
    batch = pa.RecordBatch.from_pydict({"id": range(5), "text": texts})
    want = sorted((w, i, p) for i, t in enumerate(texts) for p, w in enumerate(t.split()))
    for size, most, out in ((1, 2, 3), (12, 1, 1), (1 << 20, 3, 4), (1 << 20, 1 << 16, 1 << 20)):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        monkeypatch.setattr(phrases, "ROW_POSTINGS", most)
        monkeypatch.setattr(phrases, "BATCH_POSTINGS", out)
        got = [b.to_pylist() for b in phrases._gather(iter([batch, batch.slice(0, 0)]))]
        rows = [r for b in got for r in b]
        assert sorted((r["term"], i, p) for r in rows for i, p in zip(r["ids"], r["positions"], strict=True)) == want
        assert max(len(r["ids"]) for r in rows) <= most and max(sum(len(r["ids"]) for r in b) for b in got) < out + most
        assert len(rows) == 3 or most < 1 << 16
    assert sum(b.num_rows for b in phrases._gather(iter([batch.slice(1, 1)]))) == 0


def test_summary_search_exchanges_no_text(spark):
    plan = catalog.QUERIES["summary_search"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" in plan.split("Join LeftSemi")[1] and "length(" not in plan.split("Join LeftSemi")[0]


def test_clustered_books_are_not_exchanged(spark):
    books = catalog.st.bookparts(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = clustered.write_by_cell(books, folder("cells"), buckets=4)
        for df in (serve.similar_books(table), serve.similar_books(table, books.limit(5))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            if "Limit" not in plan:
                assert "Exchange" not in plan and "SortMergeJoin" in plan
        got, want = serve.similar_books(table), serve.similar_books(books)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0
        assert table.count() == books.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_named_files_count_by_their_manifest(spark):
    root = folder("files")
    rows = [("a b/ü+1%.txt", "line\r\nline\n"), ("plain.xml", ""), ("none.txt", None), (None, "x")]
    manifest = files.write_files(spark.createDataFrame(rows, "name string, text string"), root)
    assert sorted((r.name, r.bytes) for r in manifest.collect()) == [("a b/ü+1%.txt", 11), ("none.txt", 0), ("plain.xml", 0)]
    with open(f"{root}/stray.txt", "w") as f:
        f.write("not named")
    got = {r.name: r.text for r in files.read_files(spark, root).where("name LIKE '%.txt'").collect()}
    assert got["a b/ü+1%.txt"] == "line\r\nline\n" and "stray.txt" not in got
    again = files.write_files(spark.createDataFrame([("plain.xml", "new")], "name string, text string"), root)
    assert again.count() == 1 and [r.text for r in files.read_files(spark, root).collect()] == ["new"]


def test_corpus_scan_lists_in_tasks_what_sparks_reader_finds(spark, monkeypatch):
    import os
    import tempfile
    from shelfmap.sources import corpus
    root = tempfile.mkdtemp(prefix="shelfmap scan+%41-") + "/Bök [x"[:4]
    names = ["a b+%41#.txt", "Bök {q}|^`\"<>~!'()=@&$,;.txt", "n\u00a0bsp\u3000é.txt", "_hidden.txt", ".hidden.txt", "_k=1.txt", "skip.md",
             "_gone/x.txt", ".gone/x.txt", "_k=2/x.txt", "deep/er/Ö est/z.txt", "deep/empty.txt", "deep/part.txt._COPYING_", "deep.txt/in.txt"]
    for i, name in enumerate(names):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "wb").write(b"" if "empty" in name else b"text \xff\xfe %d\r\n" % i)
    os.makedirs(f"{root}/no/files")
    plain = lambda at, glob: (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(at, wholetext=True)
                              .selectExpr("_metadata.file_path AS path", "value AS text"))
    own, read = [], type(spark.read).text
    for at in (root, f"file://{root}", root + "/"):
        for glob in ("*.txt", "*", "[a-d]*.{txt,md}"):
            there = sorted((r.path, r.h) for r in plain(at, glob).selectExpr("path", "hex(text) h").collect())
            with monkeypatch.context() as m:
                m.setattr(type(spark.read), "text", lambda *a, **k: own.append(1) or read(*a, **k))
                m.setattr(corpus, "LISTED_ROWS", 2)
                m.setattr(corpus, "SENT_BYTES", 9)
                found = corpus.read_corpus(spark, at, glob)
                assert found.columns == ["path", "text"] and sorted((r.path, r.h) for r in found.selectExpr("path", "hex(text) h").collect()) == there
            assert there and not own                                           # the driver gets no list of files
    assert corpus.read_corpus(spark, f"{root}/no").count() == 0
    assert corpus.read_corpus(spark, f"{root}/deep.txt/*.txt").count() == corpus.read_corpus(spark, f"{root}/deep/er").count() == 1
