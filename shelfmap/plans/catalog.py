"""The query catalogue: every registered query and its DuckDB oracle SQL.

Each query takes ``(spark, root)`` with ``root`` the folder of the supplied
parquet tables and returns a DataFrame over the whole tables.  Oracle SQL
reads the same tables as DuckDB views; column names and types match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmap.operators import serve
from shelfmap.functions.predicates import build_predicate
from shelfmap.plans import standins as st
from shelfmap.session import reliable_checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


BOOK_COLS = ["sha", "title", "author", "ratings_count", "bmu_col", "bmu_row"]

# --- group B: predicates -------------------------------------------------------

EQ_IN_EXISTS = {"title__in": ["red widget", "blue bolt", "small ring"],
                "ratings_count__exists": True, "bmu_col__exists": True, "bmu_row": 3}


@register("filter_eq_in_exists", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, author, ratings_count, bmu_col, bmu_row FROM bookparts
WHERE title IN ('red widget', 'blue bolt', 'small ring') AND ratings_count IS NOT NULL
  AND bmu_col IS NOT NULL AND bmu_row = 3""")
def filter_eq_in_exists(spark, root):
    return st.bookparts(spark, root).where(build_predicate(EQ_IN_EXISTS)).select(*BOOK_COLS)


RANGES_NE = {"ratings_count__gte": 25, "ratings_count__lt": 35, "author__ne": "Brand#1",
             "title__exists": True}


@register("filter_ranges_ne", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, author, ratings_count, bmu_col, bmu_row FROM bookparts
WHERE ratings_count >= 25 AND ratings_count < 35 AND author IS DISTINCT FROM 'Brand#1'
  AND title IS NOT NULL""")
def filter_ranges_ne(spark, root):
    return st.bookparts(spark, root).where(build_predicate(RANGES_NE)).select(*BOOK_COLS)


@register("filter_summary_length", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, title, CAST(length(summary) AS INTEGER) AS n_chars FROM bookdocs
WHERE summary IS NOT NULL AND length(summary) >= 400 AND language = 'en'""")
def filter_summary_length(spark, root):
    flt = {"summary__length_gte": 400, "language": "en"}
    return (st.bookdocs(spark, root).where(build_predicate(flt))
            .select("sha", "title", F.length("summary").alias("n_chars")))


PHRASE_NORM_SQL = """regexp_replace(translate(lower({c}), '{a}', '{u}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"""


def _norm_sql(c: str) -> str:
    from shelfmap.functions.predicates import ACCENTED, UNACCENTED
    return PHRASE_NORM_SQL.format(c=c, a=ACCENTED, u=UNACCENTED)


@register("filter_phrase", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title FROM bookparts
WHERE title IS NOT NULL AND contains(' ' || {_norm_sql('title')} || ' ', ' red widget ')""")
def filter_phrase(spark, root):
    return (st.bookparts(spark, root).where(build_predicate({"title__contains": "Red  Widget"}))
            .select("sha", "title"))


# --- group C: search, paging, sampling, dedupe ----------------------------------

@register("title_search_top50", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, author, ratings_count FROM bookparts
WHERE title IS NOT NULL AND contains(' ' || {_norm_sql('title')} || ' ', ' widget ')
ORDER BY ratings_count DESC NULLS LAST, sha LIMIT 50""")
def title_search_top50(spark, root):
    return serve.title_search(st.bookparts(spark, root), "widget")


@register("paged_books", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, author, ratings_count FROM bookparts
ORDER BY ratings_count DESC NULLS LAST, sha LIMIT 50 OFFSET 100""")
def paged_books(spark, root):
    return serve.all_books(st.bookparts(spark, root), order_by="-ratings_count", page=3,
                           per_page=50, columns=["sha", "title", "author", "ratings_count"])


@register("random_books_seeded", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, ratings_count FROM (
  SELECT * FROM bookparts ORDER BY md5(CAST(sha AS VARCHAR) || '#42'), sha LIMIT 10)""")
def random_books_seeded(spark, root):
    return (serve.random_books(st.bookparts(spark, root), 10, 42, order_by="-ratings_count")
            .select("sha", "title", "ratings_count"))


@register("distinct_best_title", f"""WITH {st.BOOKPARTS_SQL}
SELECT title_key, sha, title, ratings_count FROM (
  SELECT *, trim(title) AS title_key,
         row_number() OVER (PARTITION BY trim(title) ORDER BY ratings_count DESC NULLS LAST, sha) AS n
  FROM bookparts WHERE title IS NOT NULL AND title <> 'red widget') WHERE n = 1""")
def distinct_best_title(spark, root):
    return (serve.best_per_title(st.bookparts(spark, root), ignore_title="red widget")
            .select("title_key", "sha", "title", "ratings_count"))


@register("similar_books_same_cell", f"""WITH {st.BOOKPARTS_SQL},
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY bmu_col, bmu_row
                                    ORDER BY ratings_count DESC NULLS LAST, sha) AS INTEGER) AS rk
  FROM bookparts WHERE bmu_col IS NOT NULL AND bmu_row IS NOT NULL),
pairs AS (
  SELECT s.sha AS src_sha, t.sha, t.title, t.author, t.ratings_count, t.rk
  FROM bookparts s JOIN top t ON s.bmu_col = t.bmu_col AND s.bmu_row = t.bmu_row
  WHERE t.rk <= 50 AND t.title IS NOT NULL AND t.title IS DISTINCT FROM s.title)
SELECT src_sha, sha, title, author, ratings_count, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY src_sha, trim(title) ORDER BY rk) AS n FROM pairs)
WHERE n = 1""")
def similar_books_same_cell(spark, root):
    return serve.similar_books(st.bookparts(spark, root))


# --- group A5 / F: extraction and text ------------------------------------------

from shelfmap.functions import text as tx  # noqa: E402
from shelfmap.operators import text as txo  # noqa: E402
from shelfmap.plans import sqltext as sq  # noqa: E402

TOKENS_CTE = f""",
docs AS (SELECT sha, {sq.doc_text_sql()} AS text FROM training),
toks AS (SELECT sha, {sq.word_tokens_sql('text')} AS tokens FROM docs)"""


def _training_tokens(spark, root):
    docs = st.training_docs(spark, root).select("sha", tx.doc_text().alias("text"))
    return txo.tokenize(docs, "text", "tokens")


@register("training_extract", f"WITH {st.TRAINING_SQL} SELECT sha, title, summary FROM training "
          "WHERE sha IN (SELECT sha FROM bookdocs WHERE spider = 'src3')")
def training_extract(spark, root):
    from shelfmap.sources.tables import training_extract as extract
    return extract(st.bookdocs(spark, root), 400, language="en", spider="src3")


@register("doc_text", f"WITH {st.TRAINING_SQL} SELECT sha, {sq.doc_text_sql()} AS text FROM training")
def doc_text(spark, root):
    return st.training_docs(spark, root).select("sha", tx.doc_text().alias("text"))


@register("clean_text", f"WITH {st.BOOKDOCS_SQL} SELECT sha, {sq.clean_sql('summary')} AS clean FROM bookdocs")
def clean_text(spark, root):
    return st.bookdocs(spark, root).select("sha", tx.clean_text(F.col("summary")).alias("clean"))


@register("word_df_min2", f"""WITH {st.TRAINING_SQL}{TOKENS_CTE}
SELECT term, count(DISTINCT sha) AS df FROM (SELECT sha, unnest(tokens) AS term FROM toks)
GROUP BY term HAVING count(DISTINCT sha) >= 2""")
def word_df_min2(spark, root):
    return txo.doc_freq(_training_tokens(spark, root), "sha", "tokens", min_df=2)


@register("bigram_totals_min10", f"""WITH {st.TRAINING_SQL}{TOKENS_CTE},
bg AS (SELECT sha, unnest({sq.bigrams_sql('tokens')}) AS term FROM toks)
SELECT term, count(DISTINCT sha) AS df, CAST(count(*) AS BIGINT) AS total FROM bg
GROUP BY term HAVING count(DISTINCT sha) >= 10""")
def bigram_totals_min10(spark, root):
    bg = txo.add_bigrams(_training_tokens(spark, root), "tokens", "bigrams")
    return txo.vocabulary(bg, "sha", "bigrams", min_df=10).select("term", "df", "total")


@register("dict_prune", f"""WITH {st.TRAINING_SQL},
toks AS (SELECT sha, {sq.alpha_tokens_sql(sq.doc_text_sql())} AS tokens FROM training),
stats AS (SELECT term, count(DISTINCT sha) AS df FROM (SELECT sha, unnest(tokens) AS term FROM toks)
          GROUP BY term)
SELECT term, df FROM stats
WHERE df >= 2 AND df <= CAST(floor(0.85 * (SELECT count(*) FROM training)) AS BIGINT)
ORDER BY df DESC, term LIMIT 100000""")
def dict_prune(spark, root):
    docs = st.training_docs(spark, root).select("sha", tx.doc_text().alias("text"))
    toks = txo.tokenize(docs, "text", "tokens", stop=False, alpha=True)
    stats = txo.doc_freq(toks, "sha", "tokens")
    return txo.prune_dictionary(stats, docs.count(), 2, 0.85, 100_000).select("term", "df")


@register("bag_of_words", f"""WITH {st.TRAINING_SQL}{TOKENS_CTE},
bag AS (SELECT sha, term, count(*) AS n FROM (SELECT sha, unnest(tokens) AS term FROM toks)
        GROUP BY sha, term),
vocab AS (SELECT term FROM bag GROUP BY term HAVING count(*) >= 2)
SELECT sha, term, n FROM bag WHERE term IN (SELECT term FROM vocab)""")
def bag_of_words(spark, root):
    toks = _training_tokens(spark, root)
    return (txo.bag_with_vocabulary(toks, "sha", "tokens", min_df=2)
            .select(F.col("doc").alias("sha"), "term", "n"))


# --- group G: similarity and map placement ----------------------------------------

from shelfmap.operators import similarity as sim  # noqa: E402
from shelfmap.operators import som  # noqa: E402

JS_SQL = """sqrt(greatest(list_sum(list_transform(range(1, len(a) + 1), lambda i:
    CASE WHEN a[i] > 0 THEN a[i] * ln(a[i] / ((a[i] + b[i]) / 2)) ELSE 0 END
  + CASE WHEN b[i] > 0 THEN b[i] * ln(b[i] / ((a[i] + b[i]) / 2)) ELSE 0 END)) / 2, 0))"""

CENTROID_SQL = """,
pe AS (SELECT label, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS v FROM dist),
cen AS (SELECT label AS qid, list(v ORDER BY i) AS q FROM
        (SELECT label, i, avg(v) AS v FROM pe GROUP BY label, i) GROUP BY label),
pairs AS (SELECT qid, sha, JS AS d FROM (
  SELECT c.qid, t.sha,
         list_transform(c.q, lambda x: x / list_sum(c.q)) AS b,
         list_transform(t.p, lambda x: x / list_sum(t.p)) AS a
  FROM cen c CROSS JOIN dist t))""".replace("JS", JS_SQL)


def _knn(spark, root, drop_zero):
    dist = st.dist(spark, root)
    out = sim.js_knn(dist, sim.label_centroids(dist), k=10, drop_zero=drop_zero)
    return out.select("qid", "sha", F.round("d", 6).alias("d"), F.col("rank").cast("int").alias("rank"))


@register("js_knn", f"""WITH {st.DIST_SQL}{CENTROID_SQL}
SELECT qid, sha, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, sha) AS rank FROM pairs)
WHERE rank <= 10""")
def js_knn(spark, root):
    return _knn(spark, root, False)


@register("js_knn_nonzero", f"""WITH {st.DIST_SQL}{CENTROID_SQL}
SELECT qid, sha, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, sha) AS rank FROM pairs
  WHERE d > 1e-9) WHERE rank <= 10""")
def js_knn_nonzero(spark, root):
    return _knn(spark, root, True)


@register("js_knn_own_rows", f"""WITH {st.DIST_SQL},
own AS (SELECT sha AS qid, p AS a FROM dist WHERE sha % 100 = 0),
pairs AS (SELECT o.qid, d.sha, {JS_SQL} AS d FROM own o CROSS JOIN (SELECT sha, p AS b FROM dist) d)
SELECT qid, sha, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, sha) AS rank FROM pairs
  WHERE d > 1e-9) WHERE rank <= 10""")
def js_knn_own_rows(spark, root):
    """G5 with stored rows as queries: each finds itself at distance 0, which is left out."""
    dist = st.dist(spark, root)
    own = dist.where(F.col("sha") % 100 == 0).select(F.col("sha").alias("qid"), F.col("p").alias("q"))
    out = sim.js_knn(dist, own, k=10, drop_zero=True)
    return out.select("qid", "sha", F.round("d", 6).alias("d"), F.col("rank").cast("int").alias("rank"))


BMU_SQL = f"""WITH {st.VECTORS_SQL}, {st.CODEBOOK_SQL},
dd AS (SELECT v.sha, c.unit, c.col, c."row", list_distance(v.x, c.w) AS d
       FROM vectors v CROSS JOIN codebook c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY d, unit) AS rank FROM dd)"""


def _assign(spark, root, top_n=1):
    return som.assign_bmu(st.vectors(spark, root), st.codebook(spark, root), "sha", "x", top_n)


@register("bmu_assign", BMU_SQL + """
SELECT sha, unit, col AS bmu_col, "row" AS bmu_row, round(d, 6) AS d FROM ranked WHERE rank = 1""")
def bmu_assign(spark, root):
    return _assign(spark, root).select("sha", "unit", "bmu_col", "bmu_row", F.round("d", 6).alias("d"))


@register("bmu_top3", BMU_SQL + """
SELECT sha, CAST(rank AS INTEGER) AS rank, unit, round(d, 6) AS d FROM ranked WHERE rank <= 3""")
def bmu_top3(spark, root):
    return _assign(spark, root, 3).select("sha", "rank", "unit", F.round("d", 6).alias("d"))


@register("umatrix", f"""WITH {st.CODEBOOK_SQL},
offs AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE NOT (dr = 0 AND dc = 0)),
nb AS (SELECT DISTINCT c.unit, o.unit AS nunit FROM codebook c, offs
       JOIN codebook o ON o."row" = ((c."row" + dr) % {st.GRID_ROWS} + {st.GRID_ROWS}) % {st.GRID_ROWS}
                      AND o.col = ((c.col + dc) % {st.GRID_COLS} + {st.GRID_COLS}) % {st.GRID_COLS}
       WHERE o.unit <> c.unit)
SELECT c.unit, c."row", c.col, round(avg(list_distance(c.w, o.w)), 6) AS u
FROM nb JOIN codebook c ON c.unit = nb.unit JOIN codebook o ON o.unit = nb.nunit
GROUP BY c.unit, c."row", c.col""")
def umatrix(spark, root):
    u = som.umatrix(st.codebook(spark, root), st.GRID_ROWS, st.GRID_COLS)
    return u.select("unit", "row", "col", F.round("u", 6).alias("u"))


CELLS_SQL = BMU_SQL + f""",
assign AS (SELECT sha, col AS bmu_col, "row" AS bmu_row FROM ranked WHERE rank = 1),
grid AS (SELECT CAST(i % {st.GRID_COLS} AS INTEGER) AS bmu_col, CAST(i // {st.GRID_COLS} AS INTEGER) AS bmu_row
         FROM range({st.GRID_ROWS * st.GRID_COLS}) t(i)),
members AS (SELECT g.bmu_col, g.bmu_row, a.sha FROM grid g LEFT JOIN assign a
            ON a.bmu_col = g.bmu_col AND a.bmu_row = g.bmu_row)"""


def _members(spark, root):
    a = _assign(spark, root).select("sha", "bmu_col", "bmu_row")
    return som.cell_members(a, spark, st.GRID_ROWS, st.GRID_COLS)


@register("cell_members", CELLS_SQL + "\nSELECT bmu_col, bmu_row, sha FROM members")
def cell_members(spark, root):
    return _members(spark, root)


@register("members_to_books", CELLS_SQL + """
SELECT e.vec_id AS sha, e.label, m.bmu_col, m.bmu_row FROM embeddings e
LEFT JOIN members m ON m.sha = e.vec_id""")
def members_to_books(spark, root):
    from shelfmap.sources.tables import read_table
    books = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("sha"), "label")
    return som.members_to_books(books, _members(spark, root))


@register("cell_set_add", CELLS_SQL + f""",
{st.BOOKPARTS_SQL}
SELECT DISTINCT u.bmu_col, u.bmu_row, u.sha FROM (
  SELECT bmu_col, bmu_row, sha FROM bookparts
  UNION ALL SELECT bmu_col, bmu_row, sha FROM members WHERE sha IS NOT NULL) u
WHERE EXISTS (SELECT 1 FROM grid g WHERE g.bmu_col = u.bmu_col AND g.bmu_row = u.bmu_row)""")
def cell_set_add(spark, root):
    old = st.bookparts(spark, root).select("bmu_col", "bmu_row", "sha")
    new = _members(spark, root).where(F.col("sha").isNotNull())
    return som.cell_set_add(old, new, spark, st.GRID_ROWS, st.GRID_COLS)


# --- group F: word map features -------------------------------------------------

from shelfmap.functions.arrays import explode_indexed, gaussian_weights  # noqa: E402
from shelfmap.operators import words as wo  # noqa: E402


def _word_vocab(spark, root):
    toks = _training_tokens(spark, root)
    return toks, txo.doc_freq(toks, "sha", "tokens", min_df=10)


def _bigram_totals(toks):
    bg = txo.add_bigrams(toks, "tokens", "bigrams")
    return txo.vocabulary(bg, "sha", "bigrams", min_df=10).select("term", "total")


def _long(df, key, col, name="v"):
    """Arrays as ``(key, i, v)`` rows; values here are exact, so no rounding."""
    return df.select(key, explode_indexed(F.col(col), "i", name))


WORDS_SQL = f"""WITH {st.TRAINING_SQL}{TOKENS_CTE},
vocab AS (SELECT term AS word FROM (SELECT DISTINCT sha, unnest(tokens) AS term FROM toks)
          GROUP BY term HAVING count(*) >= 10),
wv AS (SELECT word, CAST(i AS INTEGER) AS i,
              ('0x' || substr(md5(word || '#' || CAST(i AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 AS v
       FROM vocab, range(0, {wo.WORD_DIMS}) t(i)),
bgall AS (SELECT sha, unnest({sq.bigrams_sql('tokens')}) AS term FROM toks),
bigrams AS (SELECT term, count(*) AS total FROM bgall GROUP BY term HAVING count(DISTINCT sha) >= 10),
bg AS (SELECT split_part(term, ' ', 1) AS w1, split_part(term, ' ', 2) AS w2, total FROM bigrams),
side AS (
  SELECT w1 AS word, 0 AS half, w2 AS other, total FROM bg
  UNION ALL SELECT w2 AS word, 1 AS half, w1 AS other, total FROM bg),
den AS (SELECT word, half, sum(total) AS den FROM side GROUP BY word, half),
num AS (SELECT s.word, s.half, v.i, sum(s.total * v.v) AS num FROM side s JOIN wv v ON v.word = s.other
        GROUP BY s.word, s.half, v.i),
enc AS (
  SELECT w.word, CAST(h.half * {wo.WORD_DIMS} + d.i AS INTEGER) AS i,
         CASE WHEN den.den > 0 THEN coalesce(num.num, 0) / den.den ELSE 0 END AS v
  FROM vocab w CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1) h CROSS JOIN range(0, {wo.WORD_DIMS}) d(i)
  LEFT JOIN den ON den.word = w.word AND den.half = h.half
  LEFT JOIN num ON num.word = w.word AND num.half = h.half AND num.i = d.i)"""


@register("word_vectors", WORDS_SQL + "\nSELECT word, i, v FROM wv")
def word_vectors(spark, root):
    _, vocab = _word_vocab(spark, root)
    return _long(wo.word_vectors(vocab, "term", wo.WORD_DIMS), "word", "vec")


def _encoding(spark, root):
    # Both are read more than once below and are far smaller than the texts, which are cut into words once for each.
    toks, vocab = _word_vocab(spark, root)
    vecs = wo.word_vectors(reliable_checkpoint(vocab), "term", wo.WORD_DIMS)
    return wo.context_encoding(vecs, reliable_checkpoint(_bigram_totals(toks)), wo.WORD_DIMS)


@register("kaski_encoding", WORDS_SQL + "\nSELECT word, i, v FROM enc")
def kaski_encoding(spark, root):
    return _long(_encoding(spark, root), "word", "enc")


@register("word_minmax", WORDS_SQL + """,
mm AS (SELECT word, min(v) AS lo, max(v) AS hi FROM enc GROUP BY word)
SELECT e.word, e.i, CASE WHEN mm.hi = mm.lo THEN 0 ELSE (e.v - mm.lo) / (mm.hi - mm.lo) END AS v
FROM enc e JOIN mm ON mm.word = e.word""")
def word_minmax(spark, root):
    return _long(wo.word_minmax(_encoding(spark, root)), "word", "scaled")


HIST_UNITS = st.HIST_ROWS * st.HIST_COLS
_W = gaussian_weights(normalized=False)
_R = len(_W) // 2
HIST_SQL = f"""WITH {st.TRAINING_SQL}{TOKENS_CTE},
bag AS (SELECT sha, term, count(*) AS n FROM (SELECT sha, unnest(tokens) AS term FROM toks) GROUP BY sha, term),
vocab AS (SELECT term FROM bag GROUP BY term HAVING count(*) >= 10),
cells AS (SELECT term, CAST((('0x' || substr(md5(term), 1, 8))::UBIGINT % {HIST_UNITS}) AS INTEGER) AS idx FROM vocab),
hits AS (SELECT b.sha, c.idx, CAST(sum(b.n) AS BIGINT) AS n FROM bag b JOIN cells c ON c.term = b.term
         GROUP BY b.sha, c.idx),
dense AS (SELECT t.sha, CAST(r.i AS INTEGER) AS i, coalesce(h.n, 0)::DOUBLE AS h
          FROM training t CROSS JOIN range(0, {HIST_UNITS}) r(i)
          LEFT JOIN hits h ON h.sha = t.sha AND h.idx = r.i),
kern AS (SELECT * FROM (VALUES {", ".join(f"({k - _R}, {w!r})" for k, w in enumerate(_W))}) kv(k, w)),
blur AS (SELECT d.sha, d.i, sum(kern.w * s.h) AS b FROM dense d CROSS JOIN kern
         JOIN dense s ON s.sha = d.sha AND s.i = CASE
           WHEN ((d.i + kern.k) % {2 * HIST_UNITS} + {2 * HIST_UNITS}) % {2 * HIST_UNITS} < {HIST_UNITS}
           THEN ((d.i + kern.k) % {2 * HIST_UNITS} + {2 * HIST_UNITS}) % {2 * HIST_UNITS}
           ELSE {2 * HIST_UNITS - 1} - ((d.i + kern.k) % {2 * HIST_UNITS} + {2 * HIST_UNITS}) % {2 * HIST_UNITS} END
         GROUP BY d.sha, d.i),
mm AS (SELECT sha, min(b) AS lo, max(b) AS hi FROM blur GROUP BY sha)"""


def _hits(spark, root):
    toks = _training_tokens(spark, root)
    counts = txo.term_counts(toks, "sha", "tokens")
    vocab = txo.term_stats(counts).where(F.col("df") >= 10).select("term")
    cells = vocab.select("term", wo.md5_cell(F.col("term"), HIST_UNITS).alias("u")).select(
        "term", (F.col("u") % st.HIST_COLS).alias("bmu_col"), (F.col("u") / st.HIST_COLS).cast("int").alias("bmu_row"))
    return toks, wo.hit_counts(counts, cells, st.HIST_COLS)


@register("hit_histogram", HIST_SQL + "\nSELECT sha, idx, n FROM hits")
def hit_histogram(spark, root):
    _, hits = _hits(spark, root)
    return hits.select(F.col("doc").alias("sha"), "idx", "n")


@register("hit_histogram_blur", HIST_SQL + """
SELECT b.sha, b.i, CASE WHEN mm.hi = mm.lo THEN 0 ELSE (b.b - mm.lo) / (mm.hi - mm.lo) END AS v
FROM blur b JOIN mm ON mm.sha = b.sha""")
def hit_histogram_blur(spark, root):
    toks, hits = _hits(spark, root)
    dense = wo.dense_histogram(toks.select(F.col("sha").alias("doc")), hits, HIST_UNITS)
    out = wo.blurred_histogram(dense)
    return _long(out.select(F.col("doc").alias("sha"), "h"), "sha", "h")


# --- group G: models (no SQL oracle; invariants in tests) -------------------------

from shelfmap.operators import topics as tp  # noqa: E402


def map_epochs(spark) -> int:
    """Epochs of the registered maps: the reference's, unless ``spark.shelfmap.mapEpochs`` names another number."""
    return int(spark.conf.get("spark.shelfmap.mapEpochs", str(som.EPOCHS)))


def _topic_model(spark, root):
    docs = st.training_docs(spark, root).select("sha", tx.doc_text().alias("text"))
    return docs, tp.fit_topics(docs, "text")


@register("lda_topics")
def lda_topics(spark, root):
    docs, model = _topic_model(spark, root)
    return tp.topic_distribution(model, docs, "sha", "text")


@register("som_train")
def som_train(spark, root):
    data = st.dist(spark, root)
    W, errors = som.train_som(data, "p", st.GRID_ROWS, st.GRID_COLS, epochs=map_epochs(spark))
    cb = som.codebook_frame(spark, W, st.GRID_ROWS, st.GRID_COLS)
    return cb.withColumn("qe", F.lit(float(errors[-1])))


EPOCH_RADIUS = 3.0


@register("som_epoch", f"""WITH {st.DIST_SQL},
{st.CODEBOOK_SQL.replace("embedding AS DOUBLE[]", "p AS DOUBLE[]").replace("generate_subscripts(embedding, 1)", "generate_subscripts(p, 1)")
 .replace("vec_id", "sha").replace("FROM embeddings", "FROM dist")},
dd AS (SELECT d.sha, d.p, c.unit, list_distance(d.p, c.w) AS d FROM dist d CROSS JOIN codebook c),
best AS (SELECT sha, p, unit FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY d, unit) AS rank FROM dd) WHERE rank = 1),
sums AS (SELECT unit, i, sum(v) AS s, count(*) AS n FROM (SELECT unit, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM best)
         GROUP BY unit, i),
near AS (
  SELECT a.unit, b.unit AS other,
    pow(least(abs(a."row" - b."row"), {st.GRID_ROWS} - abs(a."row" - b."row")), 2)
    + pow(least(abs(a.col - b.col), {st.GRID_COLS} - abs(a.col - b.col)), 2) AS d2
  FROM codebook a CROSS JOIN codebook b),
moved AS (
  SELECT n.unit, s.i, sum(exp(-d2 / {2 * EPOCH_RADIUS ** 2}) * s.s) / sum(exp(-d2 / {2 * EPOCH_RADIUS ** 2}) * s.n) AS w
  FROM near n JOIN sums s ON s.unit = n.other WHERE sqrt(d2) <= {EPOCH_RADIUS} GROUP BY n.unit, s.i),
old AS (SELECT unit, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM codebook)
SELECT old.unit, CAST(old.i AS INTEGER) AS i, round(coalesce(moved.w, old.w), 6) AS w FROM old LEFT JOIN moved USING (unit, i)""")
def som_epoch(spark, root):
    """One epoch of the batch rule from a fixed codebook (means of the distributions)."""
    data = st.dist(spark, root).select(F.col("p").alias("x"), "sha")
    start = st.codebook(spark, root, rows=st.GRID_ROWS, cols=st.GRID_COLS, vecs=data)
    W = som.codebook_arrays(start)[3].reshape(st.GRID_ROWS, st.GRID_COLS, -1)
    W, _ = som.som_epoch(data, W, EPOCH_RADIUS)
    cb = som.codebook_frame(spark, W, st.GRID_ROWS, st.GRID_COLS)
    return cb.select("unit", F.posexplode("w").alias("i", "w")).select("unit", "i", F.round("w", 6).alias("w"))


@register("place_texts")
def place_texts(spark, root):
    from shelfmap.sources.tables import read_table
    docs, model = _topic_model(spark, root)
    dist = tp.topic_distribution(model, docs, "sha", "text")
    W, _ = som.train_som(dist, "p", st.GRID_ROWS, st.GRID_COLS, epochs=map_epochs(spark))
    cb = som.codebook_frame(spark, W, st.GRID_ROWS, st.GRID_COLS)
    texts = read_table(spark, root, "benchmark").select(F.col("item_id").alias("id"), "text")
    return tp.place_texts(texts, model, cb, "id", "text")


# --- A16 / H: upsert and streaming -----------------------------------------------

from shelfmap.operators import upsert as up  # noqa: E402
from shelfmap.sources.tables import dealt, read_table  # noqa: E402
from shelfmap.streaming import placement as sp  # noqa: E402

CUT = "2024-01-16 00:00:00"


def _partial_events(spark, root):
    return _as_partial(read_table(spark, root, "events"))


def _as_partial(e):
    return e.select("user_id", F.col("event_id").alias("sha"), "ts", "event_id",
                    F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"),
                    "value", "props")


@register("upsert_latest", """
SELECT user_id, min(event_id) AS sha,
       arg_max(event_type, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0 AND event_type IS NOT NULL) AS event_type,
       arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value,
       arg_max(props, (ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events GROUP BY user_id""")
def upsert_latest(spark, root):
    ev = _partial_events(spark, root)
    order = ["ts", "event_id"]
    stored = up.merge_batch(ev.where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")), "user_id", order)
    batch = ev.where(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    out = up.upsert(stored, batch, "user_id", order)
    return out.select("user_id", "sha", "event_type", "value", "props",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("stream_place", BMU_SQL + """
SELECT sha, unit, col AS bmu_col, "row" AS bmu_row, round(d, 6) AS d FROM ranked WHERE rank = 1""")
def stream_place(spark, root):
    path = f"{root.rstrip('/')}/[e]mbeddings.parquet"     # glob: the file source lists a folder
    schema = read_table(spark, root, "embeddings").schema
    cb = st.codebook(spark, root)

    def place(batch):
        vecs = batch.select(F.col("vec_id").alias("sha"), F.col("embedding").cast("array<double>").alias("x"))
        return som.assign_bmu(vecs, cb, "sha", "x").drop("rank")

    out = sp.stream_place_folder(spark, path, schema, place)
    return out.select("sha", "unit", "bmu_col", "bmu_row", F.round("d", 6).alias("d"))


# --- group A / S: extraction and scalar functions ------------------------------------

from shelfmap.functions import scalars as sc  # noqa: E402
from shelfmap.functions.predicates import path_label, query_param  # noqa: E402
from shelfmap.schema import SHOP_LINK_COLUMNS, SHOP_NAMES  # noqa: E402
from shelfmap.sources import extract as ex  # noqa: E402

STRIP_SQL = "regexp_replace(replace(replace({e}, chr(10), ''), chr(9), ''), '^[{sp}]+|[{sp}]+$', '', 'g')"


def _strip_sql(e: str) -> str:
    return STRIP_SQL.format(e=e, sp=sq.SP)


def _unescape_sql(e: str) -> str:
    """The character references that occur in the supplied pages, ampersand last."""
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{code}', '{char}')"
    return e


ROW_SQL = r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
TABLE_SQL = r'(?is)<table[^>]*class="[^"]*bibrec[^"]*"[^>]*>(.*?)</table>'


def _first_text_sql(e: str) -> str:
    return f"nullif({_strip_sql(f'regexp_extract({e}, ' + chr(39) + '(?s)^([^<]*)' + chr(39) + ', 1)')}, '')"


def _pick_sql(word: str, value: str) -> str:
    return (f"list_filter(list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN contains(hs[i], '{word}') "
            f"THEN {value} END), lambda v: v IS NOT NULL)[1]")


@register("page_fields", f"""
SELECT page_id,
       nullif({_strip_sql(_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS page_title,
       nullif(regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1), '') AS lang,
       {_pick_sql('Author', _first_text_sql("regexp_extract(ds[i], '(?is)<a[^>]*>(.*?)</a>', 1)"))} AS author,
       {_pick_sql('Title', _first_text_sql('ds[i]'))} AS title,
       {_pick_sql('Language', _first_text_sql('ds[i]'))} AS language
FROM (SELECT page_id, html,
             regexp_extract_all(regexp_extract(html, '{TABLE_SQL}', 1), '{ROW_SQL}', 1) AS hs,
             regexp_extract_all(regexp_extract(html, '{TABLE_SQL}', 1), '{ROW_SQL}', 2) AS ds
      FROM pages)""")
def page_fields(spark, root):
    pages = dealt(read_table(spark, root, "pages"))
    pages = pages.withColumn("lang", ex.page_lang(F.col("html")))
    fields = ex.html_table_fields(pages, keep=("lang",), more={"page_title": F.regexp_extract("html", ex.TITLE_RE, 1)})
    return fields.select("page_id", "page_title", "lang", "author", "title", "language")


@register("catalogue_fields", """
SELECT doc_id AS page_id, source || ', J. & Co' AS author, 'https://gutenberg.org/ebooks/author/' || CAST(doc_id AS VARCHAR) AS author_url,
       'Tom & ' || source || ' <' || CAST(doc_id AS VARCHAR) || '>' AS title, 'é ' || lang AS summary, 'Team ' || lang AS credits,
       lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'Ed ' || source END AS editor,
       CASE WHEN doc_id % 5 <> 0 THEN CAST(DATE '1999-01-05' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR) END AS release
FROM documents""")
def catalogue_fields(spark, root):
    """A7 on catalogue tables made of documents: every field filled, references encoded, bad dates."""
    key, text = F.col("doc_id").cast("string"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    day = F.date_format(F.date_add(F.lit("1999-01-05").cast("date"), (F.col("doc_id") % 300).cast("int")), "MMM d, yyyy")
    rows = [("Author", text('<a href="/ebooks/author/', key, '">', F.col("source"), ", J. &amp; Co</a>")),
            ("Title", text("\n Tom &amp; ", F.col("source"), " &lt;", key, "&gt;\t<br>rest")),
            ("Summary", text("&eacute; ", F.col("lang"))), ("Credits", text("Team ", F.col("lang"))),
            ("Language", F.col("lang")), ("Editor", F.lit("")),
            ("Editor", F.when(F.col("doc_id") % 2 == 0, text("Ed ", F.col("source"))).otherwise("")),
            ("Release Date", F.when(F.col("doc_id") % 5 != 0, day).otherwise("some day"))]
    html = text('<html><table class="bibrec">', *[text(f"<tr><th>{h}</th><td>", v, "</td></tr>") for h, v in rows], "</table></html>")
    pages = read_table(spark, root, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    out = ex.html_table_fields(pages)
    return out.withColumn("release", F.date_format("release", "yyyy-MM-dd"))


PATH_RULES = [("/en/", "english"), ("/fr/", "french"), ("/de/", "german"), ("/es/", "spanish")]


@register("url_parts", f"""
SELECT page_id, host, path, query,
       TRY_CAST(nullif(regexp_extract(query, '(?:^|&)page=([^&]*)', 1), '') AS INTEGER) AS page,
       nullif(regexp_extract(query, '(?:^|&)utm_source=([^&]*)', 1), '') AS utm_source,
       split_part(url, '/', -1) AS last_segment,
       CASE {" ".join(f"WHEN contains(path, '{a}') THEN '{b}'" for a, b in PATH_RULES)} END AS section,
       'https://www.example.org/book/' || CAST(page_id AS VARCHAR) AS book_url
FROM (SELECT page_id, url,
             regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
             regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
             CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query
      FROM pages)""")
def url_parts(spark, root):
    p = dealt(read_table(spark, root, "pages"))
    path = F.try_parse_url(F.col("url"), F.lit("PATH"))
    return p.select(
        "page_id",
        F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"),
        path.alias("path"),
        F.try_parse_url(F.col("url"), F.lit("QUERY")).alias("query"),
        query_param(F.col("url"), "page", "int").alias("page"),
        query_param(F.col("url"), "utm_source").alias("utm_source"),
        sc.last_segment(F.col("url")).alias("last_segment"),
        path_label(path, PATH_RULES).alias("section"),
        sc.page_url("https://www.example.org/book/", F.col("page_id")).alias("book_url"))


@register("affiliate_links", """
SELECT page_id, NULL::VARCHAR AS link_page,
       'http://' || host || '/gp/product/B' || CAST(page_id AS VARCHAR) || '/ref=nosim?tag=t-20' AS link_gp,
       'http://' || host || '/dp/' || CAST(page_id AS VARCHAR) || '/ref=nosim?tag=t-20' AS link_dp
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)""")
def affiliate_links(spark, root):
    p = dealt(read_table(spark, root, "pages"))
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    gp = F.concat(F.lit("https://"), host, F.lit("/gp/product/B"), F.col("page_id").cast("string"), F.lit("/ref=x?y=1"))
    dp = F.concat(F.lit("https://"), host, F.lit("/dp/"), F.col("page_id").cast("string"))
    return p.select("page_id", sc.affiliate_link(F.col("url"), "t-20").alias("link_page"),
                    sc.affiliate_link(gp, "t-20").alias("link_gp"),
                    sc.affiliate_link(dp, "t-20").alias("link_dp"))


@register("date_parsers", """
SELECT event_id, strftime(ts, '%b %-d, %Y') AS s5_in,
       strftime(strptime(strftime(ts, '%b %-d, %Y'), '%b %-d, %Y'), '%Y-%m-%d') AS s5,
       strftime(ts, '%Y') || '-01-01' AS s6, strftime(ts, '%Y') AS s2,
       CASE WHEN CAST(round(value * 1000) AS BIGINT) <> 0 THEN CAST(round(value * 1000) AS BIGINT) END AS s4_ms
FROM events""")
def date_parsers(spark, root):
    e = read_table(spark, root, "events")
    s5_in = F.date_format("ts", "MMM d, yyyy")
    iso = F.date_format("ts", "yyyy-MM-dd")
    ms = F.round(F.col("value") * 1000).cast("long")
    return e.select("event_id", s5_in.alias("s5_in"),
                    F.date_format(sc.parse_month_day_year(s5_in), "yyyy-MM-dd").alias("s5"),
                    F.date_format(sc.free_year(iso), "yyyy-MM-dd").alias("s6"),
                    sc.year_prefix(iso).alias("s2"),
                    F.unix_millis(sc.millis_to_ts(ms)).alias("s4_ms"))


def _metadata_json(spark, root):
    b = st.bookdocs(spark, root)
    md = F.struct(F.col("sha").cast("string").alias("identifier"), F.col("title"),
                  F.array("spider", "language").alias("creator"), F.col("summary").alias("description"),
                  F.array("language").alias("subject"), F.col("language"),
                  F.lit(None).cast("string").alias("isbn"), F.col("spider").alias("publisher"))
    return b.select("sha", F.to_json(F.struct(md.alias("metadata"))).alias("json"))


@register("json_metadata", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, CAST(sha AS VARCHAR) AS book_id, 'http://archive.org/details/' || CAST(sha AS VARCHAR) AS url,
       nullif({_strip_sql('title')}, '') AS title, nullif({_strip_sql("spider || ' ' || language")}, '') AS author,
       nullif({_strip_sql('summary')}, '') AS summary, nullif({_strip_sql('language')}, '') AS subject,
       nullif({_strip_sql('language')}, '') AS language, NULL::VARCHAR AS isbn_10,
       nullif({_strip_sql('spider')}, '') AS editor
FROM bookdocs""")
def json_metadata(spark, root):
    out = ex.metadata_fields(_metadata_json(spark, root))
    return out.select("sha", "book_id", "url", "title", "author", "summary", "subject", "language",
                      "isbn_10", "editor")


@register("first_isbn", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, CASE WHEN language = 'en' THEN lpad(CAST(sha AS VARCHAR), 10, '0') END AS isbn_10,
       'https://archive.org/download/' || CAST(sha AS VARCHAR) || '/' || CAST(sha AS VARCHAR) || '_djvu.txt' AS text_url
FROM bookdocs""")
def first_isbn(spark, root):
    b = st.bookdocs(spark, root)
    ident = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("identifier"))
    ids13 = F.array(ident("ISBN_13", F.concat(F.lit("978"), F.col("sha").cast("string"))))
    ids = F.when(F.col("language") == "en", F.concat(
        ids13, F.array(ident("ISBN_10", F.lpad(F.col("sha").cast("string"), 10, "0"))))).otherwise(ids13)
    items = F.array(F.struct(F.struct(F.array().cast("array<struct<type:string,identifier:string>>")
                                      .alias("industryIdentifiers")).alias("volumeInfo")),
                    F.struct(F.struct(ids.alias("industryIdentifiers")).alias("volumeInfo")))
    sha = F.col("sha").cast("string")
    files = F.array(F.struct(F.concat(sha, F.lit(".pdf")).alias("name"), F.lit("Text PDF").alias("format")),
                    F.struct(F.concat(sha, F.lit("_djvu.txt")).alias("name"), F.lit("DjVuTXT").alias("format")))
    j = b.select("sha", F.to_json(F.struct(items.alias("items"))).alias("vol"),
                 F.to_json(F.struct(files.alias("files"))).alias("files"))
    return j.select("sha", ex.first_isbn10(F.col("vol")).alias("isbn_10"),
                    ex.first_file_url(F.col("files"), F.col("sha").cast("string")).alias("text_url"))


SHOPS = list(SHOP_NAMES)


def _shop_of(h):
    names = F.array(*[F.lit(n) for n in SHOPS])
    i = (F.conv(F.substring(F.md5(h), 1, 8), 16, 10).cast("long") % len(SHOPS)).cast("int")
    return F.element_at(names, i + 1)


def _goodreads_pages(spark, root):
    p = dealt(read_table(spark, root, "pages"))
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r'<li><a href="([^"]*)"'), 1)
    kind = F.when(F.substring(F.md5(F.col("url")), 1, 1) < "8", "KindleLink").otherwise("AmazonLink")
    link = lambda t, n, u: F.struct(t.alias("__typename"), n.alias("name"), u.alias("url"))
    book = F.struct(ex.page_title(F.col("html")).alias("title"),
                    F.struct(F.concat(F.lit("Contributor:kca://author/"), F.col("page_id").cast("string")).alias("__ref"))
                    .alias("node").alias("primaryContributorEdge"),
                    F.struct(link(kind, F.lit("Amazon"), F.col("url")).alias("primaryAffiliateLink"),
                             F.transform(hrefs, lambda h: link(F.lit("Link"), _shop_of(h), h))
                             .alias("secondaryAffiliateLinks")).alias("links({})"))
    book = F.struct(book["title"].alias("title"),
                    F.struct(F.struct(F.concat(F.lit("Contributor:kca://author/"), F.col("page_id").cast("string"))
                                      .alias("__ref")).alias("node")).alias("primaryContributorEdge"),
                    book["links({})"].alias("links({})"))
    work = F.struct(F.struct((F.col("page_id") * 86400000).alias("publicationTime")).alias("details"),
                    F.struct(F.col("page_id").alias("ratingsCount"),
                             F.array(F.lit(0), F.col("page_id"), F.lit(2), F.lit(3), F.lit(4)).alias("ratingsCountDist"))
                    .alias("stats"))
    author = F.struct(ex.page_lang(F.col("html")).alias("name"))
    pid = F.col("page_id").cast("string")
    js = F.concat(F.lit('{"props":{"pageProps":{"apolloState":{"Work:kca://work/'), pid, F.lit('":'), F.to_json(work),
                  F.lit(',"Book:kca://book/'), pid, F.lit('":'), F.to_json(book),
                  F.lit(',"Contributor:kca://author/'), pid, F.lit('":'), F.to_json(author), F.lit("}}}}"))
    html = F.concat(F.lit('<html><body><script id="__NEXT_DATA__" type="application/json">'), js,
                    F.lit("</script></body></html>"))
    return p.select("page_id", F.concat(F.lit("https://www.example.org/book/show/"), pid).alias("url"),
                    html.alias("html"))


def _shop_sql():
    names = "[" + ", ".join(f"'{n}'" for n in SHOPS) + "]"
    shop = f"list_element({names}, CAST((('0x' || substr(md5(h), 1, 8))::UBIGINT % {len(SHOPS)}) AS INTEGER) + 1)"
    cols = []
    for name, column in SHOP_NAMES.items():
        first = f"list_filter(hrefs, lambda h: {shop} = '{name}')[1]"
        if column == "amazon_link":
            cols.append(f"coalesce(CASE WHEN kind <> 'KindleLink' THEN url END, {first}) AS amazon_link")
        else:
            cols.append(f"{first} AS {column}")
    return ",\n       ".join(cols)


@register("shop_links", f"""
SELECT page_id, 'gr_' || CAST(page_id AS VARCHAR) AS book_id,
       nullif({_strip_sql(_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
       nullif(regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1), '') AS author,
       CASE WHEN page_id > 0 THEN page_id END AS ratings_count,
       CASE WHEN page_id > 0 THEN page_id END AS rating_two_count,
       CAST(4 AS BIGINT) AS rating_five_count,
       CASE WHEN kind = 'KindleLink' THEN url END AS kindle_link,
       {_shop_sql()}
FROM (SELECT page_id, html, url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs,
             CASE WHEN substr(md5(url), 1, 1) < '8' THEN 'KindleLink' ELSE 'AmazonLink' END AS kind
      FROM pages)""")
def shop_links(spark, root):
    out = ex.page_json_fields(_goodreads_pages(spark, root))
    return out.select("page_id", "book_id", "title", "author", "ratings_count", "rating_two_count",
                      "rating_five_count", *SHOP_LINK_COLUMNS)


# --- A19 / A23-A26: sitemap and work lists ------------------------------------------------

from shelfmap.sources import sitemap as sm  # noqa: E402

SITE = "https://www.example.org/"
STATIC = [(SITE, "1.00"), (SITE + "about", "0.80"), (SITE + "legal", "0.80"), (SITE + "impressum", "0.80")]
LASTMOD = "2024-01-01"
SITEMAP_CHUNK = 500

SITEMAP_SQL = f"""WITH {st.BOOKPARTS_SQL},
statics AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{u}', '{p}')" for i, (u, p) in enumerate(STATIC))})
            s(pos, loc, priority)),
books AS (SELECT row_number() OVER (ORDER BY md5(CAST(sha AS VARCHAR) || '#42'), sha) + {len(STATIC) - 1} AS pos,
                 '{SITE}book/' || CAST(sha AS VARCHAR) AS loc, '0.80' AS priority FROM bookparts),
entries AS (SELECT CAST(floor(pos / {SITEMAP_CHUNK}) + 1 AS INTEGER) AS file_num, pos, loc, priority
            FROM (SELECT * FROM statics UNION ALL SELECT * FROM books))"""


def _entries(spark, root):
    return sm.sitemap_entries(spark, st.bookparts(spark, root), SITE + "book/", STATIC, LASTMOD, SITEMAP_CHUNK)


@register("sitemap_chunks", SITEMAP_SQL + f"""
SELECT file_num, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="{sm.XMLNS}">' || chr(10)
  || string_agg('  <url>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    <lastmod>{LASTMOD}</lastmod>'
     || chr(10) || '    <priority>' || priority || '</priority>' || chr(10) || '  </url>' || chr(10), '' ORDER BY pos)
  || '</urlset>' || chr(10) AS xml
FROM entries GROUP BY file_num""")
def sitemap_chunks(spark, root):
    return sm.sitemap_files(_entries(spark, root))


@register("sitemap_index", SITEMAP_SQL + f"""
SELECT DISTINCT file_num, '{SITE}sitemap_books_' || CAST(file_num AS VARCHAR) || '.xml' AS loc,
       '{LASTMOD}' AS lastmod FROM entries""")
def sitemap_index(spark, root):
    return sm.sitemap_index(st.bookparts(spark, root), STATIC, SITE, LASTMOD, SITEMAP_CHUNK)


@register("work_lists", f"""WITH {st.BOOKDOCS_SQL}, {st.BOOKPARTS_SQL}
SELECT 'repair' AS kind, sha AS id, '{SITE}book/show/' || CAST(sha AS VARCHAR) AS url FROM bookdocs
WHERE spider = 'src3' AND nullif(CASE WHEN sha % 3 = 0 THEN NULL WHEN sha % 3 = 1 THEN '' ELSE title END, '') IS NULL
UNION ALL
SELECT 'crawl' AS kind, i AS id, '{SITE}book/show/' || CAST(i AS VARCHAR) AS url
FROM range(1, (SELECT max(sha) + 1 FROM bookparts)) t(i)""")
def work_lists(spark, root):
    # Titles go missing here as they do in a crawl: a third NULL, a third empty.
    third = F.col("sha") % 3
    books = st.bookdocs(spark, root).withColumn(
        "title", F.when(third == 0, F.lit(None)).when(third == 1, F.lit("")).otherwise(F.col("title")))
    repair = sm.repair_list(books, "src3", SITE + "book/show/").select(
        F.lit("repair").alias("kind"), F.col("book_id").alias("id"), "url")
    top = st.bookparts(spark, root).agg(F.max("sha").alias("m")).first()["m"]
    crawl = sm.crawl_list(spark, 1, int(top) + 1, SITE + "book/show/%d").select(
        F.lit("crawl").alias("kind"), "id", "url")
    return repair.unionByName(crawl)


@register("websom_histograms")
def websom_histograms(spark, root):
    # Cut into words once; read for the vocabulary, the bigrams, the documents and their words.
    path = scratch_path(spark, "tokens")
    _training_tokens(spark, root).select("sha", "tokens").write.parquet(path)
    toks = spark.read.parquet(path)
    stats = txo.vocabulary(toks, "sha", "tokens", min_df=wo.WORD_MIN_DF)
    _, cells = wo.word_category_map(stats, reliable_checkpoint(_bigram_totals(toks)), epochs=map_epochs(spark))
    docs = toks.select(F.col("sha").alias("doc"))
    return wo.document_histograms(docs, txo.token_rows(toks, "sha", "tokens"), cells).select(F.col("doc").alias("sha"), "h")


# --- operators over derived tables ----------------------------------------------------

from shelfmap.functions.predicates import array_has_all, conditional_match, in_list, relative_cutoff_col, url_filters  # noqa: E402
from shelfmap.session import scratch_path  # noqa: E402

FRONT = ("title", "author", "release_date", "language", "produced_by")


@register("front_matter_fields", """
SELECT doc_id AS sha, 'Second ' || source AS fm_title, source AS fm_author,
       CASE WHEN doc_id % 2 = 0 THEN 'May ' || CAST(doc_id AS VARCHAR) END AS fm_release_date, lang AS fm_language,
       NULL::VARCHAR AS fm_produced_by FROM documents""")
def front_matter_fields(spark, root):
    """The last label wins, a repeated label cuts the value, tabs and blanks go."""
    d = read_table(spark, root, "documents")
    day = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Release Date: May "), F.col("doc_id").cast("string")))
    text = F.concat(F.lit("Title: First\nAuthor:\t"), F.col("source"), F.lit("\t\nTitle:  Second "), F.col("source"),
                    F.lit(" Title: again\n"), F.coalesce(day, F.lit("Release Date:  ")), F.lit("\nLanguage: "),
                    F.col("lang"), F.lit("\n\nBody Language"))
    out = ex.front_matter(d.select(F.col("doc_id").alias("sha"), text.alias("text")))
    return out.select("sha", *[f"fm_{f}" for f in FRONT])


@register("search_items", """
SELECT 'd' || CAST(doc_id AS VARCHAR) || s AS identifier, 'https://archive.org/metadata/d' || CAST(doc_id AS VARCHAR) || s AS url
FROM documents, (VALUES ('a'), ('b')) t(s) WHERE doc_id % 3 <> 0""")
def search_items(spark, root):
    """One row per item of a stored search page; pages without items give none."""
    key = F.col("doc_id").cast("string")
    full = F.concat(F.lit('{"items":[{"identifier":"d'), key, F.lit('a"},{"identifier":"d'), key, F.lit('b"}],"cursor":"x"}'))
    pages = read_table(spark, root, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, F.lit('{"items":[]}')).otherwise(full).alias("json"))
    return ex.search_expansion(pages)


@register("cover_rows", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, 'https://img.example.org/' || CAST(sha AS VARCHAR) AS image_url FROM bookdocs WHERE spider = 'src3' AND sha % 3 <> 0""")
def cover_rows(spark, root):
    """Images of one spider's books."""
    image = F.when(F.col("sha") % 3 != 0, F.concat(F.lit("https://img.example.org/"), F.col("sha").cast("string")))
    return sm.cover_list(st.bookdocs(spark, root).withColumn("image_url", image), "src3")


@register("filter_all_of", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, title FROM bookdocs WHERE language = 'en' AND spider = 'src3'""")
def filter_all_of(spark, root):
    """Every listed value equals the scalar field, and is in the array field."""
    books = st.bookdocs(spark, root).withColumn("genres", F.array("language", "spider"))
    return (books.where(build_predicate({"spider__all": ["src3", "src3"]}))
            .where(array_has_all(F.col("genres"), ["en", "src3"])).select("sha", "title"))


@register("relative_times", """
SELECT event_id, spec, CAST(CASE WHEN spec <> 'bad' THEN date_trunc('hour', ts - to_seconds(CASE spec WHEN '3h' THEN 10800
  WHEN '2d' THEN 172800 WHEN '1w' THEN 604800 WHEN '1m' THEN 2592000 WHEN '90M' THEN 5400 WHEN '1y' THEN 31536000 END)) END AS VARCHAR) AS cut
FROM (SELECT event_id, date_trunc('second', ts) AS ts, ['3h', '2d', '1w', '1m', '90M', '1y', 'bad'][event_id % 7 + 1] AS spec FROM events)""")
def relative_times(spark, root):
    """Relative specs against each event's time."""
    e = read_table(spark, root, "events")
    specs = F.array(*[F.lit(x) for x in ("3h", "2d", "1w", "1m", "90M", "1y", "bad")])
    spec = F.get(specs, (F.col("event_id") % 7).cast("int"))
    cut = relative_cutoff_col(F.col("spec"), F.date_trunc("second", F.col("ts")).cast("timestamp"))
    return e.withColumn("spec", spec).select("event_id", "spec", F.date_format(cut, "yyyy-MM-dd HH:mm:ss").alias("cut"))


@register("url_filter_columns", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS INTEGER) END AS square_meter_gt, doc_id / 2.0 AS roi_lt,
  CAST(make_date(CAST(nullif(doc_id % 2100, 0) AS INTEGER), 1, 1) AS VARCHAR) AS year_of_construction_gt,
  doc_id % 3 = 0 AS is_active, source AS spider FROM documents""")
def url_filter_columns(spark, root):
    """Request URLs to typed filters; bad numbers and year 0 are absent."""
    d = read_table(spark, root, "documents")
    key = F.col("doc_id").cast("string")
    url = F.concat(F.lit("https://x.example.org/s?ami="), F.when(F.col("doc_id") % 4 == 0, "x1").otherwise(key), F.lit("&roima="),
                   (F.col("doc_id") / 2).cast("string"), F.lit("&ymi="), (F.col("doc_id") % 2100).cast("string"),
                   F.lit("&is_active="), F.when(F.col("doc_id") % 3 == 0, "true").otherwise("false"), F.lit("&spider="), F.col("source"))
    out = d.select("doc_id", *url_filters(url, F.lit("2024-01-01").cast("timestamp")))
    return out.select("doc_id", "square_meter_gt", "roi_lt", F.col("year_of_construction_gt").cast("string").alias("year_of_construction_gt"),
                      "is_active", "spider")


@register("conditional_matches", """
WITH b AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, p_type AS kind,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(1990 + p_partkey % 4 AS VARCHAR) || '-05-01' END AS built FROM part)
SELECT l.id, r.id AS r_id FROM b l JOIN b r ON l.brand = r.brand AND l.size = r.size AND l.kind = r.kind
WHERE l.built IS NULL OR substr(l.built, 1, 4) = substr(r.built, 1, 4)""")
def conditional_matches(spark, root):
    """Equal keys, and equal years where the left year is known."""
    year = F.when(F.col("p_partkey") % 3 != 0, F.concat((1990 + F.col("p_partkey") % 4).cast("string"), F.lit("-05-01")))
    b = read_table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"),
                                               F.col("p_size").alias("size"), F.col("p_type").alias("kind"), year.alias("built"))
    return conditional_match(b, b, ["brand", "size", "kind"], "built").select("id", "r_id")


@register("book_details", f"""WITH {st.BOOKPARTS_SQL}
SELECT sha, title, author FROM bookparts WHERE sha IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def book_details(spark, root):
    """B2 and C10 for a long list of keys: one row per key, by semi join; C2 drops the other fields."""
    lines = read_table(spark, root, "lineitem")
    keys = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("sha"))
    books = in_list(st.bookparts(spark, root), "sha", keys)
    return serve.drop_fields(serve.book_detail(books, keys), ["ratings_count", "bmu_col", "bmu_row"])


@register("cell_books", CELLS_SQL + """
SELECT e.vec_id AS sha, e.label FROM embeddings e JOIN members m ON m.sha = e.vec_id WHERE m.bmu_col = 3 AND m.bmu_row = 2""")
def cell_books(spark, root):
    """The books of one chosen cell."""
    books = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("sha"), "label")
    return som.cell_lookup(_members(spark, root), books, 3, 2)


@register("cell_lists", CELLS_SQL + """
SELECT bmu_col, bmu_row, 0 AS bucket, list(sha ORDER BY sha) AS matched_list FROM members WHERE sha IS NOT NULL GROUP BY 1, 2""")
def cell_lists(spark, root):
    """E-7: members as one array per cell and bucket."""
    return som.cell_member_lists(_members(spark, root))


@register("bag_of_frequent_words", f"""WITH {st.TRAINING_SQL}{TOKENS_CTE},
bag AS (SELECT sha, term, count(*) AS n FROM (SELECT sha, unnest(tokens) AS term FROM toks) GROUP BY sha, term),
vocab AS (SELECT term FROM bag GROUP BY term HAVING count(*) >= 25)
SELECT sha, term, n FROM bag WHERE term IN (SELECT term FROM vocab)""")
def bag_of_frequent_words(spark, root):
    """F3d: counts restricted to a given vocabulary, unknown terms ignored."""
    toks = _training_tokens(spark, root)
    vocab = txo.doc_freq(toks, "sha", "tokens", min_df=25)
    return txo.bag_of_words(toks, "sha", "tokens", vocab).select(F.col("doc").alias("sha"), "term", "n")


@register("stored_upserts", ORACLES["upsert_latest"])
def stored_upserts(spark, root):
    """A stored table, written in two batches, one replayed, and read back."""
    root_, ev, cut = scratch_path(spark, "events"), _partial_events(spark, root), F.lit(CUT).cast("timestamp_ntz")
    early, late = ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)
    for batch_id, rows in ((0, early), (1, late), (1, late)):
        up.write_batch(rows, root_, batch_id, "user_id", ["ts", "event_id"])
    return up.read_batches(spark, root_, ev.schema, "user_id").select(
        "user_id", "sha", "event_type", "value", "props", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("stream_upserts", ORACLES["upsert_latest"])
def stream_upserts(spark, root):
    """H4: the events streamed into keyed state, one current record per user."""
    path, out = f"{root.rstrip('/')}/[e]vents.parquet", scratch_path(spark, "records")
    stream = sp.staged_stream(spark, path, read_table(spark, root, "events").schema)
    items = _as_partial(stream).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    sp.run_keyed_ingest(items, out, "user_id", ["at", "event_id"], scratch_path(spark, "records-ckpt"))
    return sp.current_records(spark, out, "user_id").select(
        "user_id", "sha", "event_type", "value", "props",
        F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("stream_cell_sets", CELLS_SQL + """
SELECT bmu_col, bmu_row, sha FROM members WHERE sha IS NOT NULL AND (bmu_col + bmu_row) % 2 = 0""")
def stream_cell_sets(spark, root):
    """H3: streamed placements added to the member sets of the cells that exist (here every other one)."""
    path = f"{root.rstrip('/')}/[e]mbeddings.parquet"
    cb = st.codebook(spark, root)
    cells = som.grid(spark, st.GRID_ROWS, st.GRID_COLS).where((F.col("bmu_col") + F.col("bmu_row")) % 2 == 0)

    def place(batch):
        vecs = batch.select(F.col("vec_id").alias("sha"), F.col("embedding").cast("array<double>").alias("x"))
        return som.assign_bmu(vecs, cb, "sha", "x")

    log = scratch_path(spark, "members")
    books = scratch_path(spark, "placed")
    sp.run_placement_updates(sp.staged_stream(spark, path, read_table(spark, root, "embeddings").schema), place, books, log,
                             scratch_path(spark, "placed-ckpt"), cells=cells)
    return sp.cell_sets(spark, log)


# --- pages to stored books (A8-A14 into A16) -----------------------------------------------

from shelfmap.schema import STAGING_SCHEMA  # noqa: E402
from shelfmap.sources import records as rec  # noqa: E402

SHOP_URL = "https://shop.example/"


def _site_pages(spark, root):
    """Documents as responses of three sites: pages with JSON, catalogue tables, metadata JSON; every field is filled."""
    d = dealt(read_table(spark, root, "documents")).withColumn("k", F.col("doc_id").cast("string"))
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    mark = F.md5(F.coalesce("text", F.lit("")))
    shops = F.array(*[F.struct(F.lit("Link").alias("__typename"), F.lit(name).alias("name"),
                               F.when((F.col("doc_id") + i) % 5 != 0, text(f"{SHOP_URL}{i}/", F.col("k"))).otherwise("").alias("url"))
                      for i, name in enumerate(SHOPS)])
    primary = F.struct(F.when(F.col("doc_id") % 2 == 0, "KindleLink").otherwise("AmazonLink").alias("__typename"),
                       F.lit("Amazon").alias("name"), text(SHOP_URL, "primary/", F.col("k")).alias("url"))
    genre = lambda c: F.struct(F.struct(text("/genres/", F.col(c)).alias("webUrl"), F.col(c).alias("name")).alias("genre"))
    book = F.struct(
        F.when(F.col("doc_id") % 4 != 0, text("Tale ", F.col("source"))).otherwise("").alias("title"), text("About ", mark).alias("description"),
        text("https://img.example/", F.col("k")).alias("imageUrl"),
        F.array(F.struct((F.col("doc_id") % 4).cast("string").alias("userPosition"))).alias("bookSeries"),
        F.array(genre("lang"), genre("source")).alias("bookGenres"),
        F.struct(F.col("n_chars").alias("numPages"), text("House ", F.col("source")).alias("publisher"),
                 F.struct(F.col("lang").alias("name")).alias("language"), F.lit("Paperback").alias("format")).alias("details"),
        F.struct(F.struct(text("Contributor:kca://author/", F.col("k")).alias("__ref")).alias("node")).alias("primaryContributorEdge"),
        F.struct(primary.alias("primaryAffiliateLink"), shops.alias("secondaryAffiliateLinks")).alias("links({})"))
    work = F.struct(
        F.struct(((F.col("doc_id") + 1) * 86400000).alias("publicationTime"), text("Original ", F.col("k")).alias("originalTitle"),
                 text("https://x.example/work/", F.col("k")).alias("webUrl")).alias("details"),
        F.struct(((F.col("doc_id") % 50) / 10).alias("averageRating"), F.col("n_chars").alias("ratingsCount"),
                 F.array(*[F.col("doc_id") % (i + 2) for i in range(5)]).alias("ratingsCountDist"),
                 (F.col("doc_id") % 7).alias("textReviewsCount")).alias("stats"))
    author = F.struct(text("Name ", F.col("source")).alias("name"), text("Life ", mark).alias("description"),
                      text("https://x.example/author/", F.col("k")).alias("webUrl"), text("https://img.example/a/", F.col("k")).alias("profileImageUrl"),
                      F.struct((F.col("doc_id") % 11).alias("totalCount")).alias("followers"), (F.col("doc_id") % 2 == 0).alias("isGrAuthor"))
    js = text('{"props":{"pageProps":{"apolloState":{"Work:kca://work/', F.col("k"), '":', F.to_json(work), ',"Book:kca://book/', F.col("k"),
              '":', F.to_json(book), ',"Contributor:kca://author/', F.col("k"), '":', F.to_json(author), "}}}}")
    json_pages = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), text("https://x.example/book/show/", F.col("k")).alias("url"),
                                                  text('<script id="__NEXT_DATA__" type="application/json">', js, "</script>").alias("html"))
    day = F.date_format(F.date_add(F.lit("1999-01-05").cast("date"), (F.col("doc_id") % 300).cast("int")), "MMM d, yyyy")
    cells = [("Author", text('<a href="/ebooks/author/', F.col("k"), '">', F.col("source"), " &amp; Co</a>")),
             ("Title", text("Tom &amp; ", mark)), ("Summary", text("&eacute; ", F.col("lang"))), ("Credits", text("Team ", F.col("lang"))),
             ("Language", F.col("lang")), ("Editor", text("Ed ", F.col("source"))), ("Release Date", day)]
    table = text('<table class="bibrec">', *[text(f"<tr><th>{h}</th><td>", v, "</td></tr>") for h, v in cells], "</table>")
    table_pages = d.where("doc_id % 3 = 1").select(F.col("doc_id").alias("page_id"), text("https://x.example/ebooks/", F.col("k")).alias("url"), table.alias("html"))
    one, two = F.to_json(F.struct(text("By ", F.col("source")).alias("creator"))), F.to_json(F.struct(F.array(F.lit("By"), F.col("source")).alias("creator")))
    md = F.struct(F.col("k").alias("identifier"), text("Item ", mark).alias("title"), text("About ", F.col("source")).alias("description"),
                  text("Topic ", F.col("lang")).alias("subject"), F.col("lang").alias("language"), F.lpad("k", 10, "0").alias("isbn"),
                  text("House ", F.col("source")).alias("publisher"), F.when(F.col("doc_id") % 2 == 0, "1884").otherwise("May 1907").alias("date"))
    creator = F.regexp_extract(F.when(F.col("doc_id") % 2 == 0, one).otherwise(two), r"^\{(.*)\}$", 1)
    responses = d.where("doc_id % 3 = 2").select("doc_id", text('{"metadata":', F.regexp_replace(F.to_json(md), r"\}$", ""), ",", creator, "}}").alias("json"))
    return json_pages, table_pages, responses


def _site_sql():
    mark = "md5(coalesce(text, ''))"
    site = lambda a, b, c: f"CASE doc_id % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
    json_only = lambda a: f"CASE WHEN doc_id % 3 = 0 THEN {a} END"
    count = lambda e: json_only(f"nullif({e}, 0)")
    shop = lambda i: f"CASE WHEN (doc_id + {i}) % 5 <> 0 THEN '{SHOP_URL}{i}/' || k END"
    fields = {
        "book_id": site("'gr_' || k", "'gb_' || k", "k"),
        "title": site("CASE WHEN doc_id % 4 <> 0 THEN 'Tale ' || source ELSE 'Original ' || k END", f"'Tom & ' || {mark}", f"'Item ' || {mark}"),
        "author": site("'Name ' || source", "source || ' & Co'", "'By ' || source"),
        "author_url": site("'https://x.example/author/' || k", "'https://gutenberg.org/ebooks/author/' || k", "NULL"),
        "author_image_url": json_only("'https://img.example/a/' || k"), "author_description": json_only(f"'Life ' || {mark}"),
        "author_follower_count": count("doc_id % 11"), "is_gr_author": json_only("nullif(doc_id % 2 = 0, false)"),
        "editor": site("'House ' || source", "'Ed ' || source", "'House ' || source"),
        "credits": "CASE WHEN doc_id % 3 = 1 THEN 'Team ' || lang END", "language": "lang",
        "summary": site(f"'About ' || {mark}", "'é ' || lang", "'About ' || source"), "image_url": json_only("'https://img.example/' || k"),
        "genres": json_only("'/genres/' || lang || ',/genres/' || source"), "num_pages": count("n_chars"), "format": json_only("'Paperback'"),
        "isbn_10": "CASE WHEN doc_id % 3 = 2 THEN lpad(k, 10, '0') END",
        "release": site("strftime(DATE '1970-01-01' + CAST(doc_id + 1 AS INTEGER), '%Y-%m-%d')",
                        "strftime(DATE '1999-01-05' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d')",
                        "CASE WHEN doc_id % 2 = 0 THEN '1884-01-01' ELSE '1907-01-01' END"),
        "subject": "CASE WHEN doc_id % 3 = 2 THEN 'Topic ' || lang END", "web_url": json_only("'https://x.example/work/' || k"),
        "series_position": json_only("CAST(doc_id % 4 AS VARCHAR)"), "is_series": json_only("true"),
        "average_rating": json_only("nullif((doc_id % 50) / 10, 0)"), "ratings_count": count("n_chars"),
        **{f"rating_{n}_count": count(f"doc_id % {i + 2}") for i, n in enumerate(("one", "two", "three", "four", "five"))},
        "text_reviews_count": count("doc_id % 7"),
        "kindle_link": json_only(f"CASE WHEN doc_id % 2 = 0 THEN '{SHOP_URL}primary/' || k END"),
        "amazon_link": json_only(f"coalesce(CASE WHEN doc_id % 2 <> 0 THEN '{SHOP_URL}primary/' || k END, {shop(0)})"),
        **{column: json_only(shop(i)) for i, column in enumerate(SHOP_NAMES.values()) if column != "amazon_link"},
        "url": site("'https://www.goodreads.com/book/show/' || k", "'https://www.gutenberg.org/ebooks/' || k", "'http://archive.org/details/' || k"),
        "sha": "md5(" + site("'gr_' || k", "'gb_' || k", "k") + ")", "project": "'books'",
        "spider": site("'goodreads'", "'gutenberg'", "'archive'"), "server": "CASE WHEN doc_id % 5 < 4 THEN 'host2' ELSE 'host1' END",
        "date": "CASE WHEN doc_id % 5 < 4 THEN '2024-01-02' ELSE '2024-01-01' END",
    }
    return ",\n       ".join(f"{e} AS {c}" for c, e in fields.items()), list(fields)


SITE_SQL, SITE_FIELDS = _site_sql()


@register("stored_books", f"SELECT {SITE_SQL}\nFROM (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents)")
def stored_books(spark, root):
    """Three sites' responses to typed records, stored, and most of them met again a day later."""
    pages = _site_pages(spark, root)

    def crawl(server, day, met):
        at = F.lit(day).cast("timestamp")
        extract = (rec.json_page_records, rec.table_page_records, rec.metadata_records)
        return rec.all_records(*(f(p.where(met % key), "books", server, at)
                                 for f, p, key in zip(extract, pages, ("page_id", "page_id", "doc_id"))))

    stored = rec.store_books(spark.createDataFrame([], STAGING_SCHEMA), crawl("host1", "2024-01-01", "%s IS NOT NULL"))
    out = rec.store_books(stored, crawl("host2", "2024-01-02", "%s %% 5 < 4"))
    shown = {"genres": F.array_join("genres", ","), "release": F.date_format("release", "yyyy-MM-dd"), "date": F.date_format("date", "yyyy-MM-dd")}
    return out.select(*(shown[c].alias(c) if c in shown else c for c in SITE_FIELDS))


# --- positional index, cell-clustered books, files --------------------------------------------

from shelfmap.operators import phrases as ph  # noqa: E402
from shelfmap.sources import clustered, corpus, files as fl  # noqa: E402


def _title_index(spark, books):
    """Titles indexed in two batches; in the first, every third title still has another wording."""
    root = scratch_path(spark, "titles")
    early = books.withColumn("title", F.when(F.col("sha") % 3 == 0, F.concat(F.lit("Red widget, "), "title")).otherwise(F.col("title")))
    ph.index_batch(early.where("sha % 4 <> 0"), root, 0)
    ph.index_batch(books.where("sha % 3 = 0 OR sha % 4 = 0"), root, 1)
    return root


@register("indexed_phrase", ORACLES["filter_phrase"])
def indexed_phrase(spark, root):
    """B4 by a positional index kept current over two batches."""
    books = st.bookparts(spark, root)
    return ph.indexed_search(books, _title_index(spark, books), "Red  Widget").select("sha", "title")


@register("indexed_title_search", ORACLES["title_search_top50"])
def indexed_title_search(spark, root):
    """C9 by the index."""
    books = st.bookparts(spark, root)
    found = ph.indexed_search(books, _title_index(spark, books), "widget")
    return found.orderBy(*serve.order_columns("-ratings_count")).limit(serve.capped(None)).select("sha", "title", "author", "ratings_count")


@register("summary_search", f"""WITH {st.BOOKDOCS_SQL}
SELECT sha, length(summary) AS n FROM bookdocs
WHERE summary IS NOT NULL AND contains(' ' || {_norm_sql('summary')} || ' ', ' of the ')""")
def summary_search(spark, root):
    """A phrase in the summaries, by an index over all of them."""
    books, index = st.bookdocs(spark, root), scratch_path(spark, "summaries")
    ph.index_batch(books, index, 0, text_col="summary")
    lengths = books.select("sha", F.length("summary").cast("long").alias("n"))     # the join exchanges no text
    return ph.indexed_search(lengths, index, "of the")


@register("similar_books_clustered", ORACLES["similar_books_same_cell"])
def similar_books_clustered(spark, root):
    """D1 over books laid out by cell: no book is exchanged."""
    return serve.similar_books(clustered.write_by_cell(st.bookparts(spark, root), scratch_path(spark, "by-cell")))


@register("sitemap_written", SITEMAP_SQL + f""",
maps AS (
  SELECT 'sitemap_books_' || CAST(file_num AS VARCHAR) || '.xml' AS name,
    '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="{sm.XMLNS}">' || chr(10)
    || string_agg('  <url>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    <lastmod>{LASTMOD}</lastmod>'
       || chr(10) || '    <priority>' || priority || '</priority>' || chr(10) || '  </url>' || chr(10), '' ORDER BY pos)
    || '</urlset>' || chr(10) AS text
  FROM entries GROUP BY file_num)
SELECT name, text, octet_length(encode(text))::BIGINT AS bytes FROM maps
UNION ALL
SELECT 'sitemap_1.xml' AS name, text, octet_length(encode(text))::BIGINT AS bytes FROM (
  SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<sitemapindex xmlns="{sm.XMLNS}">' || chr(10)
    || string_agg('  <sitemap>' || chr(10) || '    <loc>{SITE}sitemap_books_' || CAST(file_num AS VARCHAR) || '.xml</loc>' || chr(10)
       || '    <lastmod>{LASTMOD}</lastmod>' || chr(10) || '  </sitemap>' || chr(10), '' ORDER BY file_num)
    || '</sitemapindex>' || chr(10) AS text
  FROM (SELECT DISTINCT file_num FROM entries))""")
def sitemap_written(spark, root):
    """Sitemap files and their index written as named files and read back."""
    out = scratch_path(spark, "sitemaps")
    index = sm.sitemap_index(st.bookparts(spark, root), STATIC, SITE, LASTMOD, SITEMAP_CHUNK)
    manifest = sm.write_sitemaps(_entries(spark, root), index, out)
    return fl.read_files(spark, out, "*.xml").join(manifest, "name").select("name", "text", "bytes")


@register("corpus_round_trip", f"""WITH {st.BOOKDOCS_SQL}
SELECT CASE WHEN sha % 2 = 0 THEN 'gb_' ELSE '' END || 'Bök ' || CAST(sha AS VARCHAR) || '+' || language AS book_id, '' AS title,
       {sq.clean_sql("coalesce(summary, '')")} AS summary
FROM bookdocs""")
def corpus_round_trip(spark, root):
    """A1-A3, F1: documents written as text files with odd names, scanned recursively, cleaned, keyed by their names."""
    out, b = scratch_path(spark, "corpus"), st.bookdocs(spark, root)
    folder = F.when(F.col("sha") % 2 == 0, "gutenberg_books").otherwise("other books")
    name = F.concat(folder, F.lit("/"), (F.col("sha") % 16).cast("string"), F.lit("/Bök "), F.col("sha").cast("string"), F.lit("+"), F.col("language"), F.lit(".txt"))
    fl.write_files(b.select(name.alias("name"), F.col("summary").alias("text")), out)
    return corpus.corpus_books(corpus.sample_corpus(corpus.read_corpus(spark, out)))

