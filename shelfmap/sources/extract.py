"""Record extraction from stored responses.

Pages and API responses arrive as a table of strings; each extractor is a
projection with built-in regex / JSON / VARIANT functions, so parsing runs
inside whole-stage code on the executors, one row at a time, whole texts.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmap.functions.arrays import explode_values, let
from shelfmap.functions.scalars import free_year, join_words, last_segment, parse_month_day_year, series_fields
from shelfmap.functions.text import strip, strip_ws
from shelfmap.schema import SHOP_NAMES

# Catalogue-table header word -> book field (header *contains* it).
TABLE_FIELDS = [("Author", "author"), ("Title", "title"), ("Summary", "summary"),
                ("Credits", "credits"), ("Language", "language"), ("Editor", "editor"),
                ("Release Date", "release")]

ROW_RE = r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"


def free_name(columns: list[str], wish: str) -> str:
    while wish in columns:
        wish += "_"
    return wish


def first_text(fragment: Column) -> Column:
    """Text before the first tag of an HTML fragment (``td/text()`` first node)."""
    return F.nullif(strip_ws(F.regexp_extract(fragment, r"(?s)^([^<]*)", 1)), F.lit(""))


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda row: None if row is None else [None if v is None else html.unescape(v) for v in row])


def with_unescaped(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``rows`` plus text ``fields``, character references (``&amp;``, ``&#233;``) decoded.

    The fields are computed once, as one array, and decoded in one call; only rows with a
    reference in one of them reach Python.
    """
    raw, coded, plain = (free_name(rows.columns, n) for n in ("raw", "coded", "plain"))
    bound = rows.withColumn(raw, let(F.array(*fields.values()), lambda v: v))
    coded_rows = F.when(F.exists(raw, lambda v: F.contains(v, F.lit("&"))), F.col(raw))
    decoded = bound.withColumn(coded, coded_rows).withColumn(plain, F.pandas_udf(_unescaped, "array<string>")(coded))
    text = F.coalesce(plain, raw)
    return decoded.select(*rows.columns, *(F.get(text, F.lit(i)).alias(name) for i, name in enumerate(fields)))


def unescape(col: Column) -> Column:
    """Character references decoded; only texts with one reach Python."""
    decode = F.pandas_udf(lambda s: s.map(html.unescape, na_action="ignore"), "string")
    return F.when(F.contains(col, F.lit("&")), decode(F.when(F.contains(col, F.lit("&")), col))).otherwise(col)


def table_fields(page: Column) -> Column:
    """``author, author_url, title, summary, credits, language, editor, release`` of a catalogue table, as written.

    The table and its rows are found once; each field picks its first non-empty value (A14).
    """
    table = F.regexp_extract(page, r"(?is)<table[^>]*class=\"[^\"]*bibrec[^\"]*\"[^>]*>(.*?)</table>", 1)

    def picks(rows):
        def pick(word: str, value) -> Column:
            # the head of each row is looked at first, so only rows of this field are read further
            return F.get(F.filter(F.transform(F.filter(rows, lambda r: F.contains(r["h"], F.lit(word))), lambda r: value(r["d"])),
                                  lambda v: v.isNotNull()), 0)

        anchor_text = lambda d: first_text(F.regexp_extract(d, r"(?is)<a[^>]*>(.*?)</a>", 1))
        anchor_href = lambda d: F.nullif(F.regexp_extract(d, r"(?is)<a[^>]*href=\"([^\"]*)\"", 1), F.lit(""))
        return F.struct(pick("Author", anchor_text).alias("author"), pick("Author", anchor_href).alias("author_url"),
                        *(pick(word, first_text).alias(field) for word, field in TABLE_FIELDS[1:] if field != "release"),
                        pick("Release Date", lambda d: parse_month_day_year(first_text(d))).alias("release"))

    return let(table, lambda t: let(F.arrays_zip(F.regexp_extract_all(t, F.lit(ROW_RE), 1).alias("h"),
                                                 F.regexp_extract_all(t, F.lit(ROW_RE), 2).alias("d")), picks))


def html_table_fields(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                      keep: tuple[str, ...] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """Catalogue-table rows -> typed fields, first non-empty value per field.

    Output: ``id, author, author_url, title, summary, credits, language, editor, release``,
    then the input columns named in ``keep`` and the text columns ``more``.  Character
    references are decoded.  Pages without a table give NULL fields.  Work is per page (rows of one page).
    """
    more = more or {}
    found = pages.select(id_col, *keep, table_fields(F.col(html_col)).alias("_found"), *(v.alias(f"_{k}") for k, v in more.items()))
    texts = ["author", "author_url", *(f for _, f in TABLE_FIELDS[1:] if f != "release")]
    out = with_unescaped(found, {**{f: F.col("_found")[f] for f in texts}, **{k: F.col(f"_{k}") for k in more}})
    return out.select(id_col, "author", F.concat(F.lit("https://gutenberg.org"), "author_url").alias("author_url"),
                      *texts[2:], F.col("_found.release").alias("release"), *keep,
                      *(F.nullif(strip_ws(F.col(k)), F.lit("")).alias(k) for k in more))


TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"


def page_title(html: Column) -> Column:
    """``<title>`` text of a page, decoded and whitespace-stripped."""
    return F.nullif(strip_ws(unescape(F.regexp_extract(html, TITLE_RE, 1))), F.lit(""))


def page_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<html[^>]*\slang=\"([^\"]*)\"", 1), F.lit(""))


# --- A8-A11: embedded JSON pages ----------------------------------------------------

def next_data(html: Column) -> Column:
    """Body of the ``__NEXT_DATA__`` script with every ``:kca://...`` suffix removed.

    Suffixes right after ``Contributor`` stay (they are reference targets).
    """
    body = F.regexp_extract(html, r"(?is)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1)
    return F.nullif(F.regexp_replace(body, r"(?<!Contributor):kca://[^\"]+", ""), F.lit(""))


APOLLO = T.MapType(T.StringType(), T.StringType())


def apollo_state(json_text: Column) -> Column:
    """``props.pageProps.apolloState`` as a map of key -> JSON text (last duplicate wins, T5)."""
    state = F.get_json_object(json_text, "$.props.pageProps.apolloState")
    return F.from_json(state, APOLLO)


def _entry(state: Column, key: str) -> Column:
    return F.try_element_at(state, F.lit(key))


WORK = "struct<details:struct<publicationTime:long,originalTitle:string,webUrl:string>," \
       "stats:struct<averageRating:double,ratingsCount:long,ratingsCountDist:array<long>,textReviewsCount:long>>"
LINK = "struct<__typename:string,name:string,url:string>"
BOOK = ("struct<title:string,description:string,imageUrl:string,"
        "bookSeries:array<struct<userPosition:string>>,"
        "bookGenres:array<struct<genre:struct<webUrl:string,name:string>>>,"
        "details:struct<numPages:long,publisher:string,language:struct<name:string>,format:string>,"
        "primaryContributorEdge:struct<node:struct<__ref:string>>,"
        f"`links({{}})`:struct<primaryAffiliateLink:{LINK},secondaryAffiliateLinks:array<{LINK}>>>")
AUTHOR = ("struct<name:string,description:string,webUrl:string,profileImageUrl:string,"
          "followers:struct<totalCount:long>,isGrAuthor:boolean>")


def shop_link_columns(primary: Column, secondary: Column) -> list[Column]:
    """One column per shop, first non-empty URL wins; the primary link goes to kindle or amazon."""
    def first_url(name: str) -> Column:
        hits = F.filter(secondary, lambda lk: (lk["name"] == name) & (F.coalesce(lk["url"], F.lit("")) != ""))
        return F.get(hits, 0)["url"]

    purl = F.nullif(primary["url"], F.lit(""))
    kindle = F.when(primary["__typename"] == "KindleLink", purl)
    amazon_primary = F.when((F.coalesce(primary["__typename"], F.lit("")) != "KindleLink")
                            & (primary["name"] == "Amazon"), purl)
    cols = [kindle.alias("kindle_link"),
            F.coalesce(amazon_primary, first_url("Amazon")).alias("amazon_link")]
    for name, column in SHOP_NAMES.items():
        if column != "amazon_link":
            cols.append(first_url(name).alias(column))
    return cols


def page_json_fields(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Book fields from the embedded page JSON; pages without a Work are skipped.

    The input columns named in ``keep`` come last.
    """
    state = apollo_state(next_data(F.col(html_col)))
    work = F.from_json(_entry(state, "Work"), WORK)
    book = F.from_json(_entry(state, "Book"), BOOK)
    df = pages.select(id_col, F.col("url"), work.alias("w"), book.alias("b"), state.alias("s"),
                      *(F.col(c).alias(f"kept_{c}") for c in keep)).where(
        F.col("w").isNotNull())
    author = F.from_json(F.try_element_at(F.col("s"), F.col("b.primaryContributorEdge.node.__ref")), AUTHOR)
    dist = F.col("w.stats.ratingsCountDist")
    links = F.col("b").getField("links({})")
    positive = lambda c: F.when(c > 0, c)  # noqa: E731  (falsy values are never stored)
    nonempty = lambda c: F.nullif(c, F.lit(""))
    series_position, is_series = series_fields(F.col("b.bookSeries"))
    return df.select(
        id_col,
        F.concat(F.lit("gr_"), last_segment(F.col("url"))).alias("book_id"),
        F.timestamp_millis(F.nullif(F.col("w.details.publicationTime"), F.lit(0))).alias("release"),
        F.coalesce(nonempty(F.col("b.title")), nonempty(F.col("w.details.originalTitle"))).alias("title"),
        nonempty(F.col("b.description")).alias("summary"),
        nonempty(F.col("b.imageUrl")).alias("image_url"),
        F.when(F.col("w.stats.averageRating") != 0, F.col("w.stats.averageRating")).alias("average_rating"),
        positive(F.col("w.stats.ratingsCount")).alias("ratings_count"),
        positive(F.get(dist, 0)).alias("rating_one_count"),
        positive(F.get(dist, 1)).alias("rating_two_count"),
        positive(F.get(dist, 2)).alias("rating_three_count"),
        positive(F.get(dist, 3)).alias("rating_four_count"),
        positive(F.get(dist, 4)).alias("rating_five_count"),
        positive(F.col("w.stats.textReviewsCount")).alias("text_reviews_count"),
        nonempty(F.col("w.details.webUrl")).alias("web_url"),
        series_position.alias("series_position"),
        is_series.alias("is_series"),
        F.when(F.size("b.bookGenres") > 0, F.transform(F.col("b.bookGenres"), lambda g: g["genre"]["webUrl"])).alias("genres"),
        positive(F.col("b.details.numPages")).alias("num_pages"),
        nonempty(F.col("b.details.publisher")).alias("editor"),
        nonempty(F.col("b.details.language.name")).alias("language"),
        nonempty(F.col("b.details.format")).alias("format"),
        nonempty(author["name"]).alias("author"),
        nonempty(author["description"]).alias("author_description"),
        nonempty(author["webUrl"]).alias("author_url"),
        nonempty(author["profileImageUrl"]).alias("author_image_url"),
        positive(author["followers"]["totalCount"]).alias("author_follower_count"),
        F.when(author["isGrAuthor"], True).alias("is_gr_author"),
        *shop_link_columns(links["primaryAffiliateLink"], links["secondaryAffiliateLinks"]),
        *(F.col(f"kept_{c}").alias(c) for c in keep),
    )


# --- A12: metadata JSON ---------------------------------------------------------------

def _str_or_list(v, path: str) -> Column:
    as_list = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(join_words(as_list), F.try_variant_get(v, path, "string"))


def metadata_fields(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """Identifier, title, creator, date, description, subject, language, isbn, publisher."""
    v = F.try_parse_json(F.col(json_col))
    ident = F.nullif(strip_ws(F.try_variant_get(v, "$.metadata.identifier", "string")), F.lit(""))
    txt = lambda p: F.nullif(strip_ws(_str_or_list(v, p)), F.lit(""))
    return responses.select(
        "*",
        ident.alias("book_id"),
        F.concat(F.lit("http://archive.org/details/"), ident).alias("url"),
        txt("$.metadata.title").alias("title"),
        txt("$.metadata.creator").alias("author"),
        free_year(F.try_variant_get(v, "$.metadata.date", "string")).alias("release"),
        txt("$.metadata.description").alias("summary"),
        txt("$.metadata.subject").alias("subject"),
        txt("$.metadata.language").alias("language"),
        txt("$.metadata.isbn").alias("isbn_10"),
        txt("$.metadata.publisher").alias("editor"),
    )


def housekeeping(df: DataFrame, project: str, spider: str, server: str, key: str = "book_id",
                 at: Column | None = None) -> DataFrame:
    """``sha`` (deterministic md5 of the key, deviation V13), project, spider, server, date (``at``, or now)."""
    return df.withColumns({"sha": F.md5(F.col(key).cast("string")), "project": F.lit(project),
                           "spider": F.lit(spider), "server": F.lit(server),
                           "date": F.current_timestamp() if at is None else at})


def take_first(*cols: Column) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


# --- A20-A22, A25 ----------------------------------------------------------------------

FRONT_LABELS = ["Title", "Author", "Release Date", "Language", "Produced by"]


def front_matter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``Label: value`` header lines; the last match wins, value cut at a repeat of the label."""
    out = df
    for label in FRONT_LABELS:
        name = label.lower().replace(" ", "_")
        vals = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?m)^{label}:(.*?)(?={label}:|$)"), 1)
        out = out.withColumn(f"fm_{name}", F.nullif(strip(F.try_element_at(vals, F.lit(-1))), F.lit("")))
    return out


FILES = "struct<files:array<struct<name:string,format:string>>>"


def first_file_url(json_col: Column, identifier: Column, fmt: str = "DjVuTXT") -> Column:
    """Download URL of the first file of a wanted format, NULL if none."""
    files = F.from_json(json_col, FILES)["files"]
    name = F.get(F.filter(files, lambda f: f["format"] == fmt), 0)["name"]
    return F.when(name.isNotNull(), F.concat(F.lit("https://archive.org/download/"), identifier, F.lit("/"), name))


VOLUMES = "struct<items:array<struct<volumeInfo:struct<industryIdentifiers:array<struct<type:string,identifier:string>>>>>>"


def first_isbn10(json_col: Column) -> Column:
    """First ISBN-10 over all volume items, NULL if none."""
    items = F.from_json(json_col, VOLUMES)["items"]
    ids = F.flatten(F.transform(items, lambda it: F.coalesce(it["volumeInfo"]["industryIdentifiers"],
                                                              F.array().cast("array<struct<type:string,identifier:string>>"))))
    return F.get(F.filter(ids, lambda x: x["type"] == "ISBN_10"), 0)["identifier"]


SEARCH = "struct<items:array<struct<identifier:string>>,cursor:string>"


def search_expansion(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """One metadata URL per item of a stored search-result page."""
    items = F.from_json(F.col(json_col), SEARCH)["items"]
    return (responses.select(explode_values(items, "it"))
            .select(F.col("it.identifier").alias("identifier"),
                    F.concat(F.lit("https://archive.org/metadata/"), F.col("it.identifier")).alias("url")))
