"""Exact dedup and mixing: DuckDB, brute force, nulls, ties, repeats, empty tables, clashing columns, hot groups."""

import hashlib
import re

import duckdb
import pytest

from conftest import SF_SMALL
from shelfmap.llm import exact_dedup, mixing, queries

SCHEMA = "doc_id long, text string, source string, keep_id string, size string"
ROWS = [(1, "a  b", "x", "c", "c"), (2, "a b", "x", None, None), (2, "a b", "x", None, None), (5, None, None, "k", "k"),
        (3, "", "y", "k", "k"), (None, "a\tb", "y", "k", "k"), (None, "only", None, "k", "k"), (9, " a b", "x", "k", "k")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns) and len(ours) == len(theirs) > 0
    key = [columns[0], *columns[1:]]
    a, b = (p[columns].sort_values(key).reset_index(drop=True) for p in (ours, theirs))
    for c in columns:
        assert all(x == y or abs(x - y) < 1e-6 for x, y in zip(a[c], b[c])), c


@pytest.mark.parametrize("share", [512, 3])       # with 3, the largest group is a hot one
def test_exact_groups(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = rows_of(exact_dedup.exact_groups(df).select("doc_id", "text", "size", "keep_id", "group_size", "kept", "text_sha256"))
    groups = {}
    for r in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    seen, want = set(), []
    for r in ROWS:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        ids = [i for i in groups[norm] if i is not None]
        keep = min(ids) if ids else None
        kept = r[0] == keep and norm not in seen
        if kept:
            seen.add(norm)
        want.append((r[0], r[1], r[4], keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[5] for r in got) == len(groups) == exact_dedup.drop_copies(df).count()
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_very_long_text_and_many_copies(spark):
    long = "word " * 300_000
    df = spark.createDataFrame([(i, long if i % 2 else f"t{i}") for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got[1] == (1, 4, True) and got[7] == (1, 4, False) and got[4] == (4, 1, True)


def fill(sizes):
    """Targets by sharing, closing and sharing again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, closed = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in closed]
        rest = total - sum(3 * sizes[s] for s in closed)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in closed else level * weight[s] for s in order}
        closed |= over


def test_mix(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None, "c", "é"][i % 5] if i > 60 else "a", "x", "y") for i in range(300)]
    rows += [(None, "w w", "b", "x", "y"), (7, "w", "b", "x", "y"), (7, "w", "b", "x", "y"), (400, None, "zero", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and got[0].__fields__[:4] == ["doc_id", "text", "source", "keep_id"]
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    targets, taken = fill(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert r["size"] == len((r.text or "").split()) and r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 6 for s in targets)         # one document's size at most
    again = {(r.doc_id, r.text, r.source): r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text, r.source] == r.taken for r in got)
    assert mixing.mixed_documents(df).count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_salted_join_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = rows_of(mixing.mix(df).select("doc_id", "taken"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mix(df).select("doc_id", "taken")) == want
