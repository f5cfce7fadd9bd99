"""Token operators against the libraries: records, chat, prefix counts, pieces."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfmap.llm import chat, pieces, queries, records, token_prefix

ODD = ["", "a", " a", "a ", "  a  b \n\n c\t\td\n", "x<|endoftext|>y <|endoftext|> z", "<|startoftext|>abc<|endoftext|>!!<|endoftext|",
       "it's 'RE 'll we're'r 're!!'re", "a" * 400, " \n \n", "日本語テキスト 한국어 🎉🎉", "\x85a\x85 b \xa0c\x1cd", "ΣΑΣ İstanbul ﬁ Å ééx",
       "½²³ ١٢٣ a1b2", "▁▁x ▁", "<s></s><unk>\x00z", "    indent\n        more", "á̧b Á"]
SCHEMA = "doc_id long, text string, n_tokens string, ids string"
BYTES, WORDS, MODEL = (public_tokenizers.path(f) for f in (records.TOKENIZER, token_prefix.TOKENIZER, pieces.MODEL))


def frame(spark, texts=ODD):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (900, None, "x", "y"), (None, "null id", "x", "y"), (3, "again", "x", "y"),
                                  (3, "again", "x", "y")], SCHEMA)


def ids_of(t):
    return Tokenizer.from_file(BYTES).encode(t or "", add_special_tokens=False).ids


def test_record_files(spark, tmp_path):
    root = f"file://{tmp_path}/records"
    df = frame(spark)
    manifest = records.write_records(df, root, BYTES)
    got = [tuple(r) for r in records.read_records(spark, manifest).select("doc_id", "start", "n_tokens", "ids").collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    want = sorted((r.doc_id or -1, [*ids_of(r.text), 0]) for r in df.collect())
    assert sorted((r[0] or -1, np.frombuffer(r[3], "<u4").tolist()) for r in got) == want
    part = manifest.collect()[0]
    every = records.read_at(part.path, list(range(part.records)))
    order = random.Random(1).sample(range(part.records), part.records)
    for n, (ident, ids) in zip(order, records.read_at(part.path, order)):
        assert ident == every[n][0] and ids.tolist() == every[n][1].tolist()
    assert records.token_records(df.limit(0), BYTES).count() == 0


def test_damaged_record():
    import io
    good = records.frame(b"payload")
    assert list(records.unframe(io.BytesIO(good + good))) == [b"payload"] * 2
    for bad in (good[:-1], good[:5], b"\x01" + good[1:], good[:14] + b"X" + good[15:]):
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bad)))


def test_op1_query(spark):
    got = {r.doc_id: r for r in queries.op1_token_records(spark, SF_SMALL).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(40).collect():
        ids = np.array([*ids_of(r.text), 0], dtype="<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


pieces_of_text = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "INST]", "|turn|>", "a", " ", "<\\s>", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces_of_text)
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


def test_chat(spark):
    texts = [*chat.CONTROLS, "hi <|turn|> [INST]", "", "émoji 🎉 \n x", "word " * 3000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, None), (2, 0, "tool", "</s>"), (2, 0, "tool", "</s>"), (None, 0, "assistant", "null id"), (3, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", chat.F.lit("x"))
    got = {r.conv_id: r for r in chat.formatted_conversations(df, BYTES).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        marks = sum(map(len, chat.MARKS))
        assert got[conv].formatted_chars == sum(marks + len(chat.escape(r)) + len(chat.escape(t)) for _, r, t in turns)
    assert chat.formatted_conversations(df.limit(0), BYTES).count() == 0


def test_prefix_counts_equal_the_library():
    lib, count = Tokenizer.from_file(WORDS), token_prefix.PrefixCounter(WORDS)
    for text, steps in zip(ODD, count.steps(ODD)):
        sums = steps.cumsum(dtype=np.int64)
        assert len(sums) == len(text)
        for k in range(1, len(text) + 1):
            assert sums[k - 1] == len(lib.encode(text[:k], add_special_tokens=False).ids), (text, k)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthe'sr é̂ΣÅ9!<|\n\xa0", max_size=24))
def test_prefix_counts_on_random_texts(text):
    lib, count = Tokenizer.from_file(WORDS), token_prefix.counter(WORDS)
    sums = count.steps([text])[0].cumsum(dtype=np.int64)
    for k in range(1, len(text) + 1):
        assert sums[k - 1] == len(lib.encode(text[:k], add_special_tokens=False).ids)


def test_token_counts_frame(spark):
    lib = Tokenizer.from_file(WORDS)
    df = frame(spark)
    got = token_prefix.token_counts(df, WORDS).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
        for budget in (0, 1, 3):
            n = token_prefix.longest_within(r.prefix_steps, r.step_width, budget)
            fits = [k for k in range(len(r.text or "") + 1) if token_prefix.count_at(r.prefix_steps, r.step_width, k) <= budget]
            assert n == (fits[-1] if fits else 0)
        cuts = token_prefix.windows(r.prefix_steps, r.step_width, 4)
        assert "".join((r.text or "")[a:b] for a, b in cuts) == (r.text or "")
    assert token_prefix.token_counts(df.limit(0), WORDS).count() == 0
    ours = {r.doc_id: r for r in queries.op10_token_prefix(spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect():
        n = len(lib.encode(r.text, add_special_tokens=False).ids)
        assert (ours[r.doc_id].n_tokens, ours[r.doc_id].n_bytes, ours[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 2048)


@pytest.mark.parametrize("chunk", [17, 50, 1 << 15])
def test_pieces_equal_the_library(spark, chunk, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)            # several levels of the scan
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, "no spaces " * 20 + "日本語テキスト" * 20, "x" * 700]
    df = frame(spark, texts)
    got = pieces.encode_pieces(df, MODEL, chunk=chunk).collect()
    assert len(got) == df.count() and got[0].__fields__[:3] == ["doc_id", "text", "n_tokens"]
    for r in got:
        ids = lib.encode(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_pieces == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode_pieces(df.limit(0), MODEL, chunk=chunk).count() == 0


def test_a_task_of_pieces_keeps_one_python_worker(spark):
    """No two Python steps share a stage, so a task never keeps two workers with a coder each."""
    df = frame(spark, ["short", "long " * 20]).withColumn("k", F.lit(7))
    coded = pieces.encode_pieces(df, MODEL, chunk=50)
    assert [r.k for r in coded.collect()] == [7] * df.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pieces.encode_pieces(df, MODEL, chunk=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above, seen = [], 0                               # depth and kind of the nodes over a line of the plan
    for line in plan.splitlines():
        at = re.search(r"[A-Za-z]", line).start()
        above = [x for x in above if x[0] < at]
        since = [kind for _, kind in above]
        since = since[max([i + 1 for i, kind in enumerate(since) if kind == "exchange"], default=0):]
        kind = "exchange" if "Exchange" in line[:at + 20] else "python" if re.search("Python|InPandas", line[:at + 25]) else "other"
        assert kind != "python" or "python" not in since, plan
        seen += kind == "python"
        above.append((at, kind))
    assert seen >= 3


def test_chunk_interior_is_encoded_once(monkeypatch):
    """The matrix and the trace of a chunk share the ids between its outer unit borders."""
    code, text = pieces.PieceCoder(MODEL), pieces.PieceCoder.normal("one  two\n\nthree four five " * 6)
    for lo, hi in ((0, 20), (7, 61), (30, len(text)), (3, 5)):
        starts = [m.start() for m in pieces._UNITS.finditer(text, lo, hi) if m.start() > lo]
        assert code._borders(text, lo, hi) == ((starts[0], starts[-1]) if starts else None)
    lo, hi = 30, len(text)
    inner, whole = code.inner(text, lo, hi), code.matrix(text, lo, hi, False, True)
    traces = {s: code.trace(text, lo, hi, *s, True) for s in whole}
    monkeypatch.setattr(code, "encode_normal", None)
    assert code.matrix(text, lo, hi, False, True, inner) == whole
    assert {s: code.trace(text, lo, hi, *s, True, inner) for s in whole} == traces


def test_max_plus_product_is_associative():
    rng = random.Random(3)
    def matrix(n, m):
        return {((f"s{i}", 0), (f"s{j}", 0)): -rng.randrange(9) for i in range(n) for j in range(m) if rng.random() < 0.6}
    for _ in range(50):
        a, b, c = matrix(3, 4), matrix(4, 3), matrix(3, 2)
        assert pieces.multiply(pieces.multiply(a, b), c) == pieces.multiply(a, pieces.multiply(b, c))


def test_record_units_equal_the_library():
    """Plain texts go by the tokenizer's own pieces, others by white space: both as the library has them."""
    rng, coder, library = random.Random(3), records.UnitEncoder(BYTES), Tokenizer.from_file(BYTES)
    bits = [*"ab Zéœ'\n\t.,!?<|>0159-\"sStTdDrRvVeEmMlL\x1c\x0b\x7f", "'re", "'ll", "  ", "\r\n", " '", "<|endoftext|>", "ª", "–", "\xa0"]
    texts = ["".join(rng.choice(bits[:rng.choice([20, 42, 47])]) for _ in range(rng.randrange(60))) for _ in range(4000)] + ODD
    for text, ids in zip(texts, coder.encode_all(texts)):
        assert np.frombuffer(ids, dtype=coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("make", [lambda: token_prefix.PrefixCounter(WORDS), lambda: pieces.PieceCoder(MODEL)], ids=["words", "pieces"])
def test_pairs_by_splits_equal_merging(make):
    """Undoing merges decides like merging the symbols of both tokens, for joined and for random pairs."""
    from shelfmap.llm import bpe_paths
    table = make().table
    rules, names, splits, rng = table.rules, table.names, table.splits, np.random.default_rng(1)
    before, after = rng.integers(0, len(names), (2, 4000))
    pick = rng.integers(0, len(splits.codes), 2000)
    a, b = splits.codes[pick] >> bpe_paths.SHIFT, splits.codes[pick] & ((1 << bpe_paths.SHIFT) - 1)
    known = (a < len(names)) & (b < len(names))
    before[:2000][known] = a[known]
    after[:1000][known[:1000]] = b[:1000][known[:1000]]
    open_ = np.array([not rules.closes(names[i]) for i in before])
    before, after = before[open_], after[open_]
    want = [rules.merge(rules.symbols(names[i]) + rules.symbols(names[j])) == [names[i], names[j]] for i, j in zip(before, after)]
    assert table._fit(before, after).tolist() == want and 0.1 < np.mean(want) < 0.95
