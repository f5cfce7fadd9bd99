"""Text column functions (F1-F3c) as built-in Spark expressions."""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII characters Python's str.isspace() accepts; Java's
# and RE2's \s miss some of them, so the class is spelled out.
PY_SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f "
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"          # same matches as Python's (?u)\b\w\w+\b
# Everything Python's str.strip() removes.
STRIP_SPACE = PY_SPACE + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ALPHA_TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"     # Python \w without decimal digits


@functools.lru_cache(maxsize=None)
def stop_words() -> tuple[str, ...]:
    """The shipped English stop list (package data, 318 words)."""
    text = resources.files("shelfmap").joinpath("data/stopwords_en.txt").read_text("utf-8")
    return tuple(w.strip() for w in text.splitlines() if w.strip() and not w.startswith("#"))


def clean_text(col: Column) -> Column:
    """the reference's text clean-up, step for step."""
    out = F.regexp_replace(col, r"[^\x00-\x7F]+", " ")
    out = F.regexp_replace(out, r"[,:.{\[}'\"\]]", "")
    out = F.regexp_replace(out, r"[0-9]+", "")
    out = F.regexp_replace(out, "_", "")
    out = F.lower(out)
    out = F.regexp_replace(out, rf"[^{PY_SPACE}]+@[^{PY_SPACE}]+", "")
    out = F.regexp_replace(out, rf"http[^{PY_SPACE}]+|www[^{PY_SPACE}]+", "")
    return F.regexp_replace(out, rf"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def doc_text(title: Column | str = "title", summary: Column | str = "summary") -> Column:
    """``title + ' ' + summary`` with missing parts as empty strings."""
    t = F.col(title) if isinstance(title, str) else title
    s = F.col(summary) if isinstance(summary, str) else summary
    return F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(s, F.lit("")))


def word_tokens(col: Column) -> Column:
    """lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_TOKEN), 0)


def alpha_tokens(col: Column, min_len: int = 2, max_len: int = 15) -> Column:
    """Lower-cased alphabetic runs of ``min_len..max_len``, not starting with ``_``."""
    toks = F.regexp_extract_all(F.lower(col), F.lit(ALPHA_TOKEN), 0)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & ~t.startswith("_"))


def strip(col: Column | str) -> Column:
    """White space cut off both ends, as Python's ``str.strip`` does."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, rf"^[{STRIP_SPACE}]+|[{STRIP_SPACE}]+$", "")


def strip_ws(col: Column) -> Column:
    """S3: drop newlines and tabs, then strip surrounding whitespace."""
    return F.regexp_replace(F.translate(col, "\n\t", ""), rf"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")
