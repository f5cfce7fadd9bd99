"""DuckDB text snippets that mirror ``shelfmap.functions.text`` for oracle SQL."""

from __future__ import annotations

from shelfmap.functions import text as tx

SP = r"\t\n\x0b\x0c\r\x1c-\x1f "


def stop_list_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in tx.stop_words()) + "]"


def clean_sql(e: str) -> str:
    out = f"regexp_replace({e}, '[^\\x00-\\x7F]+', ' ', 'g')"
    out = f"regexp_replace({out}, '[,:.{{\\[}}''\"\\]]', '', 'g')"
    out = f"regexp_replace({out}, '[0-9]+', '', 'g')"
    out = f"regexp_replace({out}, '_', '', 'g')"
    out = f"lower({out})"
    out = f"regexp_replace({out}, '[^{SP}]+@[^{SP}]+', '', 'g')"
    out = f"regexp_replace({out}, 'http[^{SP}]+|www[^{SP}]+', '', 'g')"
    return f"regexp_replace({out}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def doc_text_sql(title: str = "title", summary: str = "summary") -> str:
    return f"(coalesce({title}, '') || ' ' || coalesce({summary}, ''))"


def word_tokens_sql(e: str, stop: bool = True) -> str:
    toks = f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    if not stop:
        return toks
    return f"list_filter({toks}, lambda t: NOT list_contains({stop_list_sql()}, t))"


def alpha_tokens_sql(e: str) -> str:
    toks = f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]+')"
    return (f"list_filter({toks}, lambda t: length(t) >= 2 AND length(t) <= 15 "
            f"AND NOT starts_with(t, '_'))")


def bigrams_sql(toks: str) -> str:
    return f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1])"
