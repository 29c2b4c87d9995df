"""Text feature expressions (JVM-side, no Python UDF).

Tokens are lower-cased runs of two or more word characters, where a word
character is a Unicode letter, a Unicode number or ``_``.  ``\\w`` alone is
ASCII-only in Java regexes, so the class is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens; a null text gives an empty array."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(
        F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0),
        F.array().cast("array<string>"),
    )


def word_pairs(toks: Column) -> Column:
    """Adjacent token pairs joined by one space; [] for fewer than 2 tokens.

    ``slice`` + ``zip_with`` never indexes past the end, so a one-token text
    does not fail under ANSI mode.
    """
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams(toks: Column, max_n: int = 2) -> Column:
    """Unigrams followed by bigrams (``max_n`` is 1 or 2)."""
    if max_n == 1:
        return toks
    if max_n != 2:
        raise ValueError("only 1- and 2-grams are supported")
    return F.concat(toks, word_pairs(toks))


def terms(text: Column | str, max_n: int = 2) -> Column:
    """Unigrams + bigrams of a text in one expression.  It refers to the
    token list more than once, so prefer ``with_terms`` on a DataFrame (the
    tokens then become a column and the regex runs once per row)."""
    return ngrams(tokens(text), max_n)


def sql_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_text(text: str) -> str:
    return f"coalesce(regexp_extract_all(lower({text}), {sql_literal(TOKEN_PATTERN)}, 0), cast(array() AS array<string>))"


def terms_text(toks: str, max_n: int = 2) -> str:
    """``ngrams`` of a column of tokens as SQL text."""
    if max_n == 1:
        return toks
    n = f"greatest(size({toks}) - 1, 0)"
    pairs = f"zip_with(slice({toks}, 1, {n}), slice({toks}, 2, {n}), (a, b) -> concat(a, ' ', b))"
    return f"concat({toks}, {pairs})"


def with_terms(df: DataFrame, text: str, out: str, max_n: int = 2) -> DataFrame:
    return (df.selectExpr("*", f"{tokens_text(f'`{text}`')} AS _tokens")
            .selectExpr("*", f"{terms_text('_tokens', max_n)} AS `{out}`").drop("_tokens"))


def terms_sql_statement(text: str, out: str, max_n: int = 2) -> str:
    """The same terms as a ``SQLTransformer`` statement (for ML pipelines);
    it also leaves the token list in ``_tokens``."""
    return f"SELECT *, {terms_text('_tokens', max_n)} AS {out} FROM (SELECT *, {tokens_text(text)} AS _tokens FROM __THIS__)"


def term_counts(df: DataFrame, terms_col: Column, out: str = "term_counts") -> DataFrame:
    """``df`` plus ``out``: the distinct terms of each row with their counts,
    ``array<struct<term string, tf int>>`` ordered by term, computed inside
    the row (sort, then one entry per run of equal terms; O(n log n), no
    shuffle).

    The sorted array and the run starts are separate projections so that the
    lambdas below refer to a column, not to the expression that builds it
    (Catalyst does not share subexpressions inside lambda functions).
    """
    starts = ("filter(sequence(1, greatest(size(_tc_sorted), 1)), i -> CASE WHEN i > size(_tc_sorted) THEN false "
              "WHEN i = 1 THEN true ELSE element_at(_tc_sorted, i) != element_at(_tc_sorted, i - 1) END)")
    runs = ("transform(_tc_starts, (i, j) -> named_struct('term', element_at(_tc_sorted, i), 'tf', "
            "cast(coalesce(try_element_at(_tc_starts, j + 2), size(_tc_sorted) + 1) - i AS int)))")
    return (df.withColumn("_tc_sorted", F.sort_array(terms_col)).selectExpr("*", f"{starts} AS _tc_starts")
            .selectExpr("*", f"{runs} AS `{out}`").drop("_tc_sorted", "_tc_starts"))
