"""Inference (I1-I6): a linear one-vs-rest text model applied relationally.

A model is a bounded table ``(term, idf, w_0 .. w_{K-1})`` (at most
``MAX_TERMS`` rows) plus K intercepts.  Scoring a record:

    x_t  = tf_t * idf_t / || tf * idf ||_2      (in-vocabulary terms only)
    m_k  = b_k + sum_t w_kt * x_t               (I1)
    p_k  = sigmoid(m_k) / sum_j sigmoid(m_j)    (I3, not softmax)
    category = argmax_k m_k, ties to the first class (I2)
    confidence = p_category                      (I4)

Any size of the table: a record's terms are counted in the row (for a table of
more than ``WIDE_TERMS`` only those that can be in it, by an Arrow function),
become a sparse vector of term numbers and values there, and the dot products
run over that vector and constant arrays of weights (``functions/vectors.py``).
No join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.constants import REVIEW_THRESHOLD, UNKNOWN_VERSION
from logsift.functions.text import sql_literal, term_counts, with_terms
from logsift.functions.vectors import MAX_TERMS, Vocabulary, norm
from logsift.operators.features import buckets_of_terms, counted_among

# Terms above which only a record's terms that can be in the model are counted:
# such models read whole documents.
WIDE_TERMS = 1000


@dataclass
class TextModel:
    classes: list[str]
    terms: DataFrame          # term string, idf double, w_0 .. w_{K-1} double
    intercepts: list[float]
    n_terms: int
    version: str = UNKNOWN_VERSION
    ngram_max: int = 2
    extra: dict = field(default_factory=dict)

    def vocabulary(self) -> Vocabulary:
        """The term table as a constant; read once, at most ``MAX_TERMS`` rows."""
        if "vocabulary" not in self.extra:
            columns = list(zip(*self.rows())) or [()] * (2 + len(self.classes))
            self.extra["vocabulary"] = Vocabulary(columns[0], **dict(zip(["idf", *self.weight_cols], columns[1:])))
        return self.extra["vocabulary"]

    def rows(self) -> list[tuple]:
        """The term table's rows; read once."""
        if not self.extra.get("rows"):
            self.extra["rows"] = [tuple(r) for r in self.terms.limit(MAX_TERMS + 1).collect()]
        return self.extra["rows"]

    @property
    def weight_cols(self) -> list[str]:
        return [f"w_{i}" for i in range(len(self.classes))]


def margins(df: DataFrame, model: TextModel, text: str = "message") -> DataFrame:
    """``df`` plus ``m_<class>`` margin columns, one row per record, with
    whatever columns and repeated keys it has.  A record without a known term
    is decided by the intercepts.

    The sums leave through a one-element generator: a later filter on the
    scores can be pushed down to the generator but not below it, so the
    counting expressions are never inlined into a pushed-down predicate
    (measured: a filtered query that did not finish).
    """
    vocabulary = model.vocabulary()
    if model.n_terms > WIDE_TERMS:
        buckets = buckets_of_terms([r[0] for r in model.rows()])
        counted = counted_among(df, buckets, text, model.ngram_max, "_counts")
    else:
        counted = term_counts(with_terms(df, text, "_terms", model.ngram_max), F.col("_terms"), "_counts")
    own = [f"`{c}`" for c in df.columns]
    hits = counted.selectExpr(*own, f"{vocabulary.vector('_counts', 'idf')} AS _hits")
    dots = "".join(f", '_d{i}', {vocabulary.dot('_hits', w)}" for i, w in enumerate(model.weight_cols))
    sums = hits.selectExpr(*own, f"inline(array(named_struct('_norm', {norm('_hits')}{dots})))")
    return sums.selectExpr(*own, *[f"{float(b)!r}D + coalesce(try_divide(_d{i}, _norm), 0D) AS `m_{c}`"
                                   for i, (c, b) in enumerate(zip(model.classes, model.intercepts))])


def classify(df: DataFrame, classes: list[str]) -> DataFrame:
    """I2-I4 on margin columns: ``p_<class>``, ``category``, ``confidence``."""
    sigmoid = {c: f"1D / (1D + exp(-`m_{c}`))" for c in classes}
    everything = " + ".join(f"({s})" for s in sigmoid.values())
    df = df.selectExpr("*", *[f"({sigmoid[c]}) / ({everything}) AS `p_{c}`" for c in classes])
    best = "greatest(" + ", ".join(f"`m_{c}`" for c in classes) + ")" if len(classes) > 1 else f"`m_{classes[0]}`"
    first = lambda value: "CASE " + " ".join(f"WHEN `m_{c}` = {best} THEN {value(c)}" for c in classes) + " END"
    return df.selectExpr("*", f"{first(sql_literal)} AS category", f"cast({first(lambda c: f'`p_{c}`')} AS double) AS confidence")


def needs_review(confidence: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    """P5: strictly below the threshold, whatever the category."""
    return confidence < F.lit(threshold)


def score(df: DataFrame, model: TextModel, text: str = "message", keep_internals: bool = False) -> DataFrame:
    """Records in, records + category, confidence, needs_review,
    model_version out (one row per input row)."""
    scored = classify(margins(df, model, text), model.classes)
    scored = scored.withColumn("needs_review", needs_review(F.col("confidence")))
    scored = scored.withColumn(
        "model_version", F.coalesce(F.lit(model.version), F.lit(UNKNOWN_VERSION)))
    if keep_internals:
        return scored
    drop = [f"m_{c}" for c in model.classes] + [f"p_{c}" for c in model.classes]
    return scored.drop(*drop)
