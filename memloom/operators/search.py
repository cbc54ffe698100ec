"""Ranked recall: BM25+ over rendered messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Words that a query leaves out.
STOPWORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might can shall of in to for with on at from by as into through during before after above below between out off over under again further then once here there when where why how all both each few more most other some such no nor not only own same so than too very just about it its that this what which who whom these those".split()
)
K, B, DELTA = 1.2, 0.75, 0.5
FLOOR, CAP, PAGE = 0.2, 50, 5
OPERATORS = re.compile(r"[|*+?{}()\[\]\\^$]")


def query_terms(query: str) -> list[str]:
    terms = query.split()
    return [t for t in terms if t.lower() not in STOPWORDS and len(t) > 1] or terms


def term_pattern(term: str) -> str:
    """A term with operators is a pattern if it compiles, any other is literal."""
    if OPERATORS.search(term):
        try:
            re.compile(term)
            return f"(?iu){term}"
        except re.error:
            pass
    return f"(?iu){re.escape(term)}"


def term_counts(text: Column, terms: list[str]) -> list[Column]:
    return [F.regexp_count(text, F.lit(term_pattern(t))).cast("long") for t in terms]


def bm25_context(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """One row: n, avg_length, df0, df1 ..."""
    counts = term_counts(F.col(text), terms)
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(F.split(text, r"\s+", -1))).alias("avg_length"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(counts)])


def bm25(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """docs that match any term, with matched (distinct terms) and score; one row of context is broadcast."""
    terms = query_terms(query)
    context = bm25_context(docs, terms, text).select([F.col(c).alias(f"_{c}") for c in ("n", "avg_length", *(f"df{i}" for i in range(len(terms))))])
    rows = docs.select("*", *[c.alias(f"_tf{i}") for i, c in enumerate(term_counts(F.col(text), terms))], F.size(F.split(text, r"\s+", -1)).alias("_length"))
    rows = rows.filter(sum((F.col(f"_tf{i}") for i in range(len(terms))), F.lit(0)) > 0).crossJoin(F.broadcast(context))
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        norm = tf * (K + 1) / (tf + K * (1 - B + B * F.col("_length") / F.greatest("_avg_length", F.lit(1.0))))
        score = score + F.when(tf > 0, idf * (norm + DELTA)).otherwise(0.0)
        matched = matched + (tf > 0).cast("int")
    return rows.select(*docs.columns, matched.alias("matched"), score.alias("score"))


def ranked(hits: DataFrame, n_terms: int, order: list[str], floor: float = FLOOR, cap: int = CAP) -> DataFrame:
    """The best `cap` hits with rank; with two terms or more, those under `floor` of the best go first."""
    if n_terms >= 2:
        best = hits.agg(F.max("score").alias("_best"))
        hits = hits.crossJoin(F.broadcast(best)).filter(F.col("score") >= floor * F.col("_best")).drop("_best")
    top = hits.orderBy(F.desc("score"), *order).limit(cap)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), *order)).cast("long"))


def page(ranked_hits: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    return ranked_hits.filter(F.col("rank").between((number - 1) * size + 1, number * size))


def recall(docs: DataFrame, query: str, order: list[str], number: int | None = None) -> DataFrame:
    out = ranked(bm25(docs, query), len({t.lower() for t in query_terms(query)}), order)
    return out if number is None else page(out, number)
