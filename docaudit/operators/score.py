"""Scores per principle and overall. Derived on read, never stored."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import text as T
from docaudit.operators.rules import evaluated_principles


def _penalty(penalties: Mapping[str, int]):
    branch = None
    for severity, points in penalties.items():
        test = F.col("severity") == severity
        branch = F.when(test, points) if branch is None else branch.when(test, points)
    return branch


def _totals(docs: DataFrame, findings: DataFrame, principles: Sequence[str],
            penalties: Mapping[str, int]) -> DataFrame:
    """One row per document with penalty and count of every evaluated principle.

    Conditional sums over one groupBy combine map-side, so a document with a large share of
    the findings reaches the shuffle as one row per task.
    """
    marked = findings.select("doc_id", T.principle_of(F.col("criterion")).alias("p"),
                             _penalty(penalties).cast("bigint").alias("points"))
    sums = [F.sum(F.when(F.col("p") == p, F.col("points"))).alias(f"points_{p}")
            for p in principles]
    counts = [F.count(F.when(F.col("p") == p, 1)).alias(f"count_{p}") for p in principles]
    totals = marked.groupBy("doc_id").agg(*sums, *counts)
    return docs.select("doc_id").join(totals, "doc_id", "left").na.fill(0)


def principle_scores(docs: DataFrame, findings: DataFrame, principles: Sequence[str] | None = None,
                     penalties: Mapping[str, int] = C.PENALTIES,
                     weights: Mapping[str, int] = C.WEIGHTS) -> DataFrame:
    """A row for every evaluated principle of every document, also without findings."""
    principles = evaluated_principles() if principles is None else principles
    titles = {name: title for _, name, title in C.PRINCIPLES}
    rows = [F.struct(
        F.lit(p).alias("principle"), F.lit(titles[p]).alias("title"),
        F.greatest(F.lit(0), F.lit(C.MAX_SCORE) - F.col(f"points_{p}")).alias("score"),
        F.lit(weights[p]).alias("weight"), F.col(f"count_{p}").alias("problems"),
        F.col(f"points_{p}").alias("penalty")) for p in principles]
    return _totals(docs, findings, principles, penalties).select(
        "doc_id", F.inline(F.array(*rows)))


def global_scores(docs: DataFrame, findings: DataFrame, principles: Sequence[str] | None = None,
                  penalties: Mapping[str, int] = C.PENALTIES,
                  weights: Mapping[str, int] = C.WEIGHTS) -> DataFrame:
    """Weighted mean over evaluated principles, half up; NULL means not measured, not zero."""
    principles = evaluated_principles() if principles is None else principles
    if not principles:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("global_score"),
                           F.lit("").alias("not_evaluated"))
    total = sum(weights[p] for p in principles)
    weighted = sum((F.greatest(F.lit(0), F.lit(C.MAX_SCORE) - F.col(f"points_{p}")) * weights[p]
                    for p in principles), F.lit(0))
    score = F.floor(weighted / F.lit(float(total)) + 0.5) if total else F.lit(None).cast("bigint")
    missing = ", ".join(n for _, n, _ in C.PRINCIPLES if n not in principles)
    return _totals(docs, findings, principles, penalties).select(
        "doc_id", score.cast("bigint").alias("global_score"),
        F.lit(missing).alias("not_evaluated"))


def score_of_finished(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Only a finished analysis has a score."""
    return docs.select("doc_id", "state").join(scores, "doc_id").select(
        "doc_id", "state",
        F.when(F.col("state") == "CONCLUIDA", F.col("global_score")).alias("global_score"))
