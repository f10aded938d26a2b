"""The read side: document summaries, analysis views, predictions, recommendations.

A view is a set of flat tables rather than one row with nested lists, so a document with any
number of findings is still rows that Spark can split.
"""
from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators import score as S
from docaudit.operators import training as TR
from docaudit.operators.ordered import attach, over_ordered
from docaudit.operators.rules import Facts
from docaudit.session import cut_lineage


def _counted(docs: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """docs plus one count per child table: tagged rows, one aggregation, one join."""
    tagged = None
    for name, rows in tables.items():
        part = rows.select("doc_id", F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.union(part)
    counts = tagged.groupBy("doc_id").agg(*[
        F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in tables])
    return docs.join(counts, "doc_id", "left").na.fill(0, list(tables))


def document_summary(facts: Facts, findings: DataFrame, predictions: DataFrame) -> DataFrame:
    return _counted(facts.docs.select("doc_id"), {
        "images": facts.images, "tables": facts.tables, "headings": facts.headings,
        "links": facts.links, "findings": findings, "predictions": predictions})


def alt_predictions(images: DataFrame, model: TR.Model | None = None) -> DataFrame:
    """Only images with a real alt are scored; by the rule when no model is at hand."""
    scored = images.filter(Q.alt_state(F.col("alt")) == C.ALT_PRESENT)
    rows = over_ordered(scored, ["doc_id"], ["seq"], F.col("seq"), number="rn").select(
        "doc_id", (F.col("rn") - 1).alias("idx"), "part", "name", "alt")
    return TR.score(rows, model, "alt").withColumn(
        "confidence", Q.served_confidence(F.col("used_heuristic"), F.col("confidence")))


def served_predictions(images: DataFrame, model: TR.Model | None = None) -> DataFrame:
    """Predictions that are written once; when the model fails on them the rule decides all of them, and says so."""
    if model is not None:
        try:
            return cut_lineage(alt_predictions(images, model))
        except Exception as failed:  # whatever the model's fault: the analysis goes on without it
            warnings.warn(f"model failed, the rule decides: {type(failed).__name__}", stacklevel=2)
    return alt_predictions(images)


def join_by_position(images: DataFrame, answers: DataFrame,
                     blank: Column | None = None) -> DataFrame:
    """Pair images with answers by position; a document with another count loses all."""
    left = over_ordered(images, ["doc_id"], ["seq"], F.col("seq"), number="rn")
    right = over_ordered(answers, ["doc_id"], ["seq"], F.col("seq"), number="rn")
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    same = n(images, "n").join(n(answers, "m"), "doc_id").filter("n = m").select("doc_id")
    pairs = left.join(right.drop("seq"), ["doc_id", "rn"])
    rows = attach(pairs, same, "doc_id", "left_semi").withColumn("idx", F.col("rn") - 1)
    category = F.col("category") if blank is None else F.when(~blank, F.col("category"))
    return rows.select("doc_id", "idx", "alt", category.alias("category")).filter(
        F.col("category").isNotNull())


def recommend(findings: DataFrame) -> DataFrame:
    """The fixed sentence of each finding's rule."""
    spark = findings.sparkSession
    table = spark.createDataFrame(list(C.RECOMMENDATIONS.items()), "rule_id string, text string")
    # One row per rule of this package.
    return findings.join(F.broadcast(table), "rule_id", "left").select(
        "doc_id", "rule_id", "criterion",
        F.coalesce("text", F.lit(C.DEFAULT_RECOMMENDATION)).alias("text"),
        F.lit("FIXTURE").alias("provenance"), F.lit("fixture-local").alias("model"))


@dataclass(frozen=True)
class AnalysisView:
    headers: DataFrame
    findings: DataFrame
    scores: DataFrame
    predictions: DataFrame
    docs: DataFrame


def analysis_view(docs: DataFrame, findings: DataFrame, predictions: DataFrame) -> AnalysisView:
    """docs(doc_id, owner_id, state, ...) with findings, scores and predictions."""
    finished = docs.filter("state = 'CONCLUIDA'").select("doc_id")
    scores = S.global_scores(docs, findings).select("doc_id", "global_score")
    headers = S.score_of_finished(scores, docs).drop("state").join(
        _counted(docs, {"total_findings": findings, "total_predictions": predictions}), "doc_id")
    headers = headers.select("doc_id", "owner_id", "state", "title", "total_findings",
                             "total_predictions", "global_score")
    return AnalysisView(headers, findings, S.principle_scores(finished, findings), predictions, docs)


def of_owner(view: AnalysisView, owner: Column) -> AnalysisView:
    """What one owner may read; foreign and missing analyses look the same. Whose an analysis is says the table of
    documents: no header has to be made for it."""
    docs = view.docs.filter(F.col("owner_id") == owner)
    kept = {name: attach(getattr(view, name), docs.select("doc_id"), "doc_id", "left_semi")
            for name in ("findings", "scores", "predictions")}
    return replace(view, headers=view.headers.filter(F.col("owner_id") == owner), docs=docs, **kept)


def cascade(parents: DataFrame, children: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Children go with their analysis."""
    ids = parents.select("doc_id")
    return {n: attach(df, ids, "doc_id", "left_semi") for n, df in children.items()}


def outbox_diagnostics(outbox: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """Attempts, last error and dead letters per analysis."""
    sent = outbox.groupBy("analysis_id").agg(
        F.sum("attempts").alias("attempts"),
        F.count(F.when(F.col("published_at").isNull(), 1)).alias("pending"),
        F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("event_id"))).alias(
            "last_error"))
    dead = dead_letters.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("dead_letters"))
    return sent.join(dead, "analysis_id", "left").na.fill(0, ["dead_letters"])
