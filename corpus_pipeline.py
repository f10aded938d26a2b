"""The corpus pipeline: documents through five stages, each written and read again as the next one's.

Every stage judges all that its predecessor kept. Columns that the table of documents has besides are
carried along. Null texts don't get past the first stage, which counts them as empty; rows with a null
id are never taken for a copy of another.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import decontaminate, lines, mixing, secrets, simhash
from docaudit.llm.common import fresh, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; of the rest keep the text without its failing lines."""
    out = fresh(docs, "quality")
    judged = lines.line_first(docs, out=out).filter(F.col(out)["kept"])
    cleaned = F.col(out)["cleaned"]
    return judged.withColumns({"text": cleaned, "n_chars": F.length(cleaned).cast("long")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near duplicates."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, their secrets replaced by the name of their kind."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add to every document its rate and number of copies in the mixture."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_rates),
]
#: No SQL: fingerprints, nested decoding and a fitted classifier can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
