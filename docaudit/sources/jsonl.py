"""JSON-lines files with line numbers, and the sinks of datasets and reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class JsonLinesError(ValueError):
    """A line is not what the format promises; the message names it."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line with its number, blank ones counted.

    Ids rise along a file block, so a line's number is its distance from the first line of
    its block plus the lines of the blocks before. The numbers need one row per file block.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(
        W.unboundedPreceding, -1))
    offsets = blocks.select("file", "start", "first_id", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "start"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first_id") + 1).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str,
                    strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, invalid lines): rows have ``line_no``; strict mode raises on the first invalid one."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    typed = ", ".join([schema, "_corrupt string"])
    parsed = lines.withColumn("row", F.from_json(
        "value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    is_object = F.trim("value").startswith("{")
    bad = F.col("row._corrupt").isNotNull() | ~is_object
    invalid = parsed.filter(bad).select("file", "line_no", F.when(
        is_object, "nao e JSON valido").otherwise("nao e um objeto JSON").alias("reason"))
    if strict:
        first = invalid.orderBy("file", "line_no").limit(1).collect()
        if first:
            raise JsonLinesError(f"linha {first[0]['line_no']} {first[0]['reason']}")
    return parsed.filter(~bad).select("file", "line_no", "row.*").drop("_corrupt"), invalid


def write_dataset(rows: DataFrame, path: str, overwrite: bool = False, form: str = "parquet") -> None:
    """All or nothing by the commit protocol; replacing needs the flag."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows.write.mode(mode).format(form).save(path)


def write_report(report: DataFrame, path: str, overwrite: bool = True) -> None:
    """A report as one JSON file, all its rows."""
    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)
