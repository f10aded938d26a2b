"""Tables that micro-batches append to and look up again, a batch at a time.

A table lies in folders ``part=.../run=.../batch=...``. The part follows from the row (a day, a bucket of ids), so a
batch that looks for earlier rows reads only the parts that its own rows name. The run stands for a checkpoint: batch
numbers mean something only there. A batch that is replayed writes its own folders again and never sees them.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(of: str) -> Column:
    """One of BUCKETS parts for ids that name no day."""
    return F.pmod(F.xxhash64(F.col(of).cast("string")), F.lit(BUCKETS)).cast("string")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name for the checkpoint: made with it, the same whenever it is taken up again."""
    folder = f"{checkpoint.rstrip('/')}.run"
    try:
        return spark.read.text(folder).first()["value"]
    except AnalysisException:
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "value string").coalesce(1).write.text(folder)
        return spark.read.text(folder).first()["value"]


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder that only jobs with one row a batch write to is there."""
    try:
        spark.read.schema("rows bigint").parquet(folder)
        return True
    except AnalysisException:
        return False


@dataclass(frozen=True)
class Batch:
    run: str
    number: int


@dataclass(frozen=True)
class BatchLog:
    """``columns`` is the schema without part, run and batch; ``part`` the part of a row, as text."""

    folder: str
    columns: str
    part: Column

    @property
    def schema(self) -> str:
        return f"{self.columns}, part string, run string, batch bigint"

    def create(self, spark: SparkSession) -> None:
        """The table without rows, unless it is there."""
        spark.createDataFrame([], self.schema).write.mode("append").partitionBy("part", "run", "batch").parquet(self.folder)

    def write(self, rows: DataFrame, batch: Batch) -> None:
        names = [c.split()[0] for c in self.columns.split(", ")]
        placed = rows.withColumns({"part": F.coalesce(self.part, F.lit("none")), "run": F.lit(batch.run), "batch": F.lit(batch.number).cast("bigint")})
        # rows of a part come together, so it gets few files, not one from each task; a large part is split
        placed.select(*names, "part", "run", "batch").hint("rebalance", "part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("part", "run", "batch").parquet(self.folder)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.folder)

    def earlier(self, rows: DataFrame, batch: Batch) -> DataFrame:
        """The rows of all earlier batches in the parts that these rows name; other parts are not opened."""
        named = [r[0] for r in rows.select(F.coalesce(self.part, F.lit("none"))).distinct().collect()]
        own = (F.col("run") == batch.run) & (F.col("batch") >= batch.number)
        return self.rows(rows.sparkSession).filter(F.col("part").isin(named) & ~own)


def committed(spark: SparkSession, output: str, table: str) -> DataFrame:
    """The rows of a table that consumption wrote, of batches that were written to their end.

    All tables of a batch are there before its mark is, so readers see a batch in all of them or in none.
    """
    marks = spark.read.schema("rows bigint, run string, batch bigint").parquet(f"{output}/commits").select("run", "batch")
    return spark.read.parquet(f"{output}/{table}").join(marks, ["run", "batch"], "left_semi")
