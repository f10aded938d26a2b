"""Tables stored for reading: apart by owner, in order of time.

A row's place in its owner's order is numbered once, when it is written, so a read in order is a filter and no sort. The
folder of a row follows from its owner and files are cut along owner and place, so a read opens one folder, skips the row
groups of other owners by their statistics, and an owner with very many rows is spread over files.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docaudit.operators.ordered import over_ordered

PARTS = 64


def part_of(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner.cast("string")), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Stored:
    """A table in a folder, for one ``owner`` at a time; foreign and missing rows look the same."""

    folder: str
    schema: StructType
    owner: str

    def of(self, spark: SparkSession, owner: object) -> DataFrame:
        """The rows of one owner with their ``position`` from 1; none for null."""
        mine = (F.col(self.owner) == F.lit(owner)) & (F.col("part") == part_of(F.lit(owner).cast(self.schema[self.owner].dataType)))
        return spark.read.schema(self.schema).parquet(self.folder).filter(mine).drop("part")

    def between(self, spark: SparkSession, owner: object, first: int, last: int) -> DataFrame:
        """A page of the owner's rows."""
        return self.of(spark, owner).filter(F.col("position").between(first, last))


def store(rows: DataFrame, folder: str, owner: str, order: Sequence[str], spread: Column) -> Stored:
    """Write rows in ``order`` of each owner; ``spread`` is a number that never falls along it. Rows without an owner can't
    be read by anyone and are kept in a part of their own."""
    numbered = over_ordered(rows, [owner], list(order), spread, number="position")
    placed = numbered.withColumn("part", F.coalesce(part_of(F.col(owner)), F.lit(-1)))
    placed.repartitionByRange("part", owner, "position").sortWithinPartitions("part", owner, "position").write.partitionBy(
        "part").parquet(folder)
    return Stored(folder, placed.schema, owner)
