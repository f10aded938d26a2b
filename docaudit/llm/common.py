"""Small helpers of the operators of this folder."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import new_folder

#: ASCII white space; words are what lies between it.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, so that a user's columns are never touched."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the folder all executors share and read it: no lineage, no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The whole text, the empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(column: Column) -> Column:
    """The column behind a generator: a later filter on it can't be pushed below and so repeat
    its expression, which inside a lambda would mean once per element."""
    return F.explode(F.array(column))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which adaptive execution can split a key that holds many rows of ``left``.

    It splits only what the join itself shuffles. A side that was just grouped by the same keys
    would not be shuffled again, so a hash of the keys goes along as one key more.
    """
    h = fresh(left, fresh(right, "__h"))
    a, b = left.withColumn(h, F.hash(*keys)), right.withColumn(h, F.hash(*keys))
    return a.join(b, [*keys, h], how).drop(h)
