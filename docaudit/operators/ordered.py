"""Ordered passes over groups of any size.

``row_number``, ``lag`` and running sums need the rows of a group in order. A plain window
sends a group to one task, which is right for the many small groups and wrong for those that
hold millions of rows. These are counted first, exactly, whatever the input's size; each is cut
into blocks along the order, each block is one window partition, and a summary with one row per
block carries numbers across the cuts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKS = 256
HOT_ROWS = 2_000_000
_H, _B, _N = "__hash", "__block", "__in_block"


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> list[int]:
    """Hashes of all keys with at least ``rows`` rows: a two-millionth of the rows at most."""
    counts = df.select(_hash(keys).alias(_H)).groupBy(_H).agg(F.count(F.lit(1)).alias("n"))
    return [r[_H] for r in counts.filter(F.col("n") >= (rows or HOT_ROWS)).collect()]


def over_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: Column, *,
                 number: str | None = None, running: dict[str, Column] | None = None,
                 previous: dict[str, tuple[str, object]] | None = None,
                 hot: list[int] | None = None) -> DataFrame:
    """Add row numbers, running sums and previous values per ``keys`` in ``order``.

    ``order`` must be total within a group. ``spread`` is a number that never decreases along
    the order; the cuts of large groups fall on its values. ``previous`` maps a new column to
    (column, default for the first row).
    """
    running, previous = running or {}, previous or {}
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return _windowed(df, list(keys), list(order), number, running, previous)
    marked = df.withColumn(_H, _hash(keys))
    in_hot = F.col(_H).isin(hot)
    cold = _windowed(marked.filter(~in_hot), list(keys), list(order), number, running, previous)
    warm = _blocked(marked.filter(in_hot), list(keys), list(order), spread, number, running,
                    previous)
    return cold.unionByName(warm).drop(_H)


def _windowed(df, keys, order, number, running, previous) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    new = {name: F.sum(value).over(upto) for name, value in running.items()}
    new |= {name: F.lag(value, 1, default).over(w) for name, (value, default) in previous.items()}
    if number:
        new[number] = F.row_number().over(w).cast("bigint")
    return df.withColumns(new)


def _blocked(df, keys, order, spread, number, running, previous) -> DataFrame:
    spark = df.sparkSession
    df = df.withColumn("__spread", spread.cast("double"))
    # The cuts are literal values: a recomputed task sees the same blocks.
    fractions = [(i + 1) / BLOCKS for i in range(BLOCKS - 1)]
    cuts = [(row[_H], sorted(set(row["cuts"] or []))) for row in df.groupBy(_H).agg(
        F.percentile_approx("__spread", fractions, 10 * BLOCKS).alias("cuts")).collect()]
    cut_rows = spark.createDataFrame(cuts, f"{_H} bigint, __cuts array<double>")
    df = (df.join(F.broadcast(cut_rows), _H)
          .withColumn(_B, F.size(F.filter("__cuts", lambda b: b < F.col("__spread"))))
          .drop("__cuts", "__spread"))
    place = F.struct(*order)
    summary = df.groupBy(*keys, _H, _B).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(value).alias(f"__sum_{name}") for name, value in running.items()],
        *[F.max_by(F.struct(F.col(value).alias("v")), place).alias(f"__last_{name}")
          for name, (value, _) in previous.items()])
    across = W.partitionBy(*keys, _H).orderBy(_B)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys, _H, _B, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows"),
        *[F.sum(f"__sum_{n}").over(before).alias(f"__sum_{n}") for n in running],
        *[F.lag(f"__last_{n}").over(across).alias(f"__last_{n}") for n in previous])
    inside = W.partitionBy(*keys, _H, _B).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns(
        {_N: F.row_number().over(inside)}
        | {f"__in_{n}": F.sum(v).over(upto) for n, v in running.items()}
        | {f"__lag_{n}": F.lag(v, 1).over(inside) for n, (v, _) in previous.items()})
    joined = rows.join(carried, [*keys, _H, _B])
    new = {}
    for n in running:
        both = F.coalesce(f"__sum_{n}", F.lit(0)) + F.coalesce(f"__in_{n}", F.lit(0))
        new[n] = F.when(F.col(f"__sum_{n}").isNotNull() | F.col(f"__in_{n}").isNotNull(), both)
    for n, (_, default) in previous.items():
        carry = F.when(F.col(f"__last_{n}").isNull(), F.lit(default)).otherwise(
            F.col(f"__last_{n}.v"))
        new[n] = F.when(F.col(_N) == 1, carry).otherwise(F.col(f"__lag_{n}"))
    if number:
        new[number] = (F.col("__rows") + F.col(_N)).cast("bigint")
    kept = [c for c in df.columns if c != _B]
    return joined.withColumns(new).select(*kept, *new)


def attach(rows: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Equi-join whose key types may differ; adaptive execution splits keys with many rows."""
    on = [on] if isinstance(on, str) else list(on)
    for key in on:
        if rows.schema[key].dataType != lookup.schema[key].dataType:
            lookup = lookup.withColumn(key, F.col(key).cast(rows.schema[key].dataType))
    return rows.join(lookup, on, how)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that whatever reads them will not compute again.

    Filters and projections above are merged into the one below, and an Arrow function in it
    is then run once for each of them. Nothing is merged across a generator.
    """
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, F.explode(F.array(value)).alias("__once")).select(
        *kept, "__once.*")


def spread_if_one_file(df: DataFrame) -> DataFrame:
    """Deal a table of one file out to all cores; a table of many files has its splits."""
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def keep_present(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop rows where it is NULL, evaluating it once.

    A filter would be pushed below the projection and compute an Arrow function twice.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def first_per_group(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The first row of each group in order: an aggregate, so copies collapse map-side."""
    rest = [c for c in df.columns if c != group]
    best = df.groupBy(group).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(group, "__first.*").select(*df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                  number: str = "rn") -> DataFrame:
    """First n rows per group. Spark trims each partition to n rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= n)


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: Column,
                label: str) -> DataFrame:
    """Length of the longest run of equal labels per group, in order."""
    hot = hot_keys(df, keys)
    stepped = over_ordered(df, keys, order, spread, previous={"__before": (label, None)}, hot=hot)
    starts = F.when(F.col("__before").eqNullSafe(F.col(label)), 0).otherwise(1)
    runs = over_ordered(stepped.withColumn("__start", starts), keys, order, spread,
                        running={"__run": F.col("__start")}, hot=hot)
    sizes = runs.groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("__size"))
    return sizes.groupBy(*keys).agg(F.max("__size").alias("longest_run"))
