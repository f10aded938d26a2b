"""Hard negatives by inner product, with LEMP-style coordinate pruning.

Components become whole numbers, so scores are exact. Rows are dealt by a hash to blocks, in the first pass those of each
label apart; in a block they stand in buckets of falling length, and a bucket keeps for every coordinate the list of its
unit vectors' values, sorted. An anchor looks for rows that score at least a threshold. Of a bucket
whose longest vector is too short for that nothing is taken. Else the threshold becomes one on the cosine, c; where the anchor's
unit vector has x in a coordinate, a row that reaches c has a value within x c -+ sqrt((1 - x^2)(1 - c^2)).
The coordinates with the largest |x| are the focus: each is a range of its sorted list, the shortest range gives
the candidates, the others are intersected with it, and what is left is multiplied out exactly. Thresholds rise as better rows are
found, first those of the longest buckets.

Two passes: the first ``POSITIVES`` rows of the anchor's own label, then for each of them the best ``NEGATIVES`` rows of
other labels whose score lies within a window below the positive's. A block hands on its own best rows only; the
best of all blocks follow from a window function that cuts each task's rows first. Anchors are a stated share of the rows.
They are dealt to groups, and every block meets every group once, in one task. Blocks and groups are bounded by the numbers
they hold (``BLOCK``, ``GROUP``), so no task holds more than one of each, and nothing of them reaches the driver or is broadcast.

Rows with a null id or label, a null or empty vector, or any null or non-finite component take no part. Vectors
of different length meet nothing. A row of an anchor's own id is never its positive or negative. Anchors that
are equal in id, label and vector are one; other rows that repeat are candidates each. Equal scores go by the smaller id, rows of
equal id by a hash. A vector of zeros scores 0 against all. No rows, no anchors or one label give no result rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import spread_join, written

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Components in a block and in a group of anchors; a small table is dealt to up to SPREAD blocks of LEAST rows or more.
BLOCK, GROUP, SPREAD, LEAST = 1 << 20, 1 << 18, 16, 512
#: Rows of a bucket, focus coordinates.
BUCKET, FOCUS = 1_024, 4
#: Slack for rounding in ranges and bounds; what lies inside is multiplied out exactly.
SLACK = 1e-9
UNBOUND = 1 << 62


def whole_vectors(rows: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v, mark): the rows that take part, components as floor(SCALE x), and a hash of label and vector."""
    x = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")))
    taken = rows.filter(F.col(id).isNotNull() & (F.size(vector) > 0) & fine).select(
        F.col(id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda c: F.floor(SCALE * x(c))).alias("v")).filter("label is not null")
    return taken.withColumn("mark", F.xxhash64("label", "v"))


class Bucket:
    """Rows of about one length, with a sorted list for each coordinate of their unit vectors."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.v = rows, v
        self.longest, self.least = float(lengths.max()), float(lengths.min())
        if self.least > 0:
            self.unit = np.ascontiguousarray((v / lengths[:, None]).T)
            self.order = np.argsort(self.unit, axis=1, kind="stable")
            self.sorted = np.take_along_axis(self.unit, self.order, axis=1)

    def candidates(self, anchor: np.ndarray, length: float, threshold: float) -> np.ndarray | None:
        """Places of the rows that may score the threshold, None for all."""
        if threshold <= 0 or not self.least or not length:
            none = threshold > 0 and (not length or not self.longest)
            return np.empty(0, np.int64) if none else None
        c = threshold / (length * self.longest)
        if c > 1 + SLACK:
            return np.empty(0, np.int64)
        c = min(c, 1.0)
        unit = anchor / length
        focus = np.argpartition(-np.abs(unit), min(FOCUS, len(unit)) - 1)[:FOCUS]
        x = unit[focus]
        reach = np.sqrt(np.maximum(0, (1 - x * x) * (1 - c * c)))
        low, high = x * c - reach - SLACK, x * c + reach + SLACK
        # a value outside the reach is still possible where it is on the anchor's side of it: cosines over c
        high, low = np.where(x > c, np.inf, high), np.where(-x > c, -np.inf, low)
        begin = [int(np.searchsorted(self.sorted[f], a, "left")) for f, a in zip(focus, low)]
        end = [int(np.searchsorted(self.sorted[f], b, "right")) for f, b in zip(focus, high)]
        best = int(np.argmin(np.subtract(end, begin)))
        if 4 * (end[best] - begin[best]) > 3 * len(self.rows):
            return None  # most of them: no list is worth reading
        found = self.order[focus[best], begin[best]:end[best]]
        for k, f in enumerate(focus):
            if k != best and len(found):
                values = self.unit[f, found]
                found = found[(values >= low[k]) & (values <= high[k])]
        return found


def buckets_of(v: np.ndarray, size: int = BUCKET) -> list[Bucket]:
    """The rows in buckets of falling length; zero vectors have buckets of their own."""
    lengths = np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    zero = int((lengths > 0).sum())
    cuts = sorted({*range(0, zero, size), *range(zero, len(order), size)}) + [len(order)]
    return [Bucket(order[a:b], v[order[a:b]], lengths[order[a:b]]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Best:
    """The first ``size`` rows by falling score, then smaller id and mark."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.score, self.id, self.mark = (np.empty(0, np.int64) for _ in range(3))

    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.size else -UNBOUND

    def add(self, score: np.ndarray, id: np.ndarray, mark: np.ndarray) -> None:
        if not len(score):
            return
        if len(score) > 4 * self.size:
            least = -np.partition(-score, self.size - 1)[self.size - 1]
            near = score >= least
            score, id, mark = score[near], id[near], mark[near]
        score, id, mark = np.append(self.score, score), np.append(self.id, id), np.append(self.mark, mark)
        first = np.lexsort((mark, id, -score))[:self.size]
        self.score, self.id, self.mark = score[first], id[first], mark[first]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of the rows are exact in doubles."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2 ** 53


def _scores(v: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    return (v @ anchor).astype(np.int64) if exact else v.astype(np.int64) @ anchor.astype(np.int64)


def best_of_block(anchors: dict[str, np.ndarray], v: np.ndarray, id: np.ndarray, mark: np.ndarray, label: np.ndarray,
                  own_label: bool, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, scores, ids, marks): the block's best rows within each of an anchor's windows of scores.

    anchors: v, id, label, and low and high with a row of bounds for each.
    """
    buckets, exact = buckets_of(v), _exact(anchors["v"], v)
    for a in range(len(anchors["id"])):
        anchor, low, high = anchors["v"][a], anchors["low"][a], anchors["high"][a]
        length = float(np.sqrt(anchor @ anchor))
        windows = [k for k in range(len(low)) if low[k] <= high[k]]
        best = {k: Best(size) for k in windows}
        for bucket in buckets:
            threshold = min((max(int(low[k]), best[k].threshold()) for k in windows), default=UNBOUND)
            places = bucket.candidates(anchor, length, threshold)
            if places is not None and not len(places):
                continue
            rows = bucket.rows if places is None else bucket.rows[places]
            score = _scores(bucket.v if places is None else bucket.v[places], anchor, exact)
            near = score >= threshold
            near &= (label[rows] == anchors["label"][a]) == own_label
            near &= id[rows] != anchors["id"][a]
            score, rows = score[near], rows[near]
            for k in windows:
                inside = (score >= max(int(low[k]), best[k].threshold())) & (score <= high[k])
                best[k].add(score[inside], id[rows[inside]], mark[rows[inside]])
        for k in windows:
            if len(best[k].score):
                yield a, k, best[k].score, best[k].id, best[k].mark


def _best(rows: DataFrame, anchors: DataFrame, own_label: bool, size: int, block: int, group: int) -> DataFrame:
    """(anchor, anchor_mark, place, score, id, mark) of blocks of rows against groups of anchors.

    rows(id, label, v, mark); anchors(id, label, v, mark, windows array<struct<place, low, high>>). With ``own_label``
    anchors meet the rows of their label only, else those of all others.
    """
    keyed = lambda df: df.withColumns({"dim": F.size("v"), "part": F.col("label") if own_label else F.lit(0).cast("long")})
    rows, anchors = keyed(rows), keyed(anchors)
    n, dim = F.count("*"), F.first("dim")
    blocks = F.greatest(F.ceil(n * dim / block), F.least(F.lit(SPREAD), F.ceil(n / LEAST))).cast("int")
    cells = rows.groupBy("dim", "part").agg(blocks.alias("blocks")).join(
        anchors.groupBy("dim", "part").agg(F.ceil(n * dim / group).cast("int").alias("groups")), ["dim", "part"])
    mine = lambda total: F.pmod(F.xxhash64("id", "mark"), F.col(total)).cast("int")
    every = lambda total: F.explode(F.sequence(F.lit(0), F.col(total) - 1))
    keys = ["dim", "part", "block", "group"]
    left = spread_join(rows, cells, ["dim", "part"]).withColumn("block", mine("blocks")).withColumn("group", every("groups"))
    right = anchors.join(cells, ["dim", "part"]).withColumn("group", mine("groups")).withColumn("block", every("blocks"))
    left = left.withColumns({"side": F.lit(1), "windows": F.lit(None).cast("array<struct<place int, low bigint, high bigint>>")})
    columns = [*keys, "side", "id", "mark", "label", "v", "windows"]
    both = right.withColumn("side", F.lit(0)).select(columns).unionByName(left.select(columns))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(n, *keys).sortWithinPartitions(*keys, "side")
    return met.mapInArrow(_search(own_label, size), "anchor bigint, anchor_mark bigint, place int, score bigint, id bigint, mark bigint")


def _search(own_label: bool, size: int):
    names = ["anchor", "anchor_mark", "place", "score", "id", "mark"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cell(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """One block and one group: anchors first, then rows."""
        table = pa.Table.from_batches(batches).combine_chunks()
        side = table["side"].to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut in (0, len(side)):
            return None
        column = lambda name, a, b: table[name].combine_chunks().slice(a, b)
        v = _matrix(column("v", 0, len(side)), len(side))
        id, mark, label = (table[n].to_numpy() for n in ("id", "mark", "label"))
        windows = column("windows", 0, cut)
        flat = windows.flatten()
        place, low, high = (flat.field(n).to_numpy() for n in ("place", "low", "high"))
        offsets = np.concatenate(([0], np.cumsum(windows.value_lengths().to_numpy())))
        ranges = [slice(a, b) for a, b in zip(offsets[:-1], offsets[1:])]
        anchors = {"v": v[:cut], "id": id[:cut], "label": label[:cut], "low": [low[r] for r in ranges], "high": [high[r] for r in ranges]}
        found = [(np.full(len(s), id[a]), np.full(len(s), mark[a]), np.full(len(s), place[ranges[a]][k]), s, i, m)
                 for a, k, s, i, m in best_of_block(anchors, v[cut:], id[cut:], mark[cut:], label[cut:], own_label, size)]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells arrive sorted; a cell may span batches and a batch hold several."""
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    key = keys[a].tolist()
                    if held and key != current:
                        if (found := cell(held)) is not None:
                            yield found
                        held = []
                    current = key
                    held.append(batch.slice(a, b - a))
        if held and (found := cell(held)) is not None:
            yield found
    return run


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first rows of each key over all blocks, with their place from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "mark")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of the column ``id`` which rows are anchors. A negative's score n and the positive's p satisfy
    low p <= 100 n <= high p.
    """
    label = F.col(label) if isinstance(label, str) else label
    all_rows = written(whole_vectors(rows, id, vector, label), "whole-vectors")
    anchors = all_rows.filter(anchor).dropDuplicates(["id", "mark"])
    everything = F.array(F.struct(F.lit(0).alias("place"), F.lit(-UNBOUND).alias("low"), F.lit(UNBOUND).alias("high")))
    near = _best(all_rows, anchors.withColumn("windows", everything), True, positives, block, group)
    near = written(_first(near, ["anchor", "anchor_mark"], positives).select(
        "anchor", "anchor_mark", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    hundredth = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")  # noqa: E731  rounded down, in whole numbers
    window = F.struct("place", (-hundredth(f"(-{low} * positive_score)")).alias("low"), hundredth(f"({high} * positive_score)").alias("high"))
    windows = near.groupBy(F.col("anchor").alias("id"), F.col("anchor_mark").alias("mark")).agg(F.sort_array(F.collect_list(window)).alias("windows"))
    far = _best(all_rows, anchors.join(windows, ["id", "mark"]), False, negatives, block, group)
    ranked = _first(far, ["anchor", "anchor_mark", "place"], negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return ranked.join(near, ["anchor", "anchor_mark", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
