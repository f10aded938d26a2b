"""Near duplicates by SimHash, found in BK-trees.

Fingerprints that are equal collapse first. Two that differ in at most three of 64 bits agree on at
least two of five blocks of bits, so every fingerprint goes to the ten shards its pairs of blocks name
and all its neighbours are met in one of them. A shard is a BK-tree: a child hangs on the edge numbered
by its Hamming distance to its parent. The tree is handed to every query of the shard, and a query at
distance d from a node follows only the edges from d - radius to d + radius. A shard with more than
``CHUNK`` fingerprints is cut into chunks, and each pair of chunks is a shard of its own: no task ever
gets more than two chunks of one key, no pair is lost. From a shard comes one link per fingerprint at
most, to the root of what it is connected with there; the links' connected components are the classes.

Nothing about all documents reaches the driver: trees live in the tasks their shard was shuffled to.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, spread_join, written
from docaudit.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: (first bit, bits) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one shard that one task searches; more are cut into pairs of chunks.
CHUNK = 2048
#: Fingerprints held at once by a task, queries searched at once.
SLAB, QUERIES = 400_000, 20_000


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64 bits: a bit is 1 if set in over half the hashes of the shingles; no words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """(id, fp) per row, with the hash of its text as ``mark`` if asked for; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            more = [batch.column(2)] if marked else []
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *more], ["id", "fp", "mark"][:2 + marked])
    kind = docs.schema[id].dataType.simpleString()
    mark = [F.xxhash64(text).alias("mark")] if marked else []
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *mark).mapInArrow(
        run, f"id {kind}, fp bigint" + ", mark bigint" * marked)


def _block(fp: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1).cast("long"))


def _shards(fp: Column) -> Column:
    """The ten shards of a fingerprint: which two blocks, and their bits."""
    return F.array(*[
        F.lit(n << 26).cast("long") + F.shiftleft(_block(fp, a), 13) + _block(fp, b)
        for n, (a, b) in enumerate(combinations(BLOCKS, 2))])


def grow(fp: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once, level by level: root of each row's tree; edges as sorted
    parent * 65 + distance, and the child on each. ``tree`` is sorted, ``fp`` differs within a tree."""
    rows = np.arange(len(fp))
    first = np.concatenate(([True], tree[1:] != tree[:-1]))
    root = rows[first][np.cumsum(first) - 1]
    keys, nodes = [], []
    node, rest = root[~first], rows[~first]
    while len(rest):
        edge = node * 65 + np.bitwise_count(fp[rest] ^ fp[node])
        order = np.argsort(edge, kind="stable")
        edge, rest = edge[order], rest[order]
        first = np.concatenate(([True], edge[1:] != edge[:-1]))
        keys.append(edge[first])
        nodes.append(rest[first])
        node, rest = rest[first][np.cumsum(first) - 1][~first], rest[~first]
    if not keys:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    keys, nodes = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(keys)
    return root, keys[order], nodes[order]


def search(fp: np.ndarray, query: np.ndarray, node: np.ndarray, keys: np.ndarray, nodes: np.ndarray,
           radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within the radius; of a node only the edges that can hold more are followed."""
    while len(query):
        d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
        near = (d <= radius) & (query != node)
        yield query[near], node[near]
        if not len(keys):
            return
        low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0), "left")
        high = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
        n = high - low
        start = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        query, node = np.repeat(query, n), nodes[start + np.arange(len(start))]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b; every entry of ``parent`` points at the class's smallest row."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def shard_links(fp: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the first one each is connected with in its shard, itself left out."""
    root, keys, nodes = grow(fp, tree)
    parent = np.arange(len(fp))
    rows = np.flatnonzero(np.bincount(root, minlength=len(fp))[root] > 1)
    for at in range(0, len(rows), QUERIES):
        query = rows[at:at + QUERIES]
        for a, b in search(fp, query, root[query], keys, nodes, radius):
            _union(parent, a, b)
    child = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[child], fp[parent[child]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards arrive sorted; whole ones are searched as soon as a slab is full."""
    names = ["a", "b"]

    def found(shard, lo, hi, fp):
        new = (shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        a, b = shard_links(fp.view(np.uint64), np.concatenate(([0], np.cumsum(new))))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= SLAB:
            columns = [np.concatenate(c) for c in zip(*held)]
            same = np.all([c[:-1] == c[-1] for c in columns[:3]], axis=0)
            cut = n - 1 - (len(same) if same.all() else int(np.argmin(same[::-1])))
            if cut:
                yield found(*[c[:cut] for c in columns])
            held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield found(*[np.concatenate(c) for c in zip(*held)])


def near_links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within the radius."""
    keyed = distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("shard"))
    many = keyed.groupBy("shard").count().filter("count > 1").select(
        "shard", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    met = spread_join(keyed, many, ["shard"])
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = met.select("fp", "shard", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("shard", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    return sorted_.mapInArrow(_link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                    marked: bool = False) -> DataFrame:
    """(id, fp, component) per row: its fingerprint and the smallest id reachable over links; with ``mark`` if asked for.

    Null texts count as empty; all texts without a word share fingerprint zero and so one class. Null
    ids belong to the class of their fingerprint and never name it (a class of null ids only has a
    null name). Repeated rows stay. An empty table gives an empty one; other columns are not read.
    """
    found = written(fingerprints(docs, id, text, marked), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct, chunk), "a", "b").withColumnRenamed("node", "fp")
    classes = spread_join(distinct, roots, ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = spread_join(classes.select("fp", "root"), names, ["root"]).select("fp", "component")
    return spread_join(found, named, ["fp"]).select("id", "fp", "component", *["mark"] * marked)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their class: one document of each, that with the smallest id.
    Rows with a null id stay, and so do all rows of the class that repeat the kept id. Rows that share an
    id are judged by their texts, each by its own class."""
    mark, key = fresh(docs, "__mark"), fresh(docs, "__key")
    gone = near_duplicates(docs, id, text, marked=True).filter("id != component").select(
        F.col("id").alias(key), F.col("mark").alias(mark)).distinct()
    return docs.withColumns({key: F.col(id), mark: F.xxhash64(text)}).join(gone, [key, mark], "left_anti").select(*docs.columns)
