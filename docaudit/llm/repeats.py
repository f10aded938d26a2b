"""Removal of repeated byte strings, exact for a threshold of ``LENGTH`` bytes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. All documents together are too
long for one suffix array, so the work is cut into shards such that all occurrences of a string meet:

*Anchors.* Every start of a string names the smallest hash among the GRAM-byte substrings inside the
string (the first of equals). That depends on the string alone. Starts that follow each other and name the
same place are a *context*: the bytes from the first start to the end of the last one's string. A first
pass counts anchors into a bit table of fixed size; a second finds the contexts of anchors seen twice. The
table may know an anchor too many; that is only a context more, with an owner like every other.
*Copies collapse.* Contexts equal to the last byte are owned by their earliest document; in every other one,
and where it comes again in its owner, they are removed whole. This takes exact copies and the inside of
near copies out before anything is compared.
*Interval expansion.* What is left are anchors with several different contexts, one row for each. They are
shuffled by anchor, and a task builds a suffix array and the Burrows-Wheeler transform of a block of them.
From the intervals of single bytes it extends backwards, breadth first: each step turns the interval of a
string into those of one byte more to its left, so all common prefixes of length 1, 2, 3 ... appear in
this order, intervals with one suffix are dropped, and it stops at LENGTH. The suffixes of an interval that is left
share LENGTH bytes; all but the earliest are repeats. Before that, contexts are cut into runs of RUN starts: equal runs
collapse once more, and a run whose common core no other run of the block has is left out, as nothing in it can repeat.
*Crowded anchors.* An anchor with more different contexts than a partition should hold (the rim of a passage
that very many documents share) would be one shard; its strings are compared one by one instead, by their
hash, which spreads them over all tasks.
*Removal.* What a document owns and its marks are joined to its text, whose contexts are found once more.

Ids order the documents. If they repeat or are null, documents are numbered by (id, text) first, nulls in
front; rows equal in both come in any order, which changes no result but which of them is first. Null texts
are empty; texts under LENGTH bytes lose nothing. An empty table gives an empty one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import spread_join, written

LENGTH = 100
GRAM = 24
#: Starts that are judged together before the expansion.
RUN = 11
#: An anchor is compared string by string if it has more different contexts than a shuffle partition has on
#: average, but at least the first number and in any case from the second on.
CROWD = (1000, 10_000)
#: Bits of the tables, 2^BITS: their size doesn't grow with the input.
BITS = 27
#: Bytes hashed at once, bytes of contexts expanded at once, bytes of texts cut at once.
PIECE, BLOCK, GROUP = 1 << 17, 1 << 20, 4 << 20
_ODD = 0x9E3779B97F4A7C15
_HIGH = np.uint64(0xFFFFFFFFFF000000)
_LOW = np.uint64(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a text, from sums over its prefixes, modulo 2^64."""

    def __init__(self) -> None:
        self.values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.power = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)

    def load(self, text: np.ndarray) -> None:
        if len(self.power) < len(text):
            for name, factor in (("power", _ODD), ("back", pow(_ODD, -1, 1 << 64))):
                factors = np.full(len(text) + 1, factor, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.values[text] * self.power[:len(text)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Every substring of a size."""
        n = len(self.sums) - size
        x = (self.sums[size:] - self.sums[:n]) * self.back[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def contexts(text: np.ndarray, ends: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, anchor place, anchor hash, context hash) of all contexts in a
    text of several documents that end at ``ends``."""
    if len(text) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    hasher.load(text)
    grams = hasher.all(GRAM)
    least = _least((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    sizes = np.diff(ends, prepend=0)
    n = np.maximum(sizes - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(ends)), n)
    starts = np.repeat(ends - sizes - (np.cumsum(n) - n), n) + np.arange(len(doc))
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, place = starts[first], starts[last], place[first]
    c = _mixed(hasher.of(lo, hi + LENGTH) + (place - lo).astype(np.uint64))
    return doc[first], lo, hi, place, grams[place], c


def pieces(ids: list, column: pa.Array) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents up to PIECE bytes, and longer ones in parts that overlap by LENGTH - 1 bytes: their
    ids, offsets of the first byte in the document, bytes, ends."""
    held, at = [], 0
    for id, text in zip(ids, column):
        raw = np.frombuffer(text if isinstance(text, bytes) else text.as_py() or b"", np.uint8)
        if len(raw) > PIECE:
            for start in range(0, len(raw) - LENGTH + 1, PIECE):
                part = raw[start:start + PIECE + LENGTH - 1]
                yield [id], np.array([start]), part, np.array([len(part)])
            continue
        if at + len(raw) > PIECE:
            yield [h[0] for h in held], np.zeros(len(held), np.int64), np.concatenate([h[1] for h in held]), np.cumsum([len(h[1]) for h in held])
            held, at = [], 0
        held.append((id, raw))
        at += len(raw)
    if held:
        yield [h[0] for h in held], np.zeros(len(held), np.int64), np.concatenate([h[1] for h in held]), np.cumsum([len(h[1]) for h in held])


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash, named by its first and its last bits, are set."""
    found = np.ones(len(hashes), bool)
    for bit in (hashes >> np.uint64(64 - BITS), hashes & np.uint64((1 << BITS) - 1)):
        found &= ((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def _table(hashes: DataFrame, column: str) -> np.ndarray:
    """The bit table of a column of hashes, 2^BITS bits whatever the input."""
    bits = F.explode(F.expr(f"array(shiftrightunsigned({column}, {64 - BITS}), {column} & {(1 << BITS) - 1}L)"))
    words = hashes.select(bits.alias("bit")).groupBy(F.expr("shiftrightunsigned(bit, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (BITS - 6), np.uint64)
    found = words.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _pass(docs: DataFrame, schema: str, emit: Callable) -> DataFrame:
    """Rows that ``emit`` makes of the contexts of every piece of (uid, text)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for ids, offsets, text, ends in pieces(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = contexts(text, ends, hasher)
                if len(found[0]):
                    columns = emit(np.array(ids, np.int64), offsets, text, ends, hasher, *found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.view(np.int64)) if isinstance(c, np.ndarray) else c for c in columns], names)
    return docs.mapInArrow(run, schema)


def _counted(ids, offsets, text, ends, hasher, doc, lo, hi, place, anchor, c):
    return [anchor]


def _row_hash(anchor: np.ndarray, c: np.ndarray, uid: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(anchor + c * np.uint64(3)) + uid.view(np.uint64) * np.uint64(_ODD))


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 128 codes: ranks of 8 codes, doubled four times."""
    n = len(codes)
    padded = np.concatenate((codes, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j:j + n]
    width = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.uint64))))
        if width >= 128 or int(rank[order[-1]]) == n:
            return order
        later = np.zeros(n, np.uint64)
        later[:n - width] = rank[width:]
        key = (rank << np.uint64(32)) | later
        width *= 2


def shared_prefixes(codes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``length`` codes also follow another place, and the interval each is in.

    ``codes`` are 1 to 255; 0 separates texts and is never part of a string.
    """
    sa = suffix_array(codes)
    inverse = np.empty(len(sa), np.int64)
    inverse[sa] = np.arange(len(sa))
    bwt = codes[sa - 1]
    bwt[sa == 0] = 0
    step = inverse[sa - 1]  # where the suffix one code longer stands
    at = np.arange(len(sa))
    head = codes[sa]
    at = at[head > 0]
    group = head[head > 0].astype(np.int64)
    for size in range(1, length + 1):
        new = np.ones(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        edge = np.append(np.flatnonzero(new), len(at))
        many = np.repeat(np.diff(edge) > 1, np.diff(edge))
        at, group = at[many], (np.cumsum(new) - 1)[many]
        if size == length or not len(at):
            break
        c = bwt[at]
        inside = c > 0
        at, group, c = at[inside], group[inside], c[inside]
        order = np.argsort(c, kind="stable")
        at, group = step[at[order]], group[order] * 256 + c[order]
    return sa[at], group


def block_repeats(key: np.ndarray, uid: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray,
                  text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, first start, last start) of runs of strings in these contexts that start earlier in another.

    ``place`` is the anchor's place in its context, ``size`` the context's bytes, ``text`` all of them.
    """
    base = np.cumsum(size) - size
    starts = size - LENGTH + 1
    of = np.repeat(np.arange(len(key)), starts)
    t = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    run = (place[of] - t) // RUN
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    of, lo, hi, run = of[first], t[first], t[last], run[first]
    # runs in the order of their documents: of equal ones the first is the earliest
    begin = start[of] + lo
    order = np.lexsort((begin, uid[of]))
    of, lo, hi, run, begin = of[order], lo[order], hi[order], run[order], begin[order]
    hasher = Hasher()
    hasher.load(text)
    # what all strings of a run have in common, RUN - 1 bytes less than one
    core = base[of] + place[of] - run * RUN
    core = hasher.of(core, core + LENGTH - RUN + 1) + key[of].view(np.uint64) * np.uint64(_ODD) + run.astype(np.uint64)
    whole = _mixed(core) + hasher.of(base[of] + lo, base[of] + hi + LENGTH) + (place[of] - lo).astype(np.uint64) * np.uint64(_ODD)
    lead = np.unique(whole, return_index=True)[1]
    copied = np.ones(len(of), bool)
    copied[lead] = False
    copies = uid[of[copied]], begin[copied], begin[copied] + hi[copied] - lo[copied]
    _, back, count = np.unique(core[lead], return_inverse=True, return_counts=True)
    keep = np.sort(lead[count[back] > 1])
    of, lo, hi = of[keep], lo[keep], hi[keep]
    if not len(of):
        return copies
    width = hi - lo + LENGTH
    put = np.cumsum(width + 1) - width - 1
    inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    codes = np.zeros(int((width + 1).sum()), np.uint8)
    codes[np.repeat(put, width) + inner] = text[np.repeat(base[of] + lo, width) + inner] + 1
    at, group = shared_prefixes(codes)
    if not len(at):
        return copies
    piece = np.searchsorted(put, at, "right") - 1
    doc, begin = uid[of[piece]], start[of[piece]] + lo[piece] + at - put[piece]
    order = np.lexsort((begin, doc, group))
    doc, begin, group = doc[order], begin[order], group[order]
    # a place reached through two contexts stands twice in its interval: only the least place is first
    least = np.ones(len(doc), bool)
    least[1:] = group[1:] != group[:-1]
    lead = np.flatnonzero(least)[np.cumsum(least) - 1]
    again = (doc != doc[lead]) | (begin != begin[lead])
    return tuple(map(np.concatenate, zip(copies, _runs(doc[again], begin[again]))))


def _runs(doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single starts as runs."""
    if not len(doc):
        return doc, begin, begin
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] - begin[:-1] > 1)
    first = np.flatnonzero(new)
    return doc[first], begin[first], begin[np.append(first[1:], len(doc)) - 1]


MARK = "uid bigint, lo bigint, hi bigint"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, in blocks of whole anchors."""
    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, uid, start, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        raw = batch.column(4).to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        found = block_repeats(key, uid, start, place, size, np.frombuffer(b"".join(raw), np.uint8))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["uid", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            held.append(batch.slice(at, 2000))
            if sum(b.nbytes for b in held) < BLOCK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = whole.column(0).to_numpy()
            cut = int(np.argmax(key == key[-1])) if key[0] != key[-1] else 0
            if cut:
                yield done(whole.slice(0, cut))
            held = [whole.slice(cut)]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        if whole:
            yield done(whole[0])


def _numbered(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(uid, id, text): the id if it orders the documents, else their number by (id, text)."""
    raw = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = docs.schema[id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole:
        twice = raw.groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
        if not twice:
            return raw.select(F.col("id").cast("bigint").alias("uid"), "id", "text")
    ordered = raw.orderBy("id", F.xxhash64("text"), "text")
    return written(ordered.select(F.monotonically_increasing_id().alias("uid"), "id", "text"), "numbered")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, h, ...) of (anchor, c, owner, ...): the owner and the hash of context and owner."""
    for batch in batches:
        anchor, c, owner = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
        h = pa.array(_row_hash(anchor, c, owner.view(np.int64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(2), h, *batch.columns[3:]], ["uid", "h", *batch.schema.names[3:]])


def _places(doc: np.ndarray, lo: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in a piece as places in their document."""
    return lo - np.where(doc > 0, ends[doc - 1], 0) + offsets[doc]


def _crowded(docs: DataFrame, seen, dense) -> DataFrame:
    """Marks of crowded anchors: every string of their contexts by its hash, the earliest kept."""
    def strings_of(ids, offsets, text, ends, hasher, doc, lo, hi, place, anchor, c):
        keep = _in_table(seen.value, anchor)
        keep[keep] = _in_table(dense.value, _row_hash(anchor[keep], c[keep], ids[doc[keep]]))
        doc, lo, hi = doc[keep], lo[keep], hi[keep]
        n = hi - lo + 1
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.repeat(doc, n)
        return [hasher.of(at, at + LENGTH), ids[doc], _places(doc, at, ends, offsets)]

    strings = written(_pass(docs, "h bigint, uid bigint, start bigint", strings_of), "strings")
    owners = strings.groupBy("h").agg(F.min("uid").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = spread_join(strings, owners, ["h"])
    mark = ["uid", F.col("start").alias("lo"), F.col("start").alias("hi")]
    own = shared.filter("uid = owner")
    again = own.join(own.groupBy("h", "uid").agg(F.min("start").alias("least")), ["h", "uid"]).filter("start != least")
    return shared.filter("uid != owner").select(*mark).union(again.select(*mark))


def _judged(docs: DataFrame, crowd: int | None):
    """Per uid the contexts it owns (as hashes) and runs of starts that repeat; the table of anchors."""
    sc = docs.sparkSession.sparkContext
    counts = _pass(docs, "anchor bigint", _counted).groupBy("anchor").count().filter("count > 1")
    seen = sc.broadcast(_table(counts, "anchor"))

    def repeated(ids, offsets, text, ends, hasher, doc, lo, hi, place, anchor, c):
        keep = _in_table(seen.value, anchor)
        return [anchor[keep], c[keep], ids[doc[keep]]]

    found = _pass(docs, "anchor bigint, c bigint, uid bigint", repeated)
    earliest = written(found.groupBy("anchor", "c").agg(F.min("uid").alias("owner")), "first-contexts")
    owned = earliest.mapInArrow(_keyed, "uid bigint, h bigint")
    open_ = earliest.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    rows = spread_join(earliest, open_, ["anchor"]).select("anchor", "c", "owner", "kinds")
    rows = written(rows.mapInArrow(_keyed, "uid bigint, h bigint, kinds bigint"), "open-contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if crowd is None:
        crowd = min(max(CROWD[0], rows.count() // parts), CROWD[1])
    apart = sc.broadcast(_table(rows.filter(F.col("kinds") <= crowd), "h"))

    def bytes_of(ids, offsets, text, ends, hasher, doc, lo, hi, place, anchor, c):
        keep = _in_table(seen.value, anchor)
        keep[keep] = _in_table(apart.value, _row_hash(anchor[keep], c[keep], ids[doc[keep]]))
        doc, lo, hi, place, anchor = doc[keep], lo[keep], hi[keep], place[keep], anchor[keep]
        raw = text.tobytes()
        cut = pa.array([raw[s:e] for s, e in zip(lo.tolist(), (hi + LENGTH).tolist())], pa.binary())
        return [anchor, ids[doc], _places(doc, lo, ends, offsets), place - lo, cut]

    blocks = _pass(docs, "anchor bigint, uid bigint, start bigint, place bigint, bytes binary", bytes_of)
    marks = blocks.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_expand, MARK)
    dense = rows.filter(F.col("kinds") > crowd)
    if dense.limit(1).count():
        marks = marks.union(_crowded(docs, seen, sc.broadcast(_table(dense, "h"))))
    both = owned.select("uid", "h", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")).union(
        marks.select("uid", F.lit(None).cast("bigint"), "lo", "hi"))
    run = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    return both.groupBy("uid").agg(F.collect_list("h").alias("owned"), F.collect_list(run).alias("runs")), seen


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(t.as_py()) for t in batch.column(2).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["uid", "id", "packed"])


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring rows of together about ``most`` bytes."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _gone(uid: np.ndarray, raw: list[bytes], base: np.ndarray, owned: np.ndarray, marks: tuple[np.ndarray, ...],
          seen: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Which bytes of some texts, laid end to end from ``base``, are removed: contexts that are another's
    or come again, and the marked runs (row, first start, last start)."""
    found = []
    for ids, offsets, text, ends in pieces(list(range(len(raw))), raw):
        doc, lo, hi, _, anchor, c = contexts(text, ends, hasher)
        if len(doc):
            keep = _in_table(seen, anchor)
            doc, lo, hi = doc[keep], lo[keep], hi[keep]
            row, begin = np.array(ids)[doc], _places(doc, lo, ends, offsets)
            found.append((row, begin, begin + hi - lo, _row_hash(anchor[keep], c[keep], uid[row])))
    row, lo, hi = marks
    if found:
        *place, key = map(np.concatenate, zip(*found))
        again = np.ones(len(key), bool)
        again[np.unique(key, return_index=True)[1]] = False
        again |= ~np.isin(key, owned.view(np.uint64))
        row, lo, hi = (np.concatenate((a, b[again])) for a, b in zip(marks, place))
    edge = np.zeros(sum(map(len, raw)) + 1, np.int32)
    np.add.at(edge, base[row] + lo, 1)
    np.add.at(edge, base[row] + hi + LENGTH, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _results(uid: np.ndarray, raw: list[bytes], owned: pa.ListArray, runs: pa.ListArray, seen: np.ndarray, hasher: Hasher) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256, kept) of each text."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    base = np.cumsum(size) - size
    flat = runs.flatten()
    row = np.repeat(np.arange(len(raw)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
    marks = row, *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    gone = _gone(uid, raw, base, owned.flatten().to_numpy(zero_copy_only=False).astype(np.int64), marks, seen, hasher)
    out = []
    for b, n, text in zip(base.tolist(), size.tolist(), raw):
        part = gone[b:b + n]
        removed = int(np.count_nonzero(part))
        spans = 0
        if removed:
            spans = int(part[0]) + int(np.count_nonzero(part[1:] & ~part[:-1]))
            text = np.frombuffer(text, np.uint8)[~part].tobytes()
        out.append((n, removed, spans, hashlib.sha256(text).hexdigest(), text))
    return out


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", crowd: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; ``kept`` are the remaining bytes."""
    numbered = _numbered(docs, id, text)
    judged, seen = _judged(numbered.select("uid", "text"), crowd)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, hasher = zstandard.ZstdDecompressor().decompress, Hasher()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            texts = batch.column(2)
            for part in _groups([3 * len(t.as_buffer()) for t in texts], GROUP):
                some = batch.slice(part.start, part.stop - part.start)
                raw = [unpack(t.as_py()) for t in some.column(2)]
                rows = _results(some.column(0).to_numpy(), raw, some.column(3), some.column(4), seen.value, hasher)
                yield pa.RecordBatch.from_arrays([some.column(1)] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = docs.schema[id].dataType.simpleString()
    packed = numbered.select("uid", "id", "text").mapInArrow(_packed, f"uid bigint, id {kind}, packed binary")
    return packed.join(judged, "uid", "left").select("uid", "id", "packed", "owned", "runs").mapInArrow(
        kept, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
