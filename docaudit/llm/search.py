"""Ranked lexical search over whole documents, with documents grouped by which terms they hold.

One pass over the texts makes a forward index: of each document the number of its terms, and those terms with their
counts that the items may ask for. That is asked of a bit table of the items' term hashes, which has a fixed size
(``BITS``) and is broadcast; a fuller table lets more terms through, nothing else. Weights come from exact counts over all
documents.

Items are taken in blocks of at most ``PAIRS`` terms (or one item), each sent to the tasks whole. A task
takes up to ``SLAB`` documents at a time and makes a bitmap of documents for every term. An item's bitmaps, one
under the other and turned, are the presence masks of the documents: which of the item's terms each holds. Documents with equal
masks form a group. No document of a group scores more than the sum over its terms of the weight times the term's
greatest part in this slab, so the groups are taken by falling bound, their documents scored exactly, until
``top`` scores are above the next bound. From a slab come the ``top`` best per item, from all slabs together the result, through
a window function that cuts each task's rows first.

Null and empty items and those without any term of a document have no rows; so have documents without terms. Null items' ids are kept
and are one item, as are items that share an id: their terms are taken together. Rows that share an id are documents of
their own, of equal score in the order of a hash. Null document ids come after all others at equal scores. Empty tables give no rows.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docaudit.llm.common import ascii_lower, spread_join, text_of, written

TOP = 10
#: Fixed values of the contract: what a term is made of, and the constants of its score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE = 90
SCALE = 1_000_000_000
#: Bits of the table of asked terms, as a power of two.
BITS = 22
PAIRS, SLAB = 200_000, 8_192
#: Documents that are scored at once, at first; their number doubles from round to round.
FIRST = 32
#: Terms in UTF-8: ASCII letters in lower case, digits, and all bytes beyond ASCII; other bytes part them.
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def bit_table(terms: DataFrame, bits: int = BITS) -> np.ndarray:
    """2^bits bits, set where the hashes of the terms point; its size doesn't grow with anything."""
    bit = F.shiftrightunsigned(F.xxhash64("term"), 64 - bits)
    words = terms.select(bit.alias("bit")).groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for word, found in words.collect():
        table[word] = found & 0xFFFFFFFFFFFFFFFF
    return table


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""
    terms = F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(f"({TERM})"), F.lit(1))
    return items.select(F.col(item).alias("item"), F.explode(F.array_distinct(terms)).alias("term")).distinct()


def forward_index(docs: DataFrame, asked: np.ndarray, id: str, text: str) -> DataFrame:
    """(id, mark, n, terms, counts): per document with a term the number of its terms, and those that may be asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(asked)
    names = ["id", "mark", "n", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        shift = np.uint64(64 - (len(table) * 64).bit_length() + 1)
        wanted: dict[bytes, bool] = {}
        for batch in batches:
            at, totals, sizes, terms, counts = [], [], [], [], []
            column = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                found = Counter((column[i].as_py() or b"").translate(BYTES).split())
                if not found:
                    continue
                if len(wanted) > 1_000_000:
                    wanted.clear()
                new = [t for t in found if t not in wanted]
                bit = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in new), np.uint64, len(new)) >> shift
                hit = (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                wanted.update(zip(new, hit.astype(bool).tolist()))
                mine = [t for t in found if wanted[t]]
                at.append(i)
                totals.append(found.total())
                sizes.append(len(mine))
                terms += mine
                counts += map(found.__getitem__, mine)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows), pa.array(totals, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names)
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, mark bigint, n bigint, terms array<string>, counts array<bigint>")


def weights(index: DataFrame, asked: DataFrame, docs: int) -> DataFrame:
    """(item, term, w) of all terms of items that some document holds."""
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2.0 * docs + 2) / (2 * F.col("df") + 1)))
    return spread_join(asked, df.select("term", w.alias("w")), ["term"])


class Slab:
    """Documents of a task with a bitmap and the sorted documents of every term, and each term's part in their scores."""

    def __init__(self, n: np.ndarray, terms: pa.ListArray, counts: pa.ListArray, docs: int, total: int) -> None:
        self.docs = len(n)
        sizes, counts = terms.value_lengths().to_numpy(), counts.flatten().to_numpy()
        coded = terms.flatten().dictionary_encode()
        term, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // total
        doc = np.repeat(np.arange(len(n)), sizes)
        self.places = {t: k for k, t in enumerate(known)}
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        part = SCALE * counts // (1000 * counts + 8 * m[doc])
        self.part = part[order]
        self.ends = np.cumsum(np.bincount(term, minlength=len(known)))
        begins = self.ends - np.diff(self.ends, prepend=0)
        self.most = np.maximum.reduceat(self.part, begins) if len(term) else np.empty(0, np.int64)
        bits = np.zeros((len(known), -(-max(len(n), 1) // 8) * 8), bool)
        bits[term, doc] = True
        self.bitmaps = np.packbits(bits, axis=1)

    def best(self, terms: list[str], w: list[int], rank: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores above 0, the best first; ``rank`` puts documents of equal score in order."""
        at = [(self.places[t], x) for t, x in zip(terms, w) if x > 0 and t in self.places]
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, weight = (np.array(x, np.int64) for x in zip(*at))
        # masks: one row of bits per document, one bit per term
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=self.docs)
        masks = np.packbits(bits.T, axis=1)
        wide = np.zeros((self.docs, -(-masks.shape[1] // 8) * 8), np.uint8)
        wide[:, :masks.shape[1]] = masks
        keys = wide.view(np.uint64)
        order = np.lexsort(keys.T)
        new = np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(axis=1)))
        first = np.flatnonzero(new)
        held = bits[:, order[first]]
        bound = (weight * self.most[rows]) @ held.astype(np.int64)
        size = np.diff(np.append(first, len(order)))
        falling = np.argsort(-bound, kind="stable")
        falling = falling[bound[falling] > 0]
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        ends, bound = np.cumsum(size[falling]), bound[falling]
        done, goal = 0, FIRST
        while done < len(falling):
            if len(scores) >= top and bound[done] < scores[top - 1]:
                break
            stop = min(max(done + 1, int(np.searchsorted(ends, goal, "right"))), len(falling))
            groups = falling[done:stop]
            each = size[groups]
            docs = order[np.repeat(first[groups] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            found, scores = np.append(found, docs), np.append(scores, self.scores(docs, rows, weight))
            best = np.lexsort((rank[found], -scores))[:top]
            found, scores = found[best], scores[best]
            done, goal = stop, 2 * max(goal, int(ends[stop - 1]))
        return found[scores > 0], scores[scores > 0]

    def scores(self, docs: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for row, w in zip(rows.tolist(), weight.tolist()):
            begin, end = int(self.ends[row - 1]) if row else 0, int(self.ends[row])
            held = self.doc[begin:end]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total += np.where(held[at] == docs, w * self.part[begin + at], 0)
        return total


def _blocks(pairs: DataFrame, most: int) -> list[DataFrame]:
    """(item, terms, w), dealt to blocks of at most ``most`` terms each, or of one item."""
    items = written(pairs.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select(
        "item", F.col("t.term").alias("terms"), F.col("t.w").alias("w")), "items")
    n, size = 1, F.size("terms")
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        fullest = items.groupBy(block.alias("block")).agg(F.sum(size).alias("terms"), F.count("*").alias("items")).filter(
            (F.col("terms") > most) & (F.col("items") > 1)).agg(F.max("terms")).first()[0]
        if fullest is None:
            return [items.filter(block == b) for b in range(n)]
        n *= max(2, -(-fullest // most))


def _best(index: DataFrame, items: DataFrame, docs: int, total: int, top: int) -> DataFrame:
    """(item, id, mark, score): the best of every slab for the items of one block."""
    rows = items.collect()
    numbers = pa.array([r.item for r in rows], to_arrow_type(items.schema["item"].dataType))
    sent = index.sparkSession.sparkContext.broadcast((numbers, [(r.terms, r.w) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, asked = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, SLAB):
                part = batch.slice(begin, SLAB)
                slab = Slab(part.column(2).to_numpy(), part.column(3), part.column(4), docs, total)
                rank = np.empty(part.num_rows, np.int64)
                rank[pc.sort_indices(pa.Table.from_batches([part]).select(["id", "mark"]), [("id", "ascending"), ("mark", "ascending")],
                                     null_placement="at_end").to_numpy()] = np.arange(part.num_rows)
                found = [slab.best(terms, w, rank, top) for terms, w in asked]
                at = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
                places, scores = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (list(zip(*found)) or [(), ()]))
                yield pa.RecordBatch.from_arrays([numbers.take(pa.array(at)), part.column(0).take(pa.array(places)),
                                                  part.column(1).take(pa.array(places)), pa.array(scores)], ["item", "id", "mark", "score"])
    kinds = [items.schema["item"].dataType.simpleString(), index.schema["id"].dataType.simpleString()]
    return index.mapInArrow(run, f"item {kinds[0]}, id {kinds[1]}, mark bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           top: int = TOP, pairs: int = PAIRS, bits: int = BITS) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each item with a score above 0."""
    asked = written(item_terms(items, item, item_text), "item-terms")
    index = written(forward_index(docs, bit_table(asked, bits), id, text), "forward-index")
    n, total = index.agg(F.count("*"), F.sum("n")).first()
    found = [_best(index, block, n, total or 1, top) for block in _blocks(weights(index, asked, n), pairs)]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "mark")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= top).select("item", "rank", "id", "score")
