"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation; numbers, names (a capital and small letters) and units become typed
placeholders, everything else is lower-cased. Names that follow each other are one placeholder. A run of
tokens is a template; beside this typed form runs with names are also taken with the names lower-cased, so that
copies in other case are met. A run of numbers and units alone is taken as it is written. Runs have at most
``WINDOW`` tokens and a third of the item's, ``MIN_SIZE`` at least, so that an edited word leaves some on both sides.

Benchmark items and documents are joined on equal runs. A run that more than ``OWN`` templates of items share is a frame: it
counts towards an item's cover, but only a run of the item's own can open a match (an item without any takes all of its
runs). So documents and items are paired by own runs first, and only pairs get their other runs. The runs of a pair are chained as long
as they advance in both; from one to the next the diagonal (document position minus item position) may
shift by WINDOW words or a quarter of the item, so words can be inserted, dropped or changed. What fills the
placeholders of a chain must map one to one from the item to the document, which a copy does and a re-parameterised
question does too, while texts that merely share a frame don't. A document is contaminated by an item if a
chain covers ``MIN_COVER`` of its words. Equal texts, of documents or of items, are judged once.

The first ``MIN_SIZE`` tokens of a document's runs are held against a bit table of the items' runs, and where they are known
the runs of all sizes against another. Both have a fixed size (``BITS``) and are broadcast; a fuller table lets more
runs through, the join is exact either way.
Nothing else of the benchmark reaches the driver. The runs that one document shares with one item are chained in one
place; there are about as many as the document has words in common with it.

An item with fewer than ``MIN_LITERAL`` tokens that are no placeholders says too little as a template: its runs are taken as
they are written. Items of fewer than ``MIN_SIZE`` words say nothing and are not looked for. Null and empty texts match nothing, null ids of documents stay null in the result, repeated items are
reported each, repeated documents once. Empty tables give no rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, spread_join, written

WINDOW = 8
MIN_SIZE = 3
MIN_LITERAL = 3
MIN_COVER = 0.6
OWN = 2
BITS = 24
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
UNITS = frozenset((
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg",
    "gram", "grams", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "litre", "litres", "liter",
    "liters", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "percent", "%", "degree", "degrees", "dollar", "dollars",
    "cent", "cents", "euro", "euros", "metre", "metres", "meter", "meters", "km/h", "mph"))
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*")
_MULTIPLIER = 0x9E3779B97F4A7C15
WINDOWS = "doc bigint, pos int, size int, hash bigint, template string, words array<string>, head bigint, n int, whole bigint, bare boolean"
#: Words that are looked at together; a longer text is taken whole.
CHUNK = 100_000


def token(word: str) -> tuple[str, str]:
    """The word without outer punctuation, and its canonical form; both empty for punctuation alone."""
    if word == "%":
        return word, UNIT
    bare = _EDGE.sub("", word)
    low = bare.lower()
    if _NUMBER.fullmatch(bare):
        return bare, NUMBER
    if low in UNITS:
        return bare, UNIT
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return bare, NAME
    return bare, low


class Tokens:
    """Canonical hashes and class of every word of a list; remembers words it has met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.codes = np.zeros((3, 1 << 16), np.uint64)  # typed, lower-cased but for numbers and units, as written

    def __call__(self, words: list[str]) -> np.ndarray:
        """Three rows, the hashes of each word."""
        known = self.known
        if len(known) > 400_000:
            known.clear()
        new, begin = list(set(words).difference(known)), len(known)
        end = begin + len(new)
        known.update(zip(new, range(begin, end)))
        if end > self.codes.shape[1]:
            self.codes = np.concatenate((self.codes, np.zeros((3, max(end, self.codes.shape[1])), np.uint64)), axis=1)
        if new:
            self.codes[:, begin:end] = np.array(list(map(word_codes, new)), np.uint64).T
        return self.codes[:, np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def _code(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode("utf-8", "replace")) | 1


_NUMBER_CODE, _NAME_CODE, _UNIT_CODE = map(_code, (NUMBER, NAME, UNIT))
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_codes(word: str) -> tuple[int, int, int]:
    """Hashes of a word: typed; lower-cased but for numbers and units; as written. Zeros for punctuation alone."""
    bare = word.strip(_MARKS)
    if bare.isalpha():  # most words: no need to look at their edges
        low = bare.lower()
        code = _code(low)
        if low in UNITS:
            return _UNIT_CODE, _UNIT_CODE, code
        return _NAME_CODE if len(bare) > 1 and bare[0].isupper() and bare[1:].islower() else code, code, code
    bare, form = token(word)
    if not form:
        return 0, 0, 0
    code = _code(bare.lower())
    if form == NUMBER:
        return _NUMBER_CODE, _NUMBER_CODE, code
    if form == UNIT:
        return _UNIT_CODE, _UNIT_CODE, code
    return _NAME_CODE if form == NAME else code, code, code


def _hashed(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hashes, modulo 2^64, of the runs of so many codes that begin at these places."""
    total = codes[at]
    for j in range(1, size):
        total = total * np.uint64(_MULTIPLIER) + codes[at + j]
    return (total ^ (total >> np.uint64(29))) * np.uint64(_MULTIPLIER)


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - BITS)
    return ((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def size_of(n: int) -> int:
    """Tokens of a run of an item of ``n`` words."""
    return min(n, WINDOW, max(MIN_SIZE, n // 3))


def runs_of(words: list[str], of: np.ndarray, codes: np.ndarray, sizes: list[int], tables: tuple[np.ndarray, np.ndarray] | None,
            exact: bool = False) -> Iterator[tuple[int, int, int, int, str, list[str], int]]:
    """(text, word, size, hash, template, words, hash of the first tokens) of all runs of the sizes that the tables know.

    ``of`` is the text of each word, ``codes`` its hashes. ``tables``: of first tokens, of runs. With ``exact`` all runs as they are
    written count, of an item no others; else only such of numbers and units alone.
    """
    n = len(words)
    if not n:
        return
    typed, plain, written_ = codes
    name, open_ = typed == np.uint64(_code(NAME)), (typed == np.uint64(_code(NUMBER))) | (typed == np.uint64(_code(UNIT)))
    first = np.ones(n, bool)
    first[1:] = ~(name[1:] & name[:-1] & (of[1:] == of[:-1]))
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    each = np.arange(n)
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    literal, names, closed = sums(~(name | open_)[starts]), sums(name), sums(~open_)
    as_written = (lambda p, k: np.ones(len(p), bool)) if exact else (lambda p, k: closed[p + k] == closed[p])
    streams = [(typed[starts], starts, ends, lambda p, k: literal[p + k] > literal[p], lambda w: token(w[0])[1]),
               (plain, each, each + 1, lambda p, k: names[p + k] > names[p],
                lambda w: f if (f := token(w[0])[1]) in (NUMBER, UNIT) else token(w[0])[0].lower()),
               (written_, each, each + 1, as_written, lambda w: token(w[0])[0].lower())]
    for codes, begin, end, wanted, form in streams[2:] if exact and tables is None else streams:
        owner, hits = of[begin], {}
        for size in sizes:
            start = min(size, MIN_SIZE)
            if start not in hits:
                p = np.arange(max(0, len(codes) - start + 1))
                if wanted is as_written:
                    p = p[wanted(p, start)]
                hits[start] = p if tables is None else p[_known(tables[0], _hashed(codes, p, start))]
            p = hits[start]
            p = p[p <= len(codes) - size]
            p = p[(owner[p] == owner[p + size - 1]) & wanted(p, size)]
            hashes = _hashed(codes, p, size)
            if tables is not None:
                known = _known(tables[1], hashes)
                p, hashes = p[known], hashes[known]
            heads = _hashed(codes, p, start)
            for at, hash_, head in zip(p.tolist(), hashes.view(np.int64).tolist(), heads.view(np.int64).tolist()):
                parts = [words[b:e] for b, e in zip(begin[at:at + size].tolist(), end[at:at + size].tolist())]
                yield (int(owner[at]), int(begin[at]), size, hash_, " ".join(map(form, parts)),
                       [" ".join(token(w)[0] for w in part) for part in parts], head)


def _windows(texts: DataFrame, sizes: list[int] | None, tables: tuple[np.ndarray, np.ndarray] | None, bare: bool = False) -> DataFrame:
    """Runs of (id, text): of all texts those of their own size without ``sizes``, else those the tables know.
    ``head`` is the hash of a run's first tokens, ``whole`` that of an item's template; ``bare`` are runs of items that are
    taken as they are written, and says of texts whether there are any."""
    sent = None if tables is None else texts.sparkSession.sparkContext.broadcast(tables)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    names = ["id", *(f.split()[0] for f in WINDOWS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()

        def flush(held: list[tuple[int, list[str], int]]) -> Iterator[tuple]:
            words = [w for _, t, _ in held for w in t]
            of = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])
            codes = tokens(words)
            if not codes[0].all():
                there = codes[0] != 0
                words, of, codes = list(compress(words, there.tolist())), of[there], codes[:, there]
            counts = np.bincount(of, minlength=len(held))
            base, counts = (np.cumsum(counts) - counts).tolist(), counts.tolist()
            mine, exact, whole = sizes, bare, 0
            if mine is None:  # one item
                forms = [token(w)[1] for w in words]
                whole = _code(" ".join(forms)) - (1 << 63)
                if len(forms) < MIN_SIZE:
                    return
                exact = sum(f not in (NUMBER, NAME, UNIT) for f in forms) < MIN_LITERAL
                size = min(len(words), WINDOW) if exact else size_of(len(words))
                mine = sorted({size, size if exact else min(size, len(words) - sum(f == g == NAME for f, g in zip(forms, forms[1:])))})
            for i, at, *rest in runs_of(words, of, codes, mine, None if sent is None else sent.value, exact):
                yield held[i][0], (held[i][2], at - base[i], *rest, counts[i], whole, exact)

        for batch in batches:
            ids, rows, held, n = [], [], [], 0
            column = batch.column(1)
            for i in range(len(column)):
                text = column[i].as_py() or ""
                words = text.split()
                if words:
                    held.append((i, words, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)))
                    n += len(words)
                if held and (sizes is None or n >= CHUNK or i + 1 == len(column)):
                    for at, row in flush(held):
                        ids.append(at)
                        rows.append(row)
                    held, n = [], 0
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64()))] + [
                pa.array(c, k) for c, k in zip(columns, kinds)], names)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, {WINDOWS}")


def _bit_table(windows: DataFrame, hash: str) -> np.ndarray:
    """2^BITS bits, set where the top bits of a hash point; its size doesn't grow with anything."""
    bit = F.shiftrightunsigned(hash, 64 - BITS)
    words = windows.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hash}, {64 - BITS}) & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (BITS - 6), np.uint64)
    for word, bits in words.collect():
        table[word] = bits & 0xFFFFFFFFFFFFFFFF
    return table


def _length(words: list[str]) -> int:
    return sum(w.count(" ") + 1 for w in words)


def chained(runs: list[dict], n: int, min_cover: float) -> tuple[float, bool] | None:
    """Cover and exactness of an item of ``n`` words by the runs it shares with a document, None if too little fits."""
    # [item from, to, document from, to, members]; runs that go on along one diagonal are laid together
    laid: list[list] = []
    key = lambda r: (r["pos"] - r["ipos"], r["ipos"], r["pos"])
    for r in sorted(runs, key=key):
        a, d = r["ipos"], r["pos"]
        x, y = a + _length(r["filled"]), d + _length(r["words"])
        last = laid[-1] if laid else None
        if last and last[0] - last[2] == a - d == last[1] - last[3] and a <= last[1] and x - y == a - d:
            last[1], last[3] = max(last[1], x), max(last[3], y)
            last[4].append(r)
        else:
            laid.append([a, x, d, y, [r]])
    laid.sort(key=lambda z: (z[2], z[0]))
    shift = max(WINDOW, n // 4)
    longest = max((z[3] - z[2] for z in laid), default=0)
    score, before = [z[1] - z[0] for z in laid], [-1] * len(laid)
    for j, (a, x, d, y, _) in enumerate(laid):
        for i in range(j - 1, -1, -1):
            b, u, e, v, _ = laid[i]
            if e + longest + n + shift < d:
                break
            if b < a and e < d and u < x and v < y and abs((d - a) - (v - u)) <= shift:
                gain = min(x - max(a, u), y - max(d, v))
                if gain > 0 and score[i] + gain > score[j]:
                    score[j], before[j] = score[i] + gain, i
    best = None
    for j in sorted(range(len(laid)), key=lambda j: -score[j]):
        if score[j] < min_cover * n or best and best[1] and score[j] <= best[0] * n:
            break
        chain, i = [], j
        while i >= 0:
            chain.append(laid[i])
            i = before[i]
        found = _slots(chain, n)
        if found and found[0] >= min_cover:
            best = found if best is None else (max(best[0], found[0]), best[1] or found[1])
    return best


def _slots(chain: list[list], n: int) -> tuple[float, bool] | None:
    """Cover and exactness of a chain, None if its placeholders don't map one to one."""
    met: set[int] = set()
    theirs: dict[tuple, str] = {}
    ours: dict[tuple, str] = {}
    exact = True
    for k, (_, _, _, _, members) in enumerate(chain):
        # where two neighbours overlap, either alignment may be meant: no word on slots there
        near = [chain[m] for m in (k - 1, k + 1) if 0 <= m < len(chain)]
        for r in members:
            a, d = r["ipos"], r["pos"]
            for form, t, o in zip(r["template"].split(" "), r["filled"], r["words"]):
                met.update(range(a, a + t.count(" ") + 1))
                if form in (NUMBER, NAME, UNIT) and not any(z[0] <= a < z[1] and not _same(z, a, d) for z in near):
                    t_, o_ = t.lower(), o.lower()
                    exact &= t_ == o_
                    if theirs.setdefault((form, t_), o_) != o_ or ours.setdefault((form, o_), t_) != t_:
                        return None
                a, d = a + t.count(" ") + 1, d + o.count(" ") + 1
    return len(met) / n, exact


def _same(run: list, a: int, d: int) -> bool:
    """Whether the run lays the item's word on this one of the document."""
    for r in run[4]:
        x, y = r["ipos"], r["pos"]
        for t, o in zip(r["filled"], r["words"]):
            if x == a and y == d:
                return True
            x, y = x + t.count(" ") + 1, y + o.count(" ") + 1
    return False


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """(id, item, cover, exact): documents that hold an item, the share of its words found, and whether
    what fills its placeholders is the same but for case (else it was re-parameterised)."""
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text"))
    known = written(_windows(items, None, None), "benchmark-runs")
    members = known.select(F.col("id").alias("item"), F.col("doc").alias("of")).distinct()
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    tables = _bit_table(known, "head"), _bit_table(known, "hash")
    bare = known.filter("bare").limit(1).count() > 0
    found = written(_windows(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), sizes, tables, bare).drop("n", "whole", "head", "bare"), "document-runs")
    texts, runs = found.select("id", "doc").distinct(), found.drop("id").distinct()
    key = ["hash", "size", "template"]
    known = known.select(F.col("doc").alias("of"), F.col("pos").alias("ipos"), *key, F.col("words").alias("filled"), F.col("n").alias("n_item"), "whole").distinct()
    frames = known.groupBy(*key).agg(F.count_distinct("whole").alias("templates")).withColumn("frame", F.col("templates") > OWN)
    known = spread_join(known, frames.select(*key, "frame"), key)
    framed = known.groupBy("of").agg(F.min("frame").alias("framed"))  # items all of whose runs are frames
    known = written(spread_join(known, framed, ["of"]), "benchmark-runs")
    opening = known.filter("not frame or framed").select(*key, "of").distinct()
    pairs = written(spread_join(runs.select("doc", *key), opening, key).select("doc", "of").distinct(), "pairs")
    asked = spread_join(known.drop("whole", "frame", "framed"), pairs, ["of"])
    met = spread_join(runs, asked, ["doc", *key])
    groups = met.groupBy("doc", "of").agg(
        F.collect_set(F.struct("pos", "ipos", "template", "filled", "words")).alias("runs"), F.max("n_item").alias("n_item"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, covers, exacts = [], [], []
            runs, n = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                best = chained(runs[i].as_py(), n[i].as_py(), min_cover)
                if best:
                    at.append(i)
                    covers.append(best[0])
                    exacts.append(best[1])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(covers, pa.float64()),
                                              pa.array(exacts, pa.bool_())], ["doc", "of", "cover", "exact"])
    laid = groups.mapInArrow(chain, "doc bigint, of bigint, cover double, exact boolean")
    laid = spread_join(texts, laid, ["doc"])
    return spread_join(laid, members, ["of"]).groupBy("id", "item").agg(F.max("cover").alias("cover"), F.max("exact").alias("exact"))


def clean_of(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id can't be named and stay."""
    key = fresh(docs, "__key")
    gone = contaminated(docs, benchmark, id, text, item, item_text).select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, F.col(id)).join(gone, key, "left_anti").select(*docs.columns)
