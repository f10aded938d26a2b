"""Features of a text for the classifiers here: hashed words, structure, metadata."""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed words take the first WORDS places, statistics of structure and metadata the rest.
WORDS = 1 << 14
STATISTICS = ("length", "word_length", "symbols", "capitals", "digits", "not_ascii", "distinct_words",
              "most_common_word", "repeated_lines", "line_length", "pipes", "marks", "stops", "n_chars", "no_n_chars")
SIZE = WORDS + len(STATISTICS)
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>~^"
_ASCII = bytes(range(128))


def _share(raw: bytes, kind: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kind))) / max(1, len(raw))


class Extractor:
    """Feature places and values of a text; remembers where words hash to."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (each once), values, and the number of words."""
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = text.split()
        counts = Counter(words)
        places, known = [], self.places
        if len(known) > 300_000:
            known.clear()
        for word in counts:
            place = known.get(word)
            if place is None:
                place = known[word] = zlib.crc32(word.strip(".,;:!?\"'()").lower().encode("utf-8", "replace")) % WORDS
            places.append(place)
        # words that share a place add up; the whole is scaled to length one
        if places:
            values = np.bincount(places, np.fromiter(counts.values(), np.float64, len(places)))
            at = np.flatnonzero(values)
            values = np.log1p(values[at])
            values /= np.sqrt((values * values).sum())
        else:
            at, values = np.empty(0, np.int64), np.empty(0)
        lines = [x for x in text.split("\n") if x.strip()]
        n = max(1, len(words))
        stats = (
            np.log1p(len(words)) / 10, min(1.0, len(text) / n / 20), 5 * _share(raw, _SYMBOLS), _share(raw, _CAPITALS),
            5 * _share(raw, _DIGITS), 1 - _share(raw, _ASCII) if raw else 0.0, len(counts) / n,
            max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words) / max(1, len(lines))) / 6, min(1.0, 2 * text.count("|") / n), min(1.0, text.count("!!") / n),
            min(1.0, 4 * text.count(".") / n), np.log1p(max(0, n_chars or 0)) / 15, float(n_chars is None))
        return (np.concatenate((at, np.arange(WORDS, SIZE))).astype(np.int32), np.concatenate((values, stats)).astype(np.float32),
                len(words))


def chosen_labels(labels: DataFrame, label: F.Column, id: str, rows: int, learn: F.Column) -> DataFrame:
    """(id, label) of at most about ``rows`` labelled ids: those whose hash is small enough.

    Null ids and labels don't count; of several labels of an id the smallest does. The hash cut is
    chosen from the number of labelled rows, so the sample keeps its size however many there are.
    """
    known = labels.select(F.col(id).alias("id"), label.alias("label")).filter("id is not null and label is not null")
    known = known.filter(learn).groupBy("id").agg(F.min("label").alias("label"))
    n = known.count()
    cut = 1_000_000 if n <= rows else rows * 1_000_000 // n
    return known.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < cut)


def learning_rows(docs: DataFrame, chosen: DataFrame, id: str, text: str, n_chars: str | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, places, values) of the chosen documents, on the driver. ``chosen`` is bounded by its
    maker, so it is broadcast; several texts of one id are all taken."""
    size = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    taken = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), size.alias("n_chars")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            found = [extract(t, n)[:2] for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array([a.tobytes() for a, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary())], ["id", "label", "places", "values"])
    kind = chosen.schema["label"].dataType.simpleString()
    key = chosen.schema["id"].dataType.simpleString()
    rows = taken.select("id", "text", "n_chars", "label").mapInArrow(run, f"id {key}, label {kind}, places binary, values binary")
    rows = sorted(rows.collect(), key=lambda r: (str(r["id"]), bytes(r["values"])))
    return [(r["label"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
