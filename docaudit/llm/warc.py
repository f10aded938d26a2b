"""Web archives, read by index.

*Writing.* Every task writes one archive of plain records; equal payloads of at least
``MIN_SHARED`` bytes are stored once, by the record with the largest id, and the others revisit it.
*Index.* A pass over the archives that reads record headers only and skips from one to the next by
their length writes a table: archive, offset, length, url, digest, type.
*Reading.* The rows selected from the index are sorted by archive and offset; ranges that touch or
nearly touch are read at once, and the records cut out of them. Payloads are checked against their digest.

Files are written by Spark's own writer and committer, so lost or repeated tasks leave no broken archive,
and read through Arrow's file systems, so the folder can be in any store. Null payloads count as empty, a
null url has no header line, line breaks in a url are escaped. Rows with a null id always carry their
payload. Repeated rows are records of their own; of several rows with the largest id each is a response.
An empty table gives no archive and an empty index.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import spread_join, text_of, written

MIN_SHARED = 1000
END = "\r\n\r\n"
#: Ranges closer than GAP are read at once, up to READ bytes or one record.
GAP, READ = 64 * 1024, 4 * 1024 * 1024
#: Up to so many revisits (about 60 bytes each) are broadcast to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Index rows of one archive are dealt out by stretches of so many bytes.
STRETCH = 16 * 1024 * 1024
INDEX = "archive string, offset bigint, length bigint, url string, digest string, type string"
RECORD = "id string, url string, type string, refers_to string, payload_bytes bigint, digest string, payload string"


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One column ``record``: header, empty line, payload, without the two line ends that close it."""
    page = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), text_of(payload).alias("payload"))
    page = page.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    large = page.select("id", "digest").filter((F.col("bytes") >= MIN_SHARED) & F.col("id").isNotNull())
    shared = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("other")).filter("other < refers_to")
    revisits = spread_join(large, shared.drop("other"), ["digest"]).filter("id < refers_to").distinct()
    revisits = written(revisits, "revisits")
    if revisits.count() <= BROADCAST_ROWS:  # then payloads aren't shuffled
        page = page.join(F.broadcast(revisits), ["id", "digest"], "left")
    else:
        page = spread_join(page, revisits, ["id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", name(F.col("id"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.coalesce(line("WARC-Refers-To", name(F.col("refers_to"))), F.lit("")),
        line("Content-Length", F.when(again, 0).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"))
    return page.select(F.concat(head, F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record per row; every part file of ``folder`` is an archive."""
    records(pages, id, url, payload).write.option("lineSep", END).text(folder)


def _open(archive: str):
    """The archive for reading at any offset; Spark writes file:/x where Arrow wants file:///x."""
    scheme, _, rest = archive.partition(":")
    if rest.startswith("/") and not rest.startswith("//"):
        archive = f"{scheme}://{rest}"
    store, path = fs.FileSystem.from_uri(archive)
    return store.open_input_file(path)


def _head(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode("utf-8").split("\r\n")[1:])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kind = {"string": pa.string(), "bigint": pa.int64()}
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            with _open(archive) as file:
                size, at, rows = file.size(), 0, []
                while at < size:
                    n, raw = 1024, b""
                    while b"\r\n\r\n" not in raw:
                        if at + len(raw) >= size:
                            raise ValueError(f"{archive}: no end of the header at {at}")
                        raw = file.read_at(min(n, size - at), at)
                        n *= 4
                    raw = raw[:raw.index(b"\r\n\r\n")]
                    head = _head(raw)
                    length = len(raw) + 4 + int(head["Content-Length"]) + 4
                    rows.append((archive, at, length, head.get("WARC-Target-URI"), head["WARC-Payload-Digest"][5:], head["WARC-Type"]))
                    at += length
                    if len(rows) == 10_000:
                        yield _rows(INDEX, rows)
                        rows = []
                yield _rows(INDEX, rows)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all archives of a folder, with columns INDEX; contents of the files are not listed."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.mapInArrow(_index, INDEX)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as runs to be read at once."""
    archive, run = None, []
    for batch in batches:
        for a, at, n in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if run and (a != archive or at - (run[-1][0] + run[-1][1]) > GAP or at + n - run[0][0] > READ):
                yield archive, run
                run = []
            archive = a
            run.append((at, n))
    if run:
        yield archive, run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the index rows given, with columns RECORD; the payload is null unless asked for."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for archive, run in _ranges(batches):
            if archive != path:
                if file:
                    file.close()
                path, file = archive, _open(archive)
            start, rows = run[0][0], []
            data = file.read_at(run[-1][0] + run[-1][1] - start, start)
            for at, n in run:
                raw = data[at - start:at - start + n]
                cut = raw.index(b"\r\n\r\n")
                head, body = _head(raw[:cut]), raw[cut + 4:-4]
                digest = head["WARC-Payload-Digest"][5:]
                if head["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{archive}: the payload at {at} doesn't match its digest")
                urn = lambda key: head[key][len("<urn:page:"):-1] if key in head else None
                rows.append((urn("WARC-Record-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], urn("WARC-Refers-To"),
                             int(head["X-Payload-Length"]), digest, body.decode("utf-8") if payloads else None))
            yield _rows(RECORD, rows)
        if file:
            file.close()

    place = index.select("archive", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return place.repartition(parts, "archive", "stretch").sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)
