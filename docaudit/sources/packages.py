"""Document packages: directory checks, shredding into element rows, writing.

Shredding is the only step that reads bytes. It runs where a package is read, streams each
part through an XML parser and emits rows; everything after it is DataFrame code. A package
has a format bound (512 MiB decompressed), so its own rows are a bounded group.
"""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.session import cut_lineage

ELEMENTS = ("doc_id {id}, part string, kind string, eid int, tag string, "
            "attrs map<string,string>, open_seq int, close_seq int, text string, "
            "in_fallback boolean, p_eid int, tbl_eid int, tr_eid int, frame_eid int, "
            "anchor_eid int, link_eid int, in_pic boolean, in_title boolean, p_path array<int>")
_COLUMNS = [c.split()[0] for c in ELEMENTS.replace("map<string,string>", "map").split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
          "map": pa.map_(pa.string(), pa.string())}
_TYPES = [_ARROW[c.split()[1]] for c in ELEMENTS.replace("map<string,string>", "map").split(", ")[1:]]
_KEPT = {"w:p", "w:tbl", "w:tr", "w:tblHeader", "w:outlineLvl", "w:pStyle", "w:hyperlink", "w:lang",
         "wp:inline", "wp:anchor", "wp:docPr", "v:shape", "v:imagedata", "pic:pic", "pic:cNvPr",
         "a:blip", "dc:title", "rel:Relationship"}


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content) of every file; one over the limit has no content and is refused for its size."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.docx")
             .option("recursiveFileLookup", "true").load(folder))
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("doc_id")
    large = files.filter(F.col("length") > C.MAX_PACKAGE_BYTES).select(name, F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= C.MAX_PACKAGE_BYTES).select(name, "content").union(large)


# --------------------------------------------------------------------- batches
#: Rows, and bytes of packages, that a Python worker gathers before it hands them on.
BATCH_ROWS, BATCH_BYTES = 2_000, 1 << 20
#: Of a part that is read at once.
BLOCK_BYTES = 1 << 18
#: Characters below which a part is written as it is: to compress it costs more than it saves.
SMALL_PART = 1_000


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one by one; no more than one of them is a Python object at a time."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _as_batch(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)


# ------------------------------------------------------------------ type check
_ENTRIES = "doc_id {id}, name string, size bigint, status string"


def package_entries(packages: DataFrame, files: bool = False) -> DataFrame:
    """One row per zip entry with its decompressed size, counted from the stream.

    A package that is no zip, or a broken one, is one row with that status. Reading stops
    past the limits, which is enough to know that they are passed. With ``files`` each package has a row
    of status ``file``, too.
    """
    limit, most = C.MAX_PACKAGE_BYTES, C.MAX_ENTRIES

    def listing(content: bytes | None) -> Iterator[tuple]:
        if content is None:  # left unread for its size
            yield None, limit + 1, "ok"
            return
        if content[:2] != b"PK":
            yield None, 0, "no_zip"
            return
        read = 0
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as package:
                for number, entry in enumerate(package.infolist()):
                    size = 0
                    with package.open(entry) as stream:
                        while read <= limit and (block := stream.read(1 << 20)):
                            size += len(block)
                            read += len(block)
                            if len(block) < 1 << 20:  # the end: the checksum was compared
                                break
                    yield entry.filename, size, "ok"
                    if number > most or read > limit:
                        return
        except Exception:  # any way in which the archive is broken
            yield None, 0, "corrupt"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.string()]
            rows: list[tuple] = []
            for doc, content in each(batch):
                for row in chain(first, listing(content)):
                    rows.append((doc, *row))
                    if len(rows) >= most_rows:
                        yield as_batch(rows, names, kinds)
                        rows = []
            if rows:
                yield as_batch(rows, names, kinds)
            del batch  # before the next one is read
    first = [(None, None, "file")] if files else []
    names, each, as_batch, most_rows = ["doc_id", "name", "size", "status"], _each, _as_batch, BATCH_ROWS
    kind = dict(packages.dtypes)["doc_id"]
    return packages.select("doc_id", "content").mapInArrow(run, _ENTRIES.format(id=kind))


def package_reasons(packages: DataFrame) -> DataFrame:
    """(doc_id, reason): why a file is not a document package; NULL when it is one."""
    has = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False))
    # Every file is a row of its own among its entries: the packages are read, or made, only once.
    facts = package_entries(packages, True).groupBy("doc_id").agg(
        F.count_if(F.col("status") == "file").alias("files"), F.count_if(F.col("status") != "file").alias("found"),
        F.count("name").alias("entries"), F.sum("size").alias("bytes"),
        F.bool_or(F.col("status") == "no_zip").alias("no_zip"),
        F.bool_or(F.col("status") == "corrupt").alias("corrupt"),
        has("[Content_Types].xml").alias("types"), has(C.DOCUMENT_PART).alias("main"))
    reason = (
        F.when(F.col("no_zip"), "conteudo nao e um pacote zip (assinatura PK ausente)")
        .when(F.col("entries") > C.MAX_ENTRIES, f"pacote com entradas demais (limite {C.MAX_ENTRIES})")
        .when(F.col("bytes") > C.MAX_PACKAGE_BYTES, "conteudo descomprimido excede o limite permitido")
        .when(F.col("corrupt"), "pacote zip corrompido")
        .when(~F.col("types"), "pacote sem [Content_Types].xml: nao e OOXML")
        .when(~F.col("main"), "pacote sem word/document.xml: nao e WordprocessingML (DOCX)"))
    of = F.when(F.col("doc_id").isNull() | (F.col("found") == 0), "pacote sem [Content_Types].xml: nao e OOXML").otherwise(reason)
    # Files of one id are judged together, and each of them is a row.
    return facts.select("doc_id", of.alias("reason"), F.explode(F.sequence(F.lit(1).cast("bigint"), "files")).alias("file")).drop("file")


# -------------------------------------------------------------------- shredding
class _Tags(dict):
    """Names as the parser gives them to prefixed ones; each is taken apart once."""

    def __init__(self, names: dict, most: int = 10_000) -> None:
        super().__init__()
        self.names, self.most = names, most

    def __missing__(self, name: str) -> str:
        if len(self) >= self.most:  # made-up names of many packages
            self.clear()
        space, _, local = name.rpartition(" ")
        tag = self[name] = f"{self.names.get(space, '?')}:{local}" if space else local
        return tag


class _Part:
    """Rows of one part, in order of closing; a text is a row of its own."""

    def __init__(self, doc, name: str, tags: _Tags) -> None:
        self.doc, self.name, self.tags, self.rows, self.seq = doc, name, tags, [], 0
        self.stack: list[list] = []
        self.fallback = 0
        self.title = False
        # Innermost open element of each kind; the scopes of rows end at a table.
        self.open = {"p": [], "tbl": [], "tr": [], "frame": [], "anchor": [], "link": [], "pic": []}
        self.around = None  # the context, until something that it names opens or closes

    def _last(self, kind: str):
        return self.open[kind][-1][3] if self.open[kind] else None

    def _context(self) -> tuple:
        if self.around is None:
            row = self.open["tr"][-1] if self.open["tr"] else None
            in_row = row is not None and (not self.open["tbl"] or row[3] > self.open["tbl"][-1][3])
            self.around = (self.fallback > 0, self._last("p"), self._last("tbl"), row[3] if in_row else None,
                           self._last("frame"), self._last("anchor"), self._last("link"),
                           bool(self.open["pic"]), self.title)
        return self.around

    def start(self, name: str, attrs: dict) -> None:
        self.seq += 1
        tag, stack = self.tags[name], self.stack
        if stack:
            stack[-1][4] = True
        if tag not in _KEPT:  # no row of its own
            if tag == "mc:Fallback":
                self.fallback += 1
                self.around = None
            stack.append([tag, None, None, self.seq, False])
            return
        given = {self.tags[k]: v for k, v in attrs.items()}
        node = [tag, given, self._context(), self.seq, False]
        stack.append(node)
        if tag == "dc:title":
            self.title, self.around = True, None
        elif tag == "wp:docPr":
            self._offer("anchor", "docPr", given)
        elif tag == "pic:cNvPr":
            self._offer("pic", "cNvPr", given)
        if tag in _KINDS:
            self.around = None
            for kind in _KINDS[tag]:
                self.open[kind].append(node)

    def _offer(self, kind: str, prefix: str, given: dict) -> None:
        """Every open holder without one remembers the first such element below it."""
        for holder in self.open[kind]:
            if f"{prefix}@" not in holder[1]:
                holder[1][f"{prefix}@"] = ""
                holder[1].update({f"{prefix}@{k}": v for k, v in given.items()})

    def end(self, name: str) -> None:
        tag, given, context, opened, _ = self.stack.pop()
        self.seq += 1
        if self.title:
            self.title, self.around = False, None
        if given is None:
            if tag == "mc:Fallback":
                self.fallback -= 1
                self.around = None
            return
        if tag in _KINDS:
            self.around = None
            for kind in _KINDS[tag]:
                self.open[kind].pop()
        self.rows.append((self.doc, self.name, "element", opened, tag, list(given.items()), opened, self.seq, None, *context, None))

    def text(self, data: str) -> None:
        if not (self.open["p"] or self.open["link"] or self.title):
            return
        self.seq += 1
        node = self.stack[-1]
        path = [n[3] for n in self.open["p"]] if node[0] == "w:t" and not node[4] else None
        self.rows.append((self.doc, self.name, "text", None, node[0], None, self.seq, self.seq, data, *self._context(), path))


#: What a tag opens; all of them are kept.
_KINDS = {"w:p": ("p",), "w:tbl": ("tbl",), "w:tr": ("tr",), "w:hyperlink": ("link",),
          "wp:inline": ("frame", "anchor"), "wp:anchor": ("frame", "anchor"),
          "v:shape": ("frame",), "pic:pic": ("pic",)}


def _parser(part=None):
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def refuse(*_):
        raise expat.ExpatError("document type declarations are not read")
    parser.StartDoctypeDeclHandler = refuse
    if part is not None:
        parser.StartElementHandler, parser.EndElementHandler = part.start, part.end
        parser.CharacterDataHandler = part.text
    return parser


def shred(packages: DataFrame, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(elements, parts) of (doc_id, content) packages.

    A part of less than a block is parsed once, and its rows are dropped if it is not well-formed. A larger one is parsed
    twice in a stream: once to know that it is well-formed, once to emit its rows, so neither a large part nor a late error
    is ever held in memory.
    """
    names, limit, most_bytes = C.NS, C.MAX_PART_BYTES, BLOCK_BYTES
    config, silent = set(C.CONFIG_PARTS), C.COMMENT_PARTS_WITHOUT_TEXT
    exact = {C.STYLES_PART, C.PROPERTIES_PART}

    def wanted(name: str) -> bool:
        if name in exact or (name.startswith("word/_rels/") and name.endswith(".rels")):
            return True
        base = name.removeprefix("word/")
        return (name.startswith("word/") and name.endswith(".xml") and "/" not in base
                and base not in config and not base.startswith(silent))

    def blocks(stream) -> Iterator[bytes]:
        while block := stream.read(most_bytes):
            yield block

    def rows_of(doc, content: bytes, tags: _Tags) -> Iterator[list]:
        empty = [None] * 14
        try:
            package = zipfile.ZipFile(io.BytesIO(content))
        except Exception:  # not a zip: the document has no readable part
            yield [(doc, None, "part", None, "unreadable", *empty)]
            return
        with package:
            for name in sorted(filter(wanted, set(package.namelist()))):
                size, status, part = 0, "ok", None
                try:
                    with package.open(name) as stream:
                        first = stream.read(most_bytes)
                        size = len(first)
                        if size < most_bytes:  # the whole part
                            part = _Part(doc, name, tags)
                        check = _parser(part)
                        check.Parse(first)
                        if size == most_bytes:
                            for block in blocks(stream):
                                size += len(block)
                                check.Parse(block)
                        check.Parse(b"", True)
                except Exception:  # broken compression or markup
                    status = "unreadable"
                if status == "ok":
                    if part is None:
                        part = _Part(doc, name, tags)
                        parser = _parser(part)
                        with package.open(name) as stream:
                            for block in blocks(stream):
                                parser.Parse(block)
                                yield part.rows
                                part.rows = []
                        parser.Parse(b"", True)
                    yield part.rows
                    status = "too_large" if size > limit else "ok"
                yield [(doc, name, "part", None, status, *empty)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = _Tags(names)
        for batch in batches:
            kinds = [batch.schema.field(0).type, *types]
            rows: list[tuple] = []
            for doc, content in each(batch):
                for some in rows_of(doc, content, tags):
                    rows += some
                    if len(rows) >= most_rows:
                        for i in range(0, len(rows), most_rows):
                            yield as_batch(rows[i:i + most_rows], columns, kinds)
                        rows = []
            if rows:
                yield as_batch(rows, columns, kinds)
            del batch  # before the next one is read

    columns, types, each, as_batch, most_rows = list(_COLUMNS), list(_TYPES), _each, _as_batch, BATCH_ROWS
    kind = dict(packages.dtypes)["doc_id"]
    read = packages.filter("content IS NOT NULL").select("doc_id", "content")
    rows = read.mapInArrow(run, ELEMENTS.format(id=kind))
    if materialize:
        rows = cut_lineage(rows)
    parts = rows.filter("kind = 'part'").select("doc_id", "part", F.col("tag").alias("status"))
    return rows.filter("kind <> 'part'"), parts


# ---------------------------------------------------------------------- writing
def write_packages(parts: DataFrame) -> DataFrame:
    """(doc_id, parts: array of (name, xml)) to (doc_id, content): one zip per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.binary()]
            rows, size = [], 0
            for doc, entries in each(batch):
                target = io.BytesIO()
                with zipfile.ZipFile(target, "w") as package:
                    for entry in entries:
                        if entry["xml"] is not None:
                            kind = zipfile.ZIP_DEFLATED if len(entry["xml"]) >= small else zipfile.ZIP_STORED
                            package.writestr(zipfile.ZipInfo(entry["name"]), entry["xml"], kind, 1)
                rows.append((doc, target.getvalue()))
                size += len(rows[-1][1])
                if len(rows) >= 256 or size >= most_bytes:
                    yield as_batch(rows, names, kinds)
                    rows, size = [], 0
            if rows:
                yield as_batch(rows, names, kinds)
            del batch  # before the next one is read
    names, each, as_batch, most_bytes, small = ["doc_id", "content"], _each, _as_batch, BATCH_BYTES, SMALL_PART
    kind = dict(parts.dtypes)["doc_id"]
    return parts.mapInArrow(run, f"doc_id {kind}, content binary")


def xml_text(c: Column) -> Column:
    """Text that XML can carry: no control characters, markup escaped."""
    text = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
