"""Secret scan through nested encodings.

Each text is the first layer of a worklist. A layer is searched for the three kinds of secrets, then
unwrapped: percent escapes, Unicode escapes and character references of the whole layer, every base64 run that holds text (UTF-8, or
ASCII as UTF-16) or a compressed stream (gzip, zlib, bzip2, xz, also one inside another, all members of one with several). Of a
run that is not text as a whole, every one of the four phases is decoded and searched for text of ``MIN_TEXT``
characters and for streams, so that what stands directly before or after doesn't matter; no secret is shorter.
Runs that go on over lines are also taken joined. What comes out is a layer more, until nothing new appears. A layer that repeats one of the same place is not taken again, which ends
cycles such as a compressed stream that contains itself. Every layer knows the piece of its parent each
character comes from, so a find in any depth is reported as a span of the original text.

A compressed stream is unpacked in blocks of ``BLOCK`` bytes that overlap by ``OVERLAP``, each a layer of its own, so memory
stays bounded and nothing is cut off; what one stream holds inside another goes through both, block by block. All that a
stream holds stands for the stream as a whole, so it doesn't matter in which block a secret is met. Escapes of the escape sign
itself, nested more than ``CHAIN`` times, are undone in one step. Null texts count as empty. Repeated
rows and null ids each get their own result; an empty table gives an empty one.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CHAIN = 4
PERCENT_UNIT = r"%%(?:(?:25){%d,})?[0-9A-Fa-f]{2}" % CHAIN
ESCAPE_UNIT = r"\\(?:(?:u005[Cc]|x5[Cc]|U0000005[Cc]){%d,})?(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})" % CHAIN
PERCENT = re.compile(f"(?:{PERCENT_UNIT})+")
ESCAPE = re.compile(f"(?:{ESCAPE_UNIT})+")
UNIT = re.compile(ESCAPE_UNIT)
ENTITY = re.compile(r"(?:&(?:(?:amp;){%d,})?(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos|colon|equals|lowbar|period|sol|plus|nbsp);)+" % CHAIN)
DEEP_AMP = re.compile(r"&(?:amp;){%d,}(?=[#a-z])" % CHAIN)
LAST = re.compile(r"(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})$")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
MIN_TEXT = 16
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}+" % MIN_TEXT)
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}|(?:\x00[\t\n\r\x20-\x7e]){%d,}" % (MIN_TEXT, MIN_TEXT))
STREAM = re.compile(rb"(?=\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00)")
MIN_VALUE = 12
STEP, BLOCK, OVERLAP = 1024 * 1024, 32 * 1024 * 1024, 1024 * 1024
EMPTY = hashlib.sha256().digest()
SCHEMA = ("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
          "n_spans bigint, n_layers bigint")
Span = tuple[int, int, int]  # start, kind, end: so that they sort as they are listed


def find(text: str) -> list[Span]:
    """Secrets in one layer: leftmost, not overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, for its pieces, where they start here and which part of the parent they stand for.

    step 0: one character each; step 3: base64, three characters for four; None: the piece as a whole.
    """

    def __init__(self, text: str, parent: Layer | None = None, pieces: list[tuple[int, int, int, int | None]] = ()):
        self.text, self.parent, self.pieces = text, parent, pieces
        self.starts = [p[0] for p in pieces]

    def _source(self, at: int) -> tuple[int, int]:
        here, start, end, step = self.pieces[bisect_right(self.starts, at) - 1]
        if step == 0:
            return start + at - here, start + at - here + 1
        if step == 3:
            group = start + (at - here) // 3 * 4
            return group, min(group + 4, end)
        return start, end

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text behind one of this layer."""
        layer = self
        while layer.parent is not None:
            start, end, layer = layer._source(start)[0], layer._source(end - 1)[1], layer.parent
        return start, end

    def over(self, pieces: list[tuple[int, int, int, int | None]]) -> tuple[Layer, list[tuple[int, int, int, int | None]]]:
        """The layer below this one and the pieces (steps 0 and None) in its places, so that layers that only replace
        don't pile up; this layer itself if it is the original."""
        if self.parent is None:
            return self, pieces
        found = []
        for here, start, end, step in pieces:
            if step is None:
                found.append((here, self._source(start)[0], self._source(end - 1)[1], None))
                continue
            k = bisect_right(self.starts, start) - 1
            while start < end:
                begin, a, b, how = self.pieces[k]
                stop = min(end, self.starts[k + 1]) if k + 1 < len(self.pieces) else end
                if how == 0:
                    found.append((here, a + start - begin, a + stop - begin, 0))
                else:
                    found.append((here, a, b, None) if how is None else (here, self._source(start)[0], b, 3))
                here, start, k = here + stop - start, stop, k + 1
        return self.parent, found


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """The layer with every match decoded; nothing if no match can be."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m.group())
        if not new:
            continue
        if m.start() > at:
            pieces.append((size, at, m.start(), 0))
            out.append(layer.text[at:m.start()])
            size += m.start() - at
        pieces.append((size, m.start(), m.end(), None))
        out.append(new)
        size += len(new)
        at = m.end()
    if pieces:
        pieces.append((size, at, len(layer.text), 0))
        out.append(layer.text[at:])
        yield Layer("".join(out), *layer.over(pieces))


def _percent(run: str) -> str:
    pairs = re.findall("%(?:25)*?([0-9A-Fa-f]{2})(?=%|$)", run)
    return bytes.fromhex("".join(pairs)).decode("utf-8", "replace")


def _escape(run: str) -> str | None:
    units = [int(LAST.search(m.group()).group()[1:], 16) for m in UNIT.finditer(run)]
    if max(units) > 0x10FFFF:
        return None
    joined = "".join(map(chr, units)).encode("utf-16-le", "surrogatepass")
    return joined.decode("utf-16-le", "replace")


def _entity(run: str) -> str:
    return html.unescape(DEEP_AMP.sub("&", run))


#: How a stream of each kind begins, and what unpacks it.
STREAMS = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78\x01", lambda: zlib.decompressobj()),
           (b"\x78\x5e", lambda: zlib.decompressobj()), (b"\x78\x9c", lambda: zlib.decompressobj()),
           (b"\x78\xda", lambda: zlib.decompressobj()), (b"BZh", bz2.BZ2Decompressor),
           (b"\xfd7zXZ\x00", lzma.LZMADecompressor))


def _member(stream, data: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What one member holds, in pieces of STEP bytes at most."""
    while data is not None:
        out = stream.decompress(data, STEP)
        if out:
            yield out
        if stream.eof:
            return
        if hasattr(stream, "needs_input"):
            data = next(chunks, None) if stream.needs_input else b""
        else:
            data = stream.unconsumed_tail or (b"" if len(out) == STEP else next(chunks, None))


def unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked bytes of all members of a stream, piece by piece; nothing if it is none. A damaged one ends early."""
    held = b""
    while True:
        while len(held) < 6 and (more := next(chunks, None)) is not None:
            held += more
        make = next((make for start, make in STREAMS if held.startswith(start)), None)
        if make is None:
            return
        stream = make()
        try:
            yield from _member(stream, held, chunks)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        if not stream.eof:
            return
        held = stream.unused_data.lstrip(b"\0")


def _chunks(data: memoryview) -> Iterator[bytes]:
    """The bytes in chunks that grow, as most of what looks like a stream is none."""
    at, size = 0, 512
    while at < len(data):
        yield bytes(data[at:at + size])
        at, size = at + size, min(2 * size, STEP)


def blocks(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks put together to blocks of BLOCK bytes or the rest, each beginning with the end of the one before."""
    held, n, before = [], 0, 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        if n >= BLOCK:
            block = b"".join(held)
            yield block
            held, n = [block[-OVERLAP:]], OVERLAP
            before = OVERLAP
    if n > before:
        yield b"".join(held)


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\n\r" for c in text) else None


def _bytes(run: str) -> bytes:
    if len(run) % 4 == 1:
        run = run[:-1]
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


def _unpacked(data: memoryview, layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """The layers of the stream that begins the data and of every one inside it."""
    met, depth = set(), 1
    while True:
        stream, digest = _chunks(data), hashlib.sha256()
        for _ in range(depth):
            stream = unpacked(stream)
        for block in blocks(stream):
            digest.update(block)
            try:
                text = block.decode("utf-8")
            except UnicodeDecodeError:
                text = block.decode("latin-1")
            yield Layer(text, layer, [(0, start, end, None)])
        if digest.digest() in met or digest.digest() == EMPTY:
            return
        met.add(digest.digest())
        depth += 1


def _run(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """The layers of one base64 run."""
    run = layer.text[start:end].rstrip("=")
    for phase in range(4):
        try:
            data = _bytes(run[phase:])
        except binascii.Error:
            continue
        if phase == 0 and (text := _readable(data)) is not None and next(unpacked(iter([data])), None) is None:
            yield Layer(text, layer, [(0, start, end, 3 if text.isascii() else None)])
            return
        at = start + phase
        places = lambda m: (at + m.start() // 3 * 4, min(at + (m.end() + 2) // 3 * 4, end))
        for m in READABLE.finditer(data):
            text = m.group().decode("utf-8", "replace")
            yield Layer(text, layer, [(-(m.start() % 3), *places(m), 3) if text.isascii() else (0, *places(m), None)])
        for m in WIDE.finditer(data):
            yield Layer(m.group().replace(b"\0", b"").decode("ascii"), layer, [(0, *places(m), None)])
        for m in STREAM.finditer(data):
            yield from _unpacked(memoryview(data)[m.start():], layer, at + m.start() // 3 * 4, end)


def _base64(layer: Layer) -> Iterator[Layer]:
    """A layer for all that base64 runs hold, text or a compressed stream."""
    for m in BASE64.finditer(layer.text):
        yield from _run(layer, m.start(), m.end())
    for m in WRAPPED.finditer(layer.text) if "\n" in layer.text else ():
        pieces, size, lines = [], 0, []
        for line in RUN.finditer(layer.text, m.start(), m.end()):
            pieces.append((size, line.start(), line.end(), 0))
            lines.append(line.group())
            size += len(lines[-1])
        yield from _run(Layer("".join(lines), layer, pieces), 0, size)


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """Spans in the text itself, all spans, number of layers."""
    base = find(text)
    spans, seen, work, n = set(base), set(), [Layer(text)], 0
    while work:
        layer = work.pop()
        n += 1
        if layer.parent is not None:
            for start, kind, end in find(layer.text):
                start, end = layer.span(start, end)
                spans.add((start, kind, end))
        for child in _children(layer):
            key = (hashlib.sha256(child.text.encode("utf-8", "surrogatepass")).digest(), *child.span(0, len(child.text)))
            if key not in seen:
                seen.add(key)
                work.append(child)
    return base, sorted(spans), n


def _children(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _replaced(layer, PERCENT, _percent)
    if "\\" in layer.text:
        yield from _replaced(layer, ESCAPE, _escape)
    if "&" in layer.text:
        yield from _replaced(layer, ENTITY, _entity)
    yield from _base64(layer)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, *SCHEMA) per row; spans count code points, the end is exclusive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans, layers = scan(t.as_py() or "")
                rows.append((*[sum(s[1] == k for s in base) for k in range(3)],
                             hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), len(spans), layers))
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], ["id"] + [n for n, _ in fields])
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")


def redacted(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by the name of its first kind."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; null texts and other columns stay as they are."""
    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)
    return docs.withColumn(text, replace(F.col(text)))
