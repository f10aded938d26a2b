"""BPE encoding with a trie of words, and decoding.

A text is cut at the vocabulary's added tokens, then into the pieces its pre-tokenizer would never join, and
those into words. Distinct words form a trie of bytes. A node stands for a prefix and has one state: the last token
of the prefix's own encoding. It follows from the nodes above. Token t ends the encoding of a prefix if t is a
suffix of it, t is what its own bytes encode to, and the last token u of what stands before it fits: no merge of the ranked
list would reach over the border of u and t. Exactly one suffix does. The trie is walked depth first, which is the sorted
order of its words: going from one word to the next, the states of the prefix they share stay and only those below are found,
so the encoding of a shared prefix is computed once and only the states of one path are held. A word's tokens are read
off backwards, from its end to where its last token begins, and so on.

Words are independent of each other, so nothing is shuffled: a task takes the new words of about ``CHUNK`` pieces
together as a trie, and remembers up to ``MAX_PIECES`` pieces with their ids; beyond that it begins anew. Texts are taken whole.

The vocabulary is the file of a public tokenizer, its path a parameter; it is read once and its tables are sent to the tasks, some
MB at any size of the corpus. Only what the file can mean here is taken (byte-level BPE, no normaliser, no prefix space);
other files are refused.

Null and empty texts have no tokens and decode to the empty text. Null ids and repeated rows each get their
own result. Ids outside the vocabulary are refused. Bytes that are no UTF-8 decode to U+FFFD. An empty table gives
an empty one; columns that are not named are not read.
"""
from __future__ import annotations

import gc
import json
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIECES = 250_000
MAX_PAIRS = 500_000
CHUNK, TOKENS = 100_000, 500_000
#: The words of byte-level BPE, and the place of a space before which nothing is ever joined.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BORDER = r" (?=\S)"
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def token_bytes(file: dict) -> dict[int, bytes]:
    """The bytes of every id of a vocabulary file, added tokens included."""
    letters, added = byte_letters(), {t["content"]: t["id"] for t in file["added_tokens"]}
    found = {i: bytes(map(letters.__getitem__, w)) for w, i in file["model"]["vocab"].items() if w not in added}
    return {**found, **{i: w.encode() for w, i in added.items()}}


class Vocabulary:
    """Tokens as bytes, merges by rank, and which tokens can stand side by side."""

    def __init__(self, source: str) -> None:
        self.source = source
        file = json.loads(source)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges")
                 and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                 and file.get("normalizer") is None and file.get("post_processor") is None
                 and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]))
        if not plain:
            raise ValueError("not a byte-level BPE vocabulary without normaliser, prefix space and template")
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of = token_bytes(file)
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in self.added.values()}
        self.longest = max(map(len, self.ids), default=0)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left part, right part
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank[a, b] = n
            self.made.setdefault(model["vocab"][left + right], (n, a, b))
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.fit: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.ids = {b: i for b, i in self.ids.items() if self.whole(i)}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the left (1) or right (2) edge while the token is built, and the rank at which it is merged away."""
        found = self._edges.get((token, side))
        if found is None:
            found, at = [(token, NEVER)], token
            while at in self.made:
                rank, at = self.made[at][0], self.made[at][side]
                found.append((at, rank))
            found.reverse()
            self._edges[token, side] = found
        return found

    def fits(self, u: int, t: int) -> bool:
        """Whether no merge reaches over the border of u and t, both of which are built on their own."""
        key = u << 32 | t
        known = self.fit.get(key)
        if known is None:
            left, right = self._edge(u, 2), self._edge(t, 1)
            i = j = 0
            while True:
                (a, until), (b, till) = left[i], right[j]
                rank = self.rank.get((a, b), NEVER)
                # of equal merges the left one comes first: it takes a away before, but b only after
                if rank < until and rank <= till and rank != NEVER:
                    known = False
                    break
                if until == till == NEVER:
                    known = True
                    break
                if until <= till:
                    i += 1
                else:
                    j += 1
            if len(self.fit) > MAX_PAIRS:
                self.fit.clear()
            self.fit[key] = known
        return known

    def whole(self, t: int) -> bool:
        """Whether the token is what its own bytes encode to."""
        known = self._whole.get(t)
        if known is None:
            if t not in self.made:
                known = len(self.bytes_of[t]) == 1
            else:
                rank, a, b = self.made[t]
                known = self.whole(a) and self.whole(b) and self._joined_at(a, b, rank)
            self._whole[t] = known
        return known

    def _joined_at(self, a: int, b: int, wanted: int) -> bool:
        """Whether the first merge over the border of a and b is that of the two themselves."""
        left, right = self._edge(a, 2), self._edge(b, 1)
        i = j = 0
        while True:
            (x, until), (y, till) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if until == till == NEVER:
                return rank == wanted
            if rank < until and rank <= till and rank != NEVER:
                return False
            if until <= till:
                i += 1
            else:
                j += 1


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """The ids of each word; the words come sorted, so that this walks their trie depth first.

    ``last`` and ``start`` are the states on the path from the root: the last token of each prefix, and
    the length of the prefix before that token.
    """
    ids, fit, longest = vocabulary.ids, vocabulary.fit, vocabulary.longest
    last, start, before = [-1], [0], b""
    for word in words:
        shared, end = 0, min(len(word), len(before))
        while shared < end and word[shared] == before[shared]:
            shared += 1
        del last[shared + 1:], start[shared + 1:]
        at = start[shared]
        for depth in range(shared + 1, len(word) + 1):
            # mostly a token begins where that of the prefix before does, or else is short
            token = ids.get(word[at:depth])
            if token is None or at and not fit.get(last[at] << 32 | token):
                for at in range(depth - 1, max(0, depth - longest) - 1, -1):
                    token = ids.get(word[at:depth])
                    if token is not None and (not at or vocabulary.fits(last[at], token)):
                        break
                else:
                    raise ValueError(f"no token for the byte {word[depth - 1]}")
            last.append(token)
            start.append(at)
        before, found, depth = word, [], len(word)
        while depth:
            found.append(last[depth])
            depth = start[depth]
        found.reverse()
        yield found


class Encoder:
    """Ids of texts. Pieces and words that were met before cost a look-up."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.word, self.border = regex.compile(WORD), re.compile(BORDER)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.splitter = None
        self._clear()

    def _clear(self) -> None:
        """Forget all pieces. The ids of piece n are ``flat[first[n]:first[n + 1]]``."""
        added = self.vocabulary.added
        self.known = {w: n for n, w in enumerate(added)}
        self.first, self.flat = array("q", range(len(added) + 1)), array("i", added.values())

    def pieces(self, text: str) -> list[str]:
        """Parts of the text that are encoded each on its own."""
        if self.special is None or not any(w in text for w in self.vocabulary.added):
            parts = [text]
        else:
            parts = self.special.split(text)
        found = []
        for part in parts:
            if part in self.vocabulary.added:
                found.append(part)
            elif part:
                first, *rest = self.border.split(part)
                if first:
                    found.append(first)
                found += [" " + x for x in rest]
        return found

    def _split(self, piece: str) -> list[str]:
        """Words of a piece. Which letters there are beyond ASCII depends on the version of Unicode: the tokenizer's own says."""
        if piece[0] == " ":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ".,;:!?" and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        if piece.isascii():
            return self.word.findall(piece)
        if self.splitter is None:
            from tokenizers import Tokenizer
            self.splitter = Tokenizer.from_str(self.vocabulary.source).pre_tokenizer
        return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]

    def _add(self, piece: str, ids: Iterable[int]) -> None:
        self.known[piece] = len(self.first) - 1
        self.flat.extend(ids)
        self.first.append(len(self.flat))

    def _learn(self, pieces: set[str]) -> None:
        """Words are pieces, too."""
        split = [(piece, self._split(piece)) for piece in pieces]
        coded = sorted((w.encode(), w) for w in {w for _, words in split for w in words}.difference(self.known))
        for (_, word), ids in zip(coded, encode_words([b for b, _ in coded], self.vocabulary)):
            self._add(word, ids)
        known, first = self.known, self.first
        for piece, words in split:
            if piece not in known:
                parts = [known[w] for w in words]
                self._add(piece, chain.from_iterable([self.flat[first[i]:first[i + 1]] for i in parts]))

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as pieces, one after the other, and where each text ends."""
        if len(self.known) > MAX_PIECES:
            self._clear()
        pieces = [p for t in texts for p in t]
        places = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(set(new))
            places[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        first, flat = np.array(self.first), np.array(self.flat)
        n = first[places + 1] - first[places]
        ends = np.cumsum(n)
        ids = flat[np.arange(int(n.sum())) + np.repeat(first[places] - (ends - n), n)]
        return ids, np.concatenate(([0], ends))[np.cumsum([len(t) for t in texts])]


def read_vocabulary(path: str) -> str:
    """The content of a vocabulary file, read where the job is planned."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) per row; ``vocabulary`` is the content of a vocabulary file."""
    # Read here: what can't be encoded is refused before a job starts, and no task reads the file again.
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(vocabulary)))
    fields = ["id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            if encode is None:
                gc.disable()
                encode = Encoder(pickle.loads(sent.value))
                gc.enable()
            column, held, begin, n = batch.column(1), [], 0, 0
            for i in range(batch.num_rows):
                held.append(encode.pieces(column[i].as_py() or ""))
                n += len(held[-1])
                if n >= CHUNK or i + 1 == batch.num_rows:
                    gc.disable()  # many small objects, no cycles among them
                    ids, ends = encode(held)
                    gc.enable()
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), pa.ListArray.from_arrays(offsets, pa.array(ids))], fields)
                    held, begin, n = [], i + 1, 0
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The table with the text behind ``ids`` in a column more; null ids count as none."""
    known = token_bytes(json.loads(vocabulary))
    sent = tokens.sparkSession.sparkContext.broadcast(pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.large_binary()))
    place = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(batch.column(place).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:  # about so many tokens at once
                before = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                part = batch.slice(begin, stop - begin)
                ids = part.column(place).flatten()
                outside = len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(table)
                words = None if outside else table.take(ids)
                if words is None or words.null_count:
                    raise ValueError("an id that the vocabulary does not have")
                cuts = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)[np.concatenate(([0], ends[begin:stop] - before))]
                joined = memoryview(words.buffers()[2] or b"")
                texts = [bytes(joined[a:b]).decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])
                begin = stop
    from pyspark.sql.types import StringType, StructType
    schema = StructType([*tokens.schema.fields]).add(text, StringType())
    return tokens.mapInArrow(run, schema)
