"""BPE, hard negatives and ranked search against the library and brute force: nulls, ties, repeats, empty tables."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docaudit.llm import bpe, negatives, search

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, id string, ids int"


# BPE

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["the", "ing", "Ingress", "über", "日本語", "123", "x=", "'re", "don't", "</div>", "<|endoftext|>", "<|endoftext", " ", "  ", "\n", "\t \n", "\x1c", "\x85", " ", "é", "é", "🙂"]
    for k in range(n):
        if k % 3:
            yield "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 40)))
        else:
            points = (rng.choice([rng.randrange(0x80), rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 32]) for _ in range(rng.randint(0, 60)))
            yield "".join(map(chr, points))


def test_ids_equal_those_of_the_library(library, vocabulary):
    encode = bpe.Encoder(vocabulary)
    texts = [*odd_texts(1500), *("ab" * 4000, "=" * 5000, "a" * 2999, " " * 70, "\n" * 33)]
    ids, ends = encode([encode.pieces(t) for t in texts])
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_pieces_changes_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    encode = bpe.Encoder(vocabulary)
    for text in odd_texts(200, 6):
        assert encode([encode.pieces(text)])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefixes_are_encoded_once(vocabulary):
    asked = []
    class Seen(dict):
        def get(self, key, *rest):
            asked.append(key)
            return dict.get(self, key, *rest)
    plain = vocabulary.ids
    vocabulary.ids = Seen(plain)
    try:
        words = sorted([b" international", b" internationals", b" internationally"])
        list(bpe.encode_words(words[:1], vocabulary))
        one = len(asked)
        list(bpe.encode_words(words, vocabulary))
        assert len(asked) < 2 * one + 60  # three walks of their own would ask for three times as many
    finally:
        vocabulary.ids = plain


def test_tokens_of_a_table_go_there_and_back(spark, library):
    source = bpe.read_vocabulary(PATH)
    rows = [(1, None), (2, ""), (None, "null id"), (1, "again  and\tagain"), (3, "naïve \x00 é\n" * 5000), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)
    got = bpe.decoded(bpe.encoded(docs, source), source).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.decoded(bpe.encoded(docs.filter("false"), source), source).collect() == []
    other = spark.createDataFrame([([65, 129],), (None,), ([],), ([50256],)], "ids array<int>")  # a byte that starts nothing
    assert [r.text for r in bpe.decoded(other, source).collect()] == [library.decode([65, 129], skip_special_tokens=False), "", "", "<|endoftext|>"]


def test_other_vocabularies_and_ids_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    with pytest.raises(Exception, match="does not have"):
        bpe.decoded(spark.createDataFrame([([60_000],)], "ids array<int>"), bpe.read_vocabulary(PATH)).collect()


# hard negatives

def brute_negatives(rows, step):
    taken = [(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows
             if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for a, ya, va in {r for r in taken if r[0] % step == 0}:
        scored = [(-sum(map(int.__mul__, va, v)), i, y) for i, y, v in taken if i != a and len(v) == len(va)]
        for p, pid, _ in sorted(s for s in scored if s[2] == ya)[:5]:
            window = sorted(s for s in scored if s[2] != ya and 30 * -p <= 100 * -s[0] <= 90 * -p)
            found |= {(a, pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(window[:10])}
    return found


@pytest.mark.parametrize("block, bucket", [(1 << 20, 1024), (600, 16), (8, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "LEAST", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] * rng.choice([0.1, 1, 3]) + 0.4 * rng.normal(size=8)], i % 4 if rng.random() < 0.8 else 1) for i in range(400)]
    rows += [(500 + i, [0.5] * 8, i % 2) for i in range(30)] + [(600, [0.0] * 8, 0), (610, [0.0] * 8, 0), (611, [0.0] * 8, 1)]
    rows += [(700, [1.0, 2.0], 0), (701, [1.0, 2.0], 0), (702, [0.5, 1.0], 1), (710, [1e-9, -3.0], 1)]
    rows += [(None, [1.0] * 8, 0), (720, None, 0), (730, [1.0] * 7 + [None], 0), (740, [math.nan] * 8, 0), (750, [math.inf] + [0.0] * 7, 1), (760, [1.0] * 8, None), (770, [], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, id int, mark int")
    got = negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block, group=block).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_negatives(rows, 10)


def test_repeated_anchors_count_once_and_no_table_gives_no_rows(spark):
    rows = [(0, [1.0, 0.0], 0)] * 3 + [(1, [1.0, 0.1], 0)] + [(2, [0.5, 0.5], 1)] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") == 0).collect())
    assert [r[:4] for r in got] == [(0, 1, 1, 2), (0, 1, 2, 2)]
    for none in (df.filter("false"), df.filter("label = 0"), df.filter("vec_id > 0")):
        assert negatives.hard_negatives(none, F.col("id") == 0).count() == 0


def test_pruning_keeps_all_rows_over_the_threshold_and_drops_others():
    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.normal(size=(2000, 6)))
    dropped = 0
    for bucket in negatives.buckets_of(v, 250):
        for _ in range(40):
            anchor = np.floor(256 * rng.normal(size=6))
            score = bucket.v @ anchor
            threshold = float(np.quantile(score, 1 - rng.random() ** 4))
            places = bucket.candidates(anchor, float(np.sqrt(anchor @ anchor)), threshold)
            if places is not None:
                assert set(np.flatnonzero(score >= threshold)) <= set(places.tolist())
                dropped += len(score) - len(places)
    assert dropped > 20_000


# ranked search

def brute_ranking(docs, items, top=10):
    terms = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(search.TERM, t or "")]
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    found = []
    for item, words in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        found += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return found


@pytest.mark.parametrize("pairs, slab, bits", [(200_000, 8192, 22), (30, 7, 6)])
def test_ranking_equals_brute_force(spark, monkeypatch, pairs, slab, bits):
    monkeypatch.setattr(search, "SLAB", slab)
    monkeypatch.setattr(search, "FIRST", 3)
    rng = random.Random(8)
    words = [*"Alpha beta gamma Ünder ÜNDER z9 9 naïve".split(), *(f"w{k}" for k in range(120))]
    text = lambda n: " ".join(rng.choice(words[:rng.choice([8, 30, 128])]) + rng.choice(["", ",", ".\n", "\x7f", "_"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(150)] + [(200 + i, "alpha beta alpha") for i in range(30)]
    docs += [(300, None), (301, ""), (302, " -- ,"), (303, text(30_000)), (5, text(20)), (None, "alpha w1 w2"), (305, "w1"), (305, "w1")]
    items = [(i, text(rng.randint(1, 15))) for i in range(20)] + [(50, " ".join(words)), (51, None), (52, ""), (53, "unknown"), (None, "alpha"), (54, "w1"), (54, "w2 w1"), (55, "beta"), (55, "beta")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, n int, terms int").repartition(3)
    of = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in search.ranked(df, of, pairs=pairs, bits=bits).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(brute_ranking(docs, items), key=key)


def test_searches_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    assert [tuple(r)[:3] for r in search.ranked(docs, items).collect()] == [("x", 1, 1)]
    for d, i in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.select("doc_id", F.lit("..").alias("text")), items)):
        assert search.ranked(d, i).count() == 0


def test_groups_below_the_bound_are_not_scored(monkeypatch):
    scored = []
    plain = search.Slab.scores
    monkeypatch.setattr(search.Slab, "scores", lambda self, docs, *rest: scored.append(len(docs)) or plain(self, docs, *rest))
    import pyarrow as pa
    terms = pa.array([["a", "b"]] * 20 + [["b"]] * 5000)
    slab = search.Slab(np.full(5020, 2), terms, pa.array([[1, 1]] * 20 + [[1]] * 5000), 5020, 10_040)
    found, scores = slab.best(["a", "b"], [5000, 10], np.arange(5020), 10)
    assert found.tolist() == list(range(10)) and sum(scored) == 20


def test_tasks_do_not_read_the_vocabulary_again(spark, monkeypatch):
    from docaudit.llm import bpe
    import public_tokenizers
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, f"text {i} of eight") for i in range(8)], "doc_id long, text string").repartition(4)
    encoded = bpe.encoded(docs, vocabulary)

    def refuse(*_):
        raise AssertionError("read in a task")
    monkeypatch.setattr(bpe.Vocabulary, "__init__", refuse)  # travels to the tasks with the code
    texts = bpe.decoded(encoded, vocabulary)
    monkeypatch.setattr(bpe, "token_bytes", refuse)
    assert {r["id"]: r["text"] for r in texts.collect()} == {i: f"text {i} of eight" for i in range(8)}
