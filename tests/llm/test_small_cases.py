"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docaudit.llm import decontaminate, lines, machine, mixing, pii, repeats, secrets, simhash, urls, warc
from docaudit.llm.components import components
from docaudit.llm.features import Extractor
from docaudit.session import new_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


# lines

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered))


LINE_CASES = [None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 40, "l1 w\nl1 w\n\nl1 w", prose(1, 40) + "\n" + prose(1, 40),
              "a\u00a0b\u2003c d", "naïve | a | b | c | d\nsome other words here", prose(2, 30_000), "!!! ### $$$\n" + prose(3, 12), "\x0b\x0c\r a"]


def test_line_counts_equal_a_plain_count(spark):
    judged = lines.line_first(docs_of(spark, LINE_CASES)).select("doc_id", "quality.*").collect()
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(LINE_CASES[r.doc_id]), r.doc_id
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_failing_lines_go_and_heavy_losses_reject(spark):
    good = prose(4, 30)
    texts = [good + "\nhome | news | shop | about us | help", "home | news | shop | about us | help\n" * 2 + prose(5, 9), good + "\n" + good]
    rows = lines.line_first(docs_of(spark, texts)).select("quality.*").collect()
    assert rows[0].kept and rows[0].cleaned == good and rows[0].n_lines_removed == 1
    assert not rows[1].kept and not rows[2].kept


def test_clashing_columns_stay_and_filters_are_not_repeated(spark):
    docs = docs_of(spark, [prose(6, 20)]).withColumn("quality", F.lit(7)).withColumn("__w", F.lit("mine"))
    out = lines.line_first(docs)
    assert out.columns == [*docs.columns, "quality_"] and out.first()["__w"] == "mine"
    assert out.filter("quality_.kept").count() == 1
    plan = out.filter("quality_.kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert lines.line_first(docs.limit(0)).count() == 0


# SimHash

def test_fingerprint_equals_its_definition():
    for text in [None, "", "One", "one TWO", prose(7, 50), "a a a a a", "É é ß " * 9]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint((text or "").encode()) & (1 << 64) - 1 == want


def brute_links(fp, radius=3):
    parent = list(range(len(fp)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("chunk", [2048, 16])
def test_links_of_a_dense_ball_lose_nothing(spark, chunk):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(120):
            x = int(c)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.near_links(table, chunk), "a", "b").collect()}
    want = brute_links(fp)
    name = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(want, name))) == len(set(want)) == len(set(name))


def test_tree_search_follows_edges_and_finds_all():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    root, keys, nodes = simhash.grow(fp, np.zeros(len(fp), np.int64))
    assert set(zip(keys // 65, nodes)) and len(keys) == len(fp) - 1
    found = set()
    for a, b in simhash.search(fp, np.arange(len(fp)), root, keys, nodes, 2):
        found |= set(zip(a.tolist(), b.tolist()))
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and bin(int(fp[i] ^ fp[j])).count("1") <= 2}


def test_duplicates_nulls_and_empties(spark):
    a = prose(8, 60)
    docs = docs_of(spark, [a, "", None, a, prose(9, 60), a.upper()]).union(spark.createDataFrame([(None, a, None, None, None), (3, a, "x", "y", 1)], DOCS))
    rows = simhash.near_duplicates(docs).collect()
    by = {(r.id, r.fp): r.component for r in rows}
    assert len(rows) == 8 and {c for (i, _), c in by.items() if i in (0, 3, 5, None)} == {0}
    assert {c for (i, _), c in by.items() if i in (1, 2)} == {1} and by[4, next(f for i, f in by if i == 4)] == 4
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 0), (True, 1), (True, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b = prose(50, 60), prose(51, 60)
    rows = [(3, a), (5, a), (5, b), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__mark", F.lit("mine"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, a), (5, b)]


def test_components_of_a_long_path_and_none(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(path, "a", "b").collect()} == {(i, 0) for i in range(201)}
    assert components(path.limit(0), "a", "b").count() == 0


# repeats

def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(raw[s:s + length])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out[id] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [None, 1])
def test_repeats_equal_brute_force(spark, crowd):
    a, b, c = prose(10, 80), prose(11, 60), prose(12, 25)
    texts = [a, None, "", a, b + c + a[50:220], c + "é" * 90 + b, "ab" * 400, "x" * 99, "x" * 100, "x" * 350, a[:99], a[:100], a[37:138] + "!" + b[-101:],
             *[prose(20 + i, 15) + c + prose(60 + i, 12) for i in range(12)], "zq" * 300 + a]
    got = {r.id: tuple(r)[1:5] for r in repeats.without_repeats(docs_of(spark, texts), crowd=crowd).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_across_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1500)
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    a = prose(13, 900)
    texts = [a, prose(14, 30) + a[700:3100] + prose(15, 40), a[2000:] + a[:2000], prose(16, 700)]
    got = {r.id: tuple(r)[1:5] for r in repeats.without_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_with_null_and_repeated_ids(spark):
    a = prose(17, 60)
    docs = spark.createDataFrame([(None, a), (5, a), (5, a), (2, a + "tail")], "doc_id bigint, text string")
    rows = sorted((r.id is not None, r.id or 0, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert rows == [(False, 0, 0), (True, 2, len(a)), (True, 5, len(a)), (True, 5, len(a))]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_interval_expansion_finds_shared_prefixes():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 3, 3000).astype(np.uint8)
    text[::701] = 0
    at, group = repeats.shared_prefixes(text, 9)
    want = Counter(bytes(text[i:i + 9]) for i in range(len(text) - 8) if 0 not in text[i:i + 9])
    assert sorted(at.tolist()) == [i for i in range(len(text) - 8) if 0 not in text[i:i + 9] and want[bytes(text[i:i + 9])] > 1]
    assert len({(g, bytes(text[i:i + 9])) for i, g in zip(at.tolist(), group.tolist())}) == len(set(group.tolist()))


# secrets

KEY = "password=Sup3rSecretValue99"


def nested():
    b64 = base64.b64encode(KEY.encode()).decode()
    packed = base64.b64encode(gzip.compress(KEY.encode())).decode()
    twice = base64.b64encode(zlib.compress(gzip.compress(KEY.encode()))).decode()
    inner = base64.b64encode(("see " + b64).encode()).decode()
    return {"url": "x " + KEY.replace("=", "%3D") + " y", "double url": KEY.replace("=", "%253D"),
            "unicode": KEY.replace("=", "\\u003d"), "base64": f"a {b64} b", "gzip": f"a {packed} b", "twice": f"a {twice} b", "inner": f"a {inner} b"}


@pytest.mark.parametrize("how", nested())
def test_nested_secrets_are_found_where_they_stand(how):
    text = nested()[how]
    base, spans, _ = secrets.scan(text)
    assert not base and any(k == 0 for _, k, _ in spans)
    start, _, end = next(s for s in spans if s[1] == 0)
    hidden = text[start:end]
    assert hidden.strip("ab xy") == hidden and len(hidden) <= len(text.strip("ab xy")) and "Sup3r" not in secrets.redacted(text)


def test_base_spans_follow_the_patterns_and_cycles_end():
    text = 'é token = "04dbebab91ab85687d33" AKIA' + "A1" * 9 + " AKIASHORT passwd:short api-key=1 API_KEY=abcdefghijkl secret=token:abcdefghijkl"
    base, spans, _ = secrets.scan(text)
    def kind(pattern, flags, test):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text, flags) if test(m)]
    want = [(s, 0, e) for s, e in kind(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12)]
    want += [(s, 1, e) for s, e in kind("AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18)] + [(s, 2, e) for s, e in kind("[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)]
    assert base == sorted(want) and set(base) <= set(spans)
    twin = base64.b64encode(b"QUJDREVGR0hJSktMTU5PUA== " * 2).decode()
    assert secrets.scan(twin)[2] < 10


def test_secret_table(spark):
    docs = docs_of(spark, [None, "", KEY, KEY, "plain " * 40_000]).withColumn("spans", F.lit(1))
    rows = secrets.secrets(docs).orderBy("id").collect()
    assert [r.n_assign for r in rows] == [0, 0, 1, 1, 0] and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].base_sha256 == hashlib.sha256(f"assign:0:{len(KEY)}".encode()).hexdigest()
    out = secrets.redact(docs).orderBy("doc_id").collect()
    assert out[0].text is None and out[2].text == "[assign]" and out[2].spans == 1
    assert secrets.secrets(docs.limit(0)).count() == 0


def unpacked(data):
    return b"".join(secrets.unpacked(iter([data])))


def test_streams_longer_than_a_block_are_read_to_their_end(monkeypatch):
    monkeypatch.setattr(secrets, "STEP", 100)
    monkeypatch.setattr(secrets, "BLOCK", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    plain = b"nothing here " * 400
    for packer in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: gzip.compress(bz2.compress(x))):
        for at in (0, 900, 990, 5000):
            text = "see " + base64.b64encode(packer(plain[:at] + KEY.encode() + b" " + plain[at:])).decode()
            assert any(k == 0 and s >= 4 for s, k, _ in secrets.scan(text)[1]), at
    assert unpacked(gzip.compress(plain)) == plain and unpacked(b"plain") == b""
    varied = prose(7, 3000).encode()
    assert varied.startswith(unpacked(gzip.compress(varied)[:-2000])[:5000]) and len(unpacked(gzip.compress(varied)[:-2000])) > 5000
    assert list(secrets.blocks(iter([b"a" * 950, b"b" * 50, b"c"]))) == [b"a" * 950 + b"b" * 50, b"a" * 50 + b"b" * 50 + b"c"]


@pytest.mark.parametrize("sign, again, last", [("%", "25", "3D"), ("\\", "u005c", "u003d"), ("\\", "x5C", "x3d"), ("&", "amp;", "#61;")])
def test_deeply_nested_escapes_are_undone(sign, again, last):
    for depth in (1, 2, 3, 4, 5, 8, 5000):
        text = "x " + KEY.replace("=", sign + again * depth + last) + " y"
        base, spans, layers = secrets.scan(text)
        assert [s for s in spans if s[1] == 0] == [(2, 0, len(text) - 2)] and layers < 12, depth
    sign = "%3D"
    for _ in range(600):  # each sign escaped the other way
        sign = sign.replace("%", "\\x25", 1) if sign[0] == "%" else sign.replace("\\", "%5C", 1)
    mixed = "x " + KEY.replace("=", sign) + " y"
    assert (2, 0, len(mixed) - 2) in secrets.scan(mixed)[1]


def test_odd_encodings_are_unwrapped():
    assert any(k == 0 for _, k, _ in secrets.scan("%FF" + KEY.replace("=", "%3D%E9"[:3]) + "%E9%20")[1])
    for how in ("utf-16-le", "utf-16-be"):
        text = "see " + base64.b64encode(KEY.encode(how)).decode() + " end"
        assert any(k == 0 and s >= 4 and e <= len(text) - 4 for s, k, e in secrets.scan(text)[1])
    inside = base64.b64encode(("a " + KEY + " b").encode()).decode().replace("=", "%3D")
    text = "&lt;" + inside.replace("a", "%61", 1)
    start, _, end = next(s for s in secrets.scan(text)[1] if s[1] == 0)
    assert 4 <= start < end <= len(text)


def test_runs_with_neighbours_lines_and_members_are_unwrapped():
    b64 = base64.b64encode(KEY.encode()).decode()
    packed = base64.b64encode(gzip.compress(KEY.encode())).decode()
    for before in ("/cb/", "/api/", "key_", "x-", "/a/b/", "abc", "v1-", "q"):
        for hidden in (b64, packed, b64.rstrip("=") + "/next"):
            text = f"see {before}{hidden} end"
            found = [s for s in secrets.scan(text)[1] if s[1] == 0]
            assert found and all(4 <= s and e <= len(text) - 4 for s, _, e in found), (before, hidden)
            assert not secrets.scan(secrets.redacted(text))[1]
    long = b"".join(b"line %d of it\n" % (i * i) for i in range(40)) + KEY.encode() + b"\nand more of it" * 3
    for end in ("\n", "\r\n", "\n  "):
        for data in (b"x" * 51 + KEY.encode() + b"y" * 9, gzip.compress(long), bz2.compress(long)):
            text = base64.b64encode(data).decode()
            text = "Content\n\n" + end.join(text[i:i + 76] for i in range(0, len(text), 76)) + "\n\nend"
            start, _, stop = next(s for s in secrets.scan(text)[1] if s[1] == 0 and s[2] - s[0] >= len(KEY))
            assert start >= 9 and stop <= len(text) - 5 and not secrets.scan(secrets.redacted(text))[1]
    for two in (gzip.compress(b"first ") + gzip.compress(KEY.encode()), bz2.compress(b"first ") + bz2.compress(KEY.encode())):
        assert unpacked(two) == b"first " + KEY.encode()
        assert any(k == 0 for _, k, _ in secrets.scan(base64.b64encode(two).decode())[1])


# PII

def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def test_pseudonyms_keep_format_validity_and_links(spark):
    texts = ["4644-3483-9801-0899 and 4644348398010899", "4644348398010899 again; 4644348398010898 is none", "born 2021-02-28, 29.02.2020 or 12/31/1999, not 2021-02-30",
             "host 97.51.17.173, not 300.1.1.1", "078-05-1120 but 666-05-1120", "+1 (017) 555-7713", "Mail Jo.Doe7@Example.org!", "DE89 3704 0044 0532 0130 00", None, "", "none here 12 345"]
    rows = pii.pseudonymised(docs_of(spark, texts).withColumn("pii", F.lit(0)), "k").orderBy("doc_id").collect()
    out = [r["pii_"].text for r in rows]
    for old, new in zip(texts, out):
        assert (old is None) == (new is None)
        assert old is None or re.sub("[0-9A-Za-z]", "", old) == re.sub("[0-9A-Za-z]", "", new)
    a, b = out[0].split(" and ")
    assert a.replace("-", "") == b != "4644348398010899" and luhn(b) == 0 and out[1].startswith(b) and "4644348398010898" in out[1]
    assert "2021-02-30" in out[2] and "2021-02-28" not in out[2] and "300.1.1.1" in out[3] and "97.51.17.173" not in out[3]
    assert "666-05-1120" in out[4] and "078-05-1120" not in out[4] and out[5] != texts[5] and out[6].endswith("@Example.org!") and "Jo.Doe7" not in out[6]
    iban = out[7].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert rows[0]["pii_"].n_card == 2 and out[9] == "" and out[10] == texts[10]


def test_values_beside_other_digits_get_pseudonyms(spark):
    card = "4111 1111 1111 1111"
    texts = [card + " 123", card + " 12/27", "12 4111111111111111", "12 34 56 " + card + " 99", "at 2024-01-31T10:00:00Z", "no 12 2024-01-31 5551 1234",
             "7 078-05-1120 4111", card + " 4111-1111-1111-1111", "2024-01-31Tx", "4111 1111 1111 1112 124"]
    rows = pii.pseudonymised(docs_of(spark, texts), "k").orderBy("doc_id").collect()
    for old, r in zip(texts, rows):
        new = r.pii.text
        assert re.sub("[0-9]", "", old) == re.sub("[0-9]", "", new)
        assert not re.search("4111[ -]?1111[ -]?1111[ -]?1111|2024-01-31(?!Tx)|078-05-1120", new), new
    assert [r.pii.n_card for r in rows] == [1, 1, 1, 1, 0, 0, 0, 2, 0, 0] and [r.pii.n_date for r in rows] == [0, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert rows[0].pii.text.endswith(" 123") and rows[3].pii.text.startswith("12 34 56 ") and rows[4].pii.text.endswith("T10:00:00Z")
    assert rows[6].pii.n_ssn == 1 and rows[8].pii.text == texts[8] and rows[9].pii.text == texts[9]


def test_networks_are_permutations(spark):
    two = spark.range(1000).select(pii.permute(F.lpad(F.col("id").cast("string"), 3, "0"), "k", F.lit("t")).alias("x"))
    assert {r.x for r in two.collect()} == {f"{i:03d}" for i in range(1000)}
    days = spark.range(700).select(pii.permute_below(F.col("id"), 700, "k", "t").alias("x"))
    assert {r.x for r in days.collect()} == set(range(700))
    names = spark.range(26 * 26).select(pii.permute_letters(F.concat(F.char((F.col("id") % 26 + 97).cast("int")), F.char((F.floor(F.col("id") / 26) + 97).cast("int"))), "k", F.lit("t")).alias("x"))
    assert len({r.x for r in names.collect()}) == 676


# URLs

def test_urls_hosts_paths_rules_and_tree(spark):
    rows = [(1, None), (2, "no scheme"), (3, "https://WWW.Example.COM/en/1?x#y"), (4, "http://a.example.com/en/1"), (5, "http://example.com"), (6, "x://h.net/es/é"),
            (7, "http://b.org:80/a/b"), (8, "http://com/"), (9, "http://notcom/"), (10, "ftp://u@h.net/ES/1"), (11, "https://a.com?q=/z"), (1, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("mine"))
    from docaudit.llm.queries import URL_RULES
    out = {r.id: r for r in urls.judge(pages, URL_RULES).collect()}
    assert urls.judge(pages, URL_RULES).count() == 12 and urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("", "", None, "allow") and out[2].host == ""
    assert (out[3].host, out[3].path, out[3].rule, out[3].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (out[4].rule, out[4].verdict) == ("example.com/en/", "block") and (out[5].path, out[5].rule) == ("", None)
    assert (out[6].rule, out[6].verdict) == ("net/es/", "block") and out[7].host == "b.org:80" and out[8].rule == "com/" and out[9].rule is None
    assert out[10].rule is None and (out[11].host, out[11].path, out[11].rule) == ("a.com", "", None)


def test_bad_templates_are_blocked_and_wide_nodes_become_wildcards(spark):
    rules = [("block", "h.org", "/spam/1"), ("allow", "h.org", "/news/1")]
    rows = [f"http://h.org/spam/{i}" for i in range(200)] + [f"http://h.org/news/{i}" for i in range(200)] + [f"http://w.org/u/{w}" for w in prose(30, 60).split()]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    out = urls.judge(pages, rules).collect()
    assert {r.verdict for r in out if r.path.startswith("/spam")} == {"block"} and {r.verdict for r in out if r.path.startswith("/news")} == {"allow"}
    assert {r.template for r in out if r.host == "w.org"} == {"/u/*"}


# WARC

def test_archives_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "s"), (6, "u", "s"), (7, "u", other), (None, "u", other), (7, "u", other), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("mine"))
    folder = new_folder(spark, "warc-test")
    warc.write_archives(pages, folder)
    index = warc.index_archives(spark, folder)
    read = warc.read_records(index).collect()
    assert len(read) == 10 and all(r.digest == hashlib.sha1((r.payload if r.type == "response" else big).encode()).hexdigest() for r in read)
    one = next(r for r in read if r.id == "1")
    assert (one.type, one.refers_to, one.payload_bytes, one.url) == ("revisit", "2", 1200, "http://a/%0D%0Ax")
    assert sum(r.type == "response" for r in read) == 9 and {r.payload for r in read if r.id in ("3", "4")} == {""}
    assert warc.read_records(index.filter("digest = '" + one.digest + "' and type = 'response'")).first().payload == big
    empty = new_folder(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_records(warc.index_archives(spark, empty)).count() == 0


# decontamination

def test_templates_catch_copies_and_new_parameters(spark):
    item = "Anna buys 12 kg of apples and 3 litres of milk, then Bob takes 12 kg from Anna. How many are left?"
    texts = [prose(40, 30) + " " + item + " " + prose(41, 30), item.replace("Anna", "Clara").replace("12", "45"), item.replace("12 kg from", "13 kg from"),
             " ".join(item.split()[:6]), None, "", prose(42, 3000), "Anna Bob Carl Dora Emil Fritz Gina Hans Ida"]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "Anna Bob 12"), (4, item)], "item_id bigint, text string")
    rows = {(r.id, r.item): r for r in decontaminate.contaminated(docs_of(spark, texts).withColumn("hash", F.lit(1)), bench).collect()}
    assert set(rows) == {(0, 0), (0, 4), (1, 0), (1, 4)}
    assert rows[0, 0].exact and not rows[1, 0].exact
    assert {r.doc_id for r in decontaminate.clean_of(docs_of(spark, texts), bench).collect()} == set(range(2, 8))
    assert decontaminate.contaminated(docs_of(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_edited_and_lower_cased_copies_of_items_are_met(spark):
    item = "Anna buys 12 kg of apples and 3 litres of milk, then Bob takes 12 kg from Anna. How many are left?"
    short = "the old mill by the river turns slowly when autumn rain has filled every small pond"
    edited = []
    for text in (item, short):
        w = text.split()
        k = len(w) // 2
        edited += [w[:k] + ["indeed"] + w[k:], w[:k] + w[k + 1:], w[:k] + ["indeed"] + w[k + 1:]]
    texts = [prose(i, 30) + " " + " ".join(w) + " " + prose(i + 9, 30) for i, w in enumerate(edited)]
    numbers = "code 3 5 8 13 21 34 55 89 144 233 377 610 987 of the list"
    texts += [item.lower(), short.upper(), item.replace("Anna", "Anna Maria"), numbers, item.replace("Anna", "Cleo") + " " + item.replace("Anna", "Dan")]
    bench = spark.createDataFrame([(0, item), (1, short), (2, numbers)], "item_id bigint, text string")
    rows = {(r.id, r.item): r.exact for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(rows) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 0), (7, 1), (8, 0), (9, 2), (10, 0)}
    assert rows[6, 0] and not rows[8, 0] and not rows[10, 0]


def test_shared_frames_open_no_match(spark):
    word = lambda kind, k: f"{kind}{''.join('abcdefghij'[int(c)] for c in str(k))}"
    bench = spark.createDataFrame([(k, f"What is the capital of {word('country', k)} today") for k in range(100)], "item_id bigint, text string")
    texts = [f"{prose(k, 8)} what is the capital of {word('land', k)} anyway" for k in range(100)] + [f"so what is the capital of {word('country', 7)} today then"]
    assert [(r.id, r.item) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()] == [(100, 7)]


def test_items_of_frames_alone_and_of_few_literals_are_met(spark):
    items = ["the old mill by the river turns slowly when it rains", "the old mill by the river", "the old mill by the river", "the old mill by the river turns",
             "Rita 5 12 Anna 77", "3 5 8 13", "yes", "Anna 7"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = ["see the old mill by the river here", "list: 3 5 8 13.", "list: 4 5 9 13.", "rita 5 12 anna 77", "Rita 5 13 Anna 77", "yes Anna 7 yes"]
    rows = {(r.id, r.item) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert {(0, 1), (0, 2), (1, 5), (3, 4)} <= rows and not {i for i, _ in rows} & {2, 4, 5}


def test_recall_over_all_items_of_the_benchmark(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    edits = {"inserted": lambda w: w[:len(w) // 2] + ["indeed"] + w[len(w) // 2:], "deleted": lambda w: w[:len(w) // 2] + w[len(w) // 2 + 1:],
             "lower": lambda w: [x.lower() for x in w], "replaced": lambda w: w[:len(w) // 2] + ["indeed"] + w[len(w) // 2 + 1:],
             "named": lambda w: [x.replace(x.strip(".,"), "Zed" + x.strip(".,").lower()) if decontaminate.token(x)[1] == decontaminate.NAME else x for x in w]}
    rows = [(f"{how} {i}", f"{prose(i, 40)} {' '.join(edit(t.split()))} {prose(i + 1, 40)}") for how, edit in edits.items() for i, t in items]
    rows += [(f"clean {i}", prose(1000 + i, 120)) for i, _ in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = Counter(r.id.split()[0] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id string, text string"), bench).collect() if r.id.split()[1] == str(r.item))
    print(found)
    assert all(found[how] >= 0.9 * len(items) for how in edits) and not found["clean"]


# classifiers

def test_linear_time_pairs_equal_all_pairs():
    rng = np.random.default_rng(2)
    model = machine.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    places, x = np.array([3, 7, 11, 40]), rng.normal(size=4)
    pairs = sum(model.v[a] @ model.v[b] * x[i] * x[j] for i, a in enumerate(places) for j, b in enumerate(places) if i < j)
    assert abs(model.margin(places, x) - (0.3 + model.w[places] @ x + pairs)) < 1e-9


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        places = np.flatnonzero([a, b, 1]).astype(np.int32)
        rows.append((int(a == b), places, np.ones(len(places), np.float32)))
    model = machine.fit(rows, size=3)
    assert np.mean([(model.margin(p, v) > 0) == y for y, p, v in rows]) > 0.95


def test_scores_of_odd_rows(spark):
    good, bad = [prose(i, 60) for i in range(40)], ["### $$$ " * 30 + prose(i, 5) for i in range(40)]
    docs = docs_of(spark, good + bad + [None, "", "one"])
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(None, 1, 0), (3, None, None), (3, 1, 1)], LABELS)
    model = machine.train(docs, labels)
    rows = {r.id: r.score for r in machine.score(docs.withColumn("score", F.lit(9)), model).collect()}
    assert len(rows) == 83 and all(0 <= s <= 1 for s in rows.values())
    assert min(rows[i] for i in range(40)) > max(rows[i] for i in range(40, 80))
    none = machine.train(docs, labels.limit(0))
    assert {r.score for r in machine.score(docs, none).collect()} == {0.5}
    assert machine.score(docs.limit(0), model).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet((4, 1, 1), 500)
    members = spark.createDataFrame([(i, int(rng.integers(0, 900)), p[i].tolist()) for i in range(500)], "id bigint, tokens bigint, p array<double>")
    moves, shares = mixing.fit_rates(members, (0.5, 0.3, 0.2))
    assert np.abs(shares - (0.5, 0.3, 0.2)).max() < 1e-4
    moves, shares = mixing.fit_rates(members, (1.0, 0.0, 0.0))  # can't be met: least distance
    n = np.array([r.tokens for r in members.orderBy("id").collect()], float) / members.agg(F.sum("tokens")).first()[0]
    rate = np.ones(500)
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ ((rate * n) @ p - (1, 0, 0)))
    least = (((rate * n) @ p - (1, 0, 0)) ** 2).sum()
    assert ((shares - (1, 0, 0)) ** 2).sum() < least + 5e-3
    rates = [r.rate for r in members.select("id", mixing._rate(moves).alias("rate")).orderBy("id").collect()]
    assert min(rates) >= 0 and np.allclose((np.array(rates) * n) @ p, shares)
    assert mixing.fit_rates(members.limit(0), (1, 1, 1))[0] == []


def test_mixing_of_odd_rows(spark):
    docs = docs_of(spark, [prose(i, 50) for i in range(20)] + [None, ""]).withColumn("rate", F.lit("mine"))
    docs = docs.withColumns({"__rate": F.lit(1), "__copies": F.lit(2), "__key": F.lit(3)})
    docs = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(None, 1, 0), (1, None, 0)], LABELS)
    out = mixing.mixed(docs, labels)
    assert out.columns == [*docs.columns, "rate_", "copies"] and out.count() == 24
    assert mixing.mixed(docs, labels.limit(0)).count() == 24 and mixing.mixed(docs.limit(0), labels).count() == 0


def test_features_are_places_once_each():
    places, values, words = Extractor()("A a b. b, c\nA a", None)
    assert len(set(places.tolist())) == len(places) == len(values) and words == 7 and np.isfinite(values).all()
