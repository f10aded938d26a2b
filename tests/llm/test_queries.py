"""The queries and the pipeline over the given tables."""
import hashlib
import re

import numpy as np
import pytest
from compare import compare, connect

import corpus_pipeline
from docaudit.llm import decontaminate, machine, queries
from docaudit.llm.common import table

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles_agree(spark, name):
    result = compare(name, queries.QUERIES[name], queries.ORACLES[name], spark, SF, connect(SF))
    assert re.fullmatch(r"OK \d+", result), result


def test_thirteen_operators_have_a_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES} == set(range(1, 14))


def test_repeats_of_the_table_equal_brute_force(spark):
    from test_small_cases import brute_repeats
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:5] for r in queries.QUERIES["op2_repeated_strings"](spark, SF).collect()}
    assert got == brute_repeats(rows)


def test_classes_of_the_table_equal_brute_force(spark):
    from test_small_cases import brute_links
    rows = sorted(queries.QUERIES["op7_simhash_bk_tree"](spark, LARGER).collect())
    roots = brute_links(np.array([int(r.fingerprint, 16) for r in rows], np.uint64))
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in roots]


def test_quality_on_held_out_documents(spark):
    scores = queries.QUERIES["op3_factorisation_machine"](spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in scores if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in scores]) > 0.93


def test_planted_items_are_found(spark):
    found = {r.doc_id for r in queries.QUERIES["op8_template_decontamination"](spark, LARGER).collect()}
    items = [" ".join(r.text.split()) for r in table(spark, LARGER, "benchmark").collect()]
    texts = {r.doc_id: " ".join(r.text.split()) for r in table(spark, LARGER, "documents").collect()}
    copies = {d for d, t in texts.items() if any(i in t for i in items)}
    assert copies and copies <= found and len(found) <= len(copies) + 0.002 * len(texts)


def test_secret_digests_follow_the_contract(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    forms = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0))
    least = {"assign": 12, "access": 18, "hex": 16}
    for r in queries.QUERIES["op4_secret_scan"](spark, SF).collect():
        spans = sorted((m.start(), k, m.end()) for k, (name, p, flags) in enumerate(forms) for m in re.finditer(p, texts[r.doc_id], flags) if len(m[m.lastindex or 0]) >= least[name])
        listed = ",".join(f"{forms[k][0]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_mixture_meets_its_targets(spark):
    rows = queries.QUERIES["op6_soft_mixing"](spark, LARGER).collect()
    total = sum(r.tokens for r in rows)
    shares = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) / total for d in ("good", "poor", "toxic")]
    from docaudit.llm.mixing import TARGETS
    assert np.abs(np.array(shares) - TARGETS).max() < 1e-3 and min(r.rate for r in rows) >= 0


def test_no_personal_value_of_the_table_stays(spark):
    value = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])")
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.QUERIES["op1_feistel_pseudonyms"](spark, SF).collect():
        old = [v for v in value.findall(texts[r.doc_id]) if not re.fullmatch(r"[\d.]+", v) or max(map(int, v.split("."))) < 256]
        assert old or len(r.text) == len(texts[r.doc_id])
        assert not any(v in r.text for v in old)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, LARGER, "documents")
    kept = {r.doc_id for r in queries.QUERIES["op10_line_quality"](spark, LARGER).filter("kept").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "SimHash", "benchmark", "secret", "mixing"]
    stage = {}
    from docaudit.llm.common import written
    for name, run in corpus_pipeline.STAGES:
        docs = stage[name] = written(run(spark, docs, LARGER), "stage")
    tables = [stage[n] for n in names]
    assert {r.doc_id for r in tables[0].collect()} == kept
    from docaudit.llm.simhash import near_duplicates
    first = near_duplicates(tables[0])
    assert {r.doc_id for r in tables[1].collect()} == {r.component for r in first.collect()}
    assert not decontaminate.contaminated(tables[2], table(spark, LARGER, "benchmark")).count()
    assert tables[3].count() == tables[2].count() == tables[4].count()
    from docaudit.llm.secrets import scan
    assert not any(scan(r.text)[1] for r in tables[3].collect())
    assert all(t.columns == table(spark, LARGER, "documents").columns for t in tables[:4])
    assert tables[4].columns[-2:] == ["rate", "copies"] and tables[4].filter("rate is null").count() == 0


def test_threshold_of_the_classifier():
    assert machine.THRESHOLD == 0.3
