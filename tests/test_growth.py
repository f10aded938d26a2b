"""What is read several times is judged once; groups that hold all rows are cut; batches are bounded."""
import pytest
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import text as T
from docaudit.operators import audit as U
from docaudit.operators import dataset as DS
from docaudit.operators import events as E
from docaudit.operators import grounding as G
from docaudit.operators import training as TR
from docaudit.plans import registry
from docaudit.schemas import TABLES
from docaudit.sources import derived as D
from docaudit.sources import packages as P
from packages import package, t


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of small tables; a column that is not given is null."""
    def put(name, *rows):
        schema = spark.createDataFrame([], TABLES[name]).schema
        full = [tuple(r.get(f.name) for f in schema) for r in rows]
        spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", {"doc_id": 1, "text": "Mapa da cidade de Lisboa visto do alto do castelo\nimagem\n"},
        {"doc_id": 2, "text": "Retrato de uma criança sentada à janela da casa\nfoto\nMapa"}, {"doc_id": 2, "text": "x"})
    put("labels", {"doc_id": 1, "quality": 1, "toxic": 0})
    put("orders", *[{"o_orderkey": k, "o_custkey": k, "o_orderstatus": s, "o_orderpriority": "1-URGENT"}
                    for k, s in ((1, "F"), (2, "O"), (6, "F"), (3, "X"))])
    put("lineitem", *[{"l_orderkey": k, "l_linenumber": n, "l_partkey": 5 * n, "l_suppkey": n, "l_quantity": 3.0,
                       "l_returnflag": "N", "l_linestatus": "O"} for k in (1, 2, 6, 3) for n in (1, 2)])
    put("part", {"p_partkey": 5, "p_brand": "b", "p_name": "uma peça"}, {"p_partkey": 10, "p_brand": "b", "p_name": "outra"})
    return str(tmp_path)


def read(df, name):
    return any(name in f for f in df.inputFiles())


def test_labels_are_judged_once_whatever_filters_them(spark, tables):
    samples, _ = DS.working_label(D.alt_rows(spark, tables), "provisorio")
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(C.HAS_LETTER) == 1
    assert {r["text"]: r["y"] for r in samples.collect()}["imagem"] == "INSUFFICIENT"


def test_audit_reads_its_rows_once(spark, tables):
    checks = U.audit(D.alt_rows(spark, tables))
    assert not read(checks, "documents.parquet")
    assert {r["no"]: r["observed"] for r in checks.collect()}[8] == "7"


def test_classes_of_folds_are_cut_into_blocks(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 150).cast("string").alias(
        "group_key"), F.when(F.col("id") % 150 < 100, "GOOD").otherwise("WEAK").alias("y"), F.lit(False).alias("synthetic"))
    whole = sorted(map(tuple, TR.assign_folds(rows, 5).select("id", "fold").collect()))
    monkeypatch.setattr(TR, "FOLD_ROWS", 10)
    cut = TR.assign_folds(rows, 5).select("id", "fold")
    assert sorted(map(tuple, cut.collect())) == whole


def test_months_are_cut_into_blocks(spark, monkeypatch):
    calls = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") % 40).alias("ts"), (F.col("id") % 7 - 1).alias("cost_cents"))
    gate = lambda: sorted(map(tuple, E.budget_gate(calls, F.lit("m"), F.col("ts"), cap=500).collect()))
    whole = gate()
    monkeypatch.setattr(E, "MONTH_ROWS", 10)
    assert gate() == whole and {r[-1] for r in whole} == {True, False}


def test_prompts_judge_the_findings_once(spark, tables):
    facts = D.facts(spark, tables)
    from docaudit.operators import rules as R
    blocks = G.prompt_blocks(R.run_rules(facts), seed="t")
    assert not read(blocks, "orders.parquet") and blocks.filter("section = 0").count() > 0


@pytest.mark.parametrize("name", ["retention_cascade", "generated_recommendations"])
def test_joins_stay_above_the_rules(spark, tables, name):
    registry.load()
    out = registry.QUERIES[name](spark, tables)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan and "texto de link" not in plan
    if name == "retention_cascade":
        assert {r["child"]: r["kept"] for r in out.collect()}["images"] == 6


def test_batches_of_packages_are_bounded(spark, monkeypatch):
    rows = [("a", package(t("um") + t("dois"))), ("b", package(t("tres"))), ("c", bytearray(b"PK no zip"))]
    packages = spark.createDataFrame(rows, "doc_id string, content binary")
    both = lambda: [sorted(map(str, df.collect())) for df in (P.package_entries(packages), *P.shred(packages, False))]
    whole = both()
    monkeypatch.setattr(P, "BATCH_ROWS", 1)
    monkeypatch.setattr(P, "BATCH_BYTES", 1)
    assert both() == whole and len(whole[1]) > 4


def test_vocabulary_without_counts_of_rows(spark):
    texts = [("1", "mapa da cidade"), ("2", "mapa do campo"), ("2", "mapa da cidade"), (None, "campo"), (None, "campo"), ("3", "😀😀 campo campo"), ("4", None)]
    rows = spark.createDataFrame(texts, "id string, text string")
    plain = TR.vocabulary(TR.term_counts(rows), 6)
    assert sorted(map(tuple, TR.vocabulary_of(rows, 6).collect())) == sorted(map(tuple, plain.collect()))


def test_common_texts_fold_as_lower_case(spark):
    text = [(chr(i), chr(i).casefold()) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(text, "x string, folded string")
    assert rows.filter(T.case_folded(F.col("x")) != F.col("folded")).count() == 0
    assert rows.filter(F.col("x").rlike(T._LOWER_FOLDS) & (F.lower("x") != F.col("folded"))).count() == 0
