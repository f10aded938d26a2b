"""Consumption in micro-batches: states, replays, late repeats, parts that are read, and the state machine."""
import datetime as dt

import pytest
from packages import drawing, p, package
from pyspark.sql import functions as F

from docaudit.operators import events as E
from docaudit.operators import views as V
from docaudit.streaming import consume as S
from docaudit.streaming.logs import Batch, BatchLog, bucket, committed, run_of

EVENT = "event_id string, analysis_id string, occurred_at timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def drain(spark, folder, work, checkpoint="cp", analyses=None):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder("in"))
    query = S.consume(stream, work, folder("ledger"), folder("out"), folder(checkpoint),
                      None if analyses is None else lambda _: analyses, F.to_date("occurred_at"))
    query.awaitTermination()
    return query


def send(spark, folder, *rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder("in"))


def table(spark, folder, name, *columns):
    return sorted(tuple(r) for r in committed(spark, folder("out"), name).select(*columns).collect())


def test_states_findings_and_letters_of_one_batch_come_together(spark, folder):
    packages = spark.createDataFrame([("a", package(p(drawing()))), ("b", bytearray(b"nada")), ("d", package(p(drawing())))], "analysis_id string, content binary")
    analyses = spark.createDataFrame([(x, "RECEBIDA") for x in "abc"] + [("d", "CONCLUIDA")], "analysis_id string, state string")
    work = S.analyse(packages, analyses)
    send(spark, folder, ("e1", "a", at(1)), ("e2", "b", at(1)), ("e1", "a", at(1)), ("e3", "a", at(1, 5)), ("e4", "c", at(2)), ("e5", "x", at(2)), ("e6", "d", at(2)))
    drain(spark, folder, work, analyses=analyses)
    send(spark, folder, ("e7", "a", at(3)), ("e1", "a", at(1)), ("e8", "b", at(3)))  # ended, known, ended
    drain(spark, folder, work, analyses=analyses)
    states = table(spark, folder, "states", "analysis_id", "event_id", "step", "state")
    assert states == [("a", "e1", 1, "PROCESSANDO"), ("a", "e1", 2, "CONCLUIDA"), ("b", "e2", 1, "FALHOU"), ("c", "e4", 1, "FALHOU")]
    assert table(spark, folder, "dead_letters", "event_id", "exception") == [("e2", "ParteIlegivel"), ("e4", "BinarioAusente"), ("e5", "AnaliseNaoEncontrada")]
    assert {r[0] for r in table(spark, folder, "findings", "doc_id")} == {"a"}
    ledger = spark.read.parquet(folder("ledger")).select("event_id", "part").collect()
    assert sorted((r.event_id, str(r.part)) for r in ledger) == sorted([(f"e{k}", f"2024-01-0{d}") for k, d in ((1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3), (8, 3))])
    # another checkpoint reads all files again: every event is known, however old
    before = {n: table(spark, folder, n, "*") for n in ("states", "dead_letters", "findings")}
    drain(spark, folder, work, "another", analyses)
    assert before == {n: table(spark, folder, n, "*") for n in before}


def test_broken_documents_lose_their_facts_and_elements_are_written_once(spark, monkeypatch):
    broken = package(p(drawing()), parts={"word/header1.xml": "<w:hdr>"})
    packages = spark.createDataFrame([("a", package(p(drawing()))), ("b", broken), ("c", package(p(drawing()))), ("c", broken)], "analysis_id string, content binary")
    tables, write = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: (tables.append(df.columns), write(df))[1])
    events = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e3", "c")], "event_id string, analysis_id string")
    got = S.analyse(packages)(events)
    assert {r.doc_id for r in got["findings"].collect()} == {"a"}
    assert sorted((r.event_id, r.exception) for r in got["dead_letters"].collect()) == [("e2", "ParteIlegivel"), ("e3", "ParteIlegivel")]
    assert tables and not any("tag" in t for t in tables)


def test_a_part_of_the_log_is_few_files_however_many_tasks_write(spark, folder):
    log = BatchLog(folder("log"), "event_id string", F.to_date("occurred_at").cast("string"))
    rows = spark.range(2000).select(F.col("id").cast("string").alias("event_id"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 20).cast("int")).alias("occurred_at"))
    log.write(rows.repartition(16), Batch("r", 0))
    written = log.rows(spark)
    assert len(written.inputFiles()) <= 40 and written.distinct().count() == 2000  # 320 from 16 tasks


def test_a_replayed_batch_writes_the_same_again(spark, folder):
    calls, fail = [], [True]

    def work(events):
        calls.append(sorted(r.event_id for r in events.collect()))
        if len(calls) == 2 and fail:
            fail.clear()
            raise RuntimeError("once")
        return {"done": events.select("event_id"), "states": events.select("analysis_id", "event_id", F.lit(1).alias("step"), F.lit("CONCLUIDA").alias("state"))}

    send(spark, folder, ("e1", "a", at(1)))
    send(spark, folder, ("e2", "b", at(1)), ("e1", "a", at(1)))
    with pytest.raises(Exception, match="once"):
        drain(spark, folder, work)
    first = calls[0]
    drain(spark, folder, work)
    assert calls[1] == calls[2] and sorted(first + calls[2]) == ["e1", "e2"]
    assert table(spark, folder, "done", "event_id") == [("e1",), ("e2",)]
    # a batch that fell after its tables were written, but before its mark, is not seen, and writes them again
    spark.createDataFrame([("half",)], "event_id string").write.parquet(folder(f"out/done/run={run_of(spark, folder('cp'))}/batch=9"))
    assert table(spark, folder, "done", "event_id") == [("e1",), ("e2",)]


def test_a_batch_of_which_nothing_is_due_does_no_work(spark, folder):
    calls = []

    def work(due):
        calls.append(sorted(r.event_id for r in due.collect()))
        return {"found": due.select("event_id"), "states": due.select("analysis_id", "event_id", F.lit(1).alias("step"), F.lit("CONCLUIDA").alias("state"))}

    send(spark, folder, ("e1", "a", at(1)))
    drain(spark, folder, work)
    send(spark, folder, ("e1", "a", at(1)), ("e2", "a", at(2)))  # known, ended
    drain(spark, folder, work)
    assert calls == [["e1"]] and table(spark, folder, "found", "event_id") == [("e1",)]
    send(spark, folder, ("e3", "b", at(3)))
    drain(spark, folder, work)
    assert calls == [["e1"], ["e3"]] and table(spark, folder, "found", "event_id") == [("e1",), ("e3",)]
    assert spark.read.parquet(folder("out") + "/commits").count() == 3


def test_a_batch_reads_only_the_parts_its_rows_name(spark, folder):
    log = BatchLog(folder("log"), "event_id string", F.to_date("occurred_at").cast("string"))
    log.create(spark)
    rows = spark.createDataFrame([(f"e{d}", "a", at(d)) for d in range(1, 21)], EVENT)
    log.write(rows, Batch("r", 0))
    log.write(rows.filter("event_id = 'e3'"), Batch("r", 1))
    log.create(spark)  # taking it up again loses nothing
    asked = spark.createDataFrame([("e3", "a", at(3)), ("n", "a", at(25)), ("o", "a", None)], EVENT)
    for batch, seen in ((Batch("r", 2), 2), (Batch("r", 1), 1), (Batch("r", 0), 0), (Batch("other", 0), 2)):
        assert log.earlier(asked, batch).count() == seen
    found = log.earlier(asked, Batch("r", 2))
    assert len(found.inputFiles()) >= 1
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "2024-01-03" in scan.split("PartitionFilters")[1]
    files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert files and all("part=2024-01-03" in f for f in files)
    log.write(rows.filter("event_id = 'e3'"), Batch("r", 1))  # replayed: its own folder again
    assert log.rows(spark).count() == 21


def test_buckets_hold_ids_that_name_no_day(spark):
    ids = spark.range(10_000).select(F.col("id").cast("string").alias("event_id"))
    counts = [r["count"] for r in ids.groupBy(bucket("event_id")).count().collect()]
    assert len(counts) == 64 and max(counts) < 2 * min(counts)


def test_a_failing_model_leaves_the_rule(spark):
    images = spark.createDataFrame([("d", "p", 1, "n", "Gráfico de vendas por mês em 2023"), ("d", "p", 2, "n", None)], "doc_id string, part string, seq int, name string, alt string")
    with pytest.warns(UserWarning, match="the rule decides"):
        got = V.served_predictions(images, model="no model at all").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in V.alt_predictions(images).collect()] and got[0].used_heuristic and len(got) == 1


def test_the_state_machine_says_what_the_batch_operator_says(spark, folder):
    rng = __import__("random").Random(4)
    states = ["RECEBIDA", "PROCESSANDO", "CONCLUIDA", "FALHOU"]
    rows = [(rng.randint(1, 12) if k % 3 else 1, k, k // 4, rng.choice(states)) for k in range(600)]
    schema = "analysis_id bigint, event_id bigint, at bigint, state string"
    for begin in range(0, 600, 200):  # in time from file to file, not within one
        part = rows[begin:begin + 200]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder("log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder("log"))
    with S.keyed_state(spark):
        got = S.run_to_table(S.transitions(stream), folder("steps"), folder("steps-cp"))
    want = E.transitions(spark.createDataFrame(rows, schema).withColumnRenamed("at", "ts")).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("kind = 'ilegal'").count() > 100
