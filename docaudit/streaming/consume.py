"""Streaming forms: idempotent consumption, findings per micro-batch, dead letters, rate cap."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docaudit import constants as C
from docaudit.operators import events as E
from docaudit.operators import training as TR
from docaudit.operators.ordered import first_per_group
from docaudit.session import cut_lineage
from docaudit.streaming.logs import Batch, BatchLog, bucket, exists, run_of


def event_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The request topic of a broker: key, value as text, arrival time."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp"))


def deduplicated(stream: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """One row per event id inside the delay; state older than it is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id"])


def consume(stream: DataFrame, work: Callable[[DataFrame], dict[str, DataFrame]], ledger: str,
            output: str, checkpoint: str, states: Callable[[SparkSession], DataFrame] | None = None,
            day: Column | None = None) -> StreamingQuery:
    """Run ``work`` once per new event and write its tables, at least once but idempotently.

    ``work`` maps a batch of events to named tables. Events that the ledger knows are dropped. Of those that are new only
    the first of an analysis is worked on, and none whose analysis has come to an end: by ``states``, the analyses as they
    were registered, or by the table "states" that the work of earlier batches wrote. All new events go to the ledger.

    ``day`` is the part of the ledger an event belongs to, such as its day; an event that is repeated names the
    same part, however late. Without it, and for states, parts are buckets of ids. A batch reads no other parts. A
    batch replayed after a failure writes its own folders again and leaves them out of what it reads; the mark
    of a batch in "commits" is written last (see ``logs.committed``). A batch of which nothing is due does no work.
    """
    spark = stream.sparkSession
    run = run_of(spark, checkpoint)
    book = BatchLog(ledger, "event_id string", bucket("event_id") if day is None else day.cast("string"))
    kept = BatchLog(f"{output}/states", "analysis_id string, event_id string, step int, state string", bucket("analysis_id"))
    book.create(spark)
    kept.create(spark)

    def step(rows: DataFrame, number: int) -> None:
        batch, spark = Batch(run, number), rows.sparkSession
        rows = rows.withColumns({x: F.col(x).cast("string") for x in ("event_id", "analysis_id")})
        arrival = "occurred_at" if "occurred_at" in rows.columns else "event_id"
        fresh = cut_lineage(E.unprocessed(rows, book.earlier(rows, batch), at=arrival))
        ended = kept.earlier(fresh, batch).select("analysis_id", "state")
        if states is not None:
            ended = ended.unionByName(states(spark).select(F.col("analysis_id").cast("string"), "state"))
        first = first_per_group(fresh, "analysis_id", [arrival, "event_id"])
        due = cut_lineage(E.unprocessed(first, spark.createDataFrame([], "event_id string"), ended))
        begun, place = f"{output}/begun/run={run}/batch={number}", f"run={run}/batch={number}"
        # nothing is due: the tables stay as they are, unless there are none or an attempt at this batch has written some
        if not (due.isEmpty() and exists(spark, f"{output}/commits") and not exists(spark, begun)):
            due.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(begun)
            for name, table in work(due).items():
                if name == "states":
                    kept.write(table, batch)
                else:
                    table.write.mode("overwrite").parquet(f"{output}/{name}/{place}")
        book.write(fresh, batch)
        fresh.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{output}/commits/{place}")

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def analyse(packages: DataFrame, analyses: DataFrame | None = None, model: TR.Model | None = None) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """The unit of work of an analysis request: package, facts, findings, predictions, states, letters.

    packages(analysis_id, content) is the table of stored binaries; analyses(analysis_id) that of registered ones, if it is
    given. An analysis goes from RECEBIDA to PROCESSANDO and CONCLUIDA with its findings, or to FALHOU with a dead letter when its
    binary is missing or unreadable; an event of an unknown analysis is a letter without a state. With ``model`` it
    classifies the alts, and the rule where it fails.
    """
    from docaudit.operators import facts as X
    from docaudit.operators import rules as R
    from docaudit.operators import views as V
    from docaudit.sources import packages as P

    def work(events: DataFrame) -> dict[str, DataFrame]:
        ids = events.select("analysis_id").distinct()
        text = lambda df: df.withColumn("analysis_id", F.col("analysis_id").cast("string"))
        unknown = ids.limit(0) if analyses is None else ids.join(text(analyses), "analysis_id", "left_anti")
        found = text(packages).join(ids, "analysis_id", "left_semi").join(unknown, "analysis_id", "left_anti").select(
            F.col("analysis_id").alias("doc_id"), "content")
        refused = cut_lineage(P.package_reasons(found).filter("reason IS NOT NULL").select("doc_id"))
        found = found.join(refused, "doc_id", "left_anti")
        elements, parts = P.shred(found)
        missing = ids.join(text(packages), "analysis_id", "left_anti").join(unknown, "analysis_id", "left_anti")
        said = lambda df, id, what: df.select(F.col(id).alias("analysis_id"), F.lit(what).alias("exception"))
        broken = cut_lineage(X.failed_documents(parts))
        failed = cut_lineage(said(broken.unionByName(refused), "doc_id", "ParteIlegivel").unionByName(
            said(missing, "analysis_id", "BinarioAusente")).unionByName(said(unknown, "analysis_id", "AnaliseNaoEncontrada")))
        ready = cut_lineage(ids.join(failed, "analysis_id", "left_anti").select(F.col("analysis_id").alias("doc_id")))
        # the elements are large and written: facts, which are small, lose the broken documents, and are tables for rules and predictions
        facts = X.kept(X.without(X.all_facts(elements, ready), broken))
        ends = events.join(failed, "analysis_id", "left").filter(
            F.col("exception").isNull() | (F.col("exception") != "AnaliseNaoEncontrada"))
        steps = F.when(F.col("exception").isNull(), F.array(F.lit("PROCESSANDO"), F.lit("CONCLUIDA"))).otherwise(F.array(F.lit("FALHOU")))
        states = ends.select("analysis_id", "event_id", F.posexplode(steps).alias("step", "state"))
        return {"findings": R.run_rules(facts), "predictions": V.served_predictions(facts.images, model),
                "dead_letters": events.select("event_id", "analysis_id").join(failed, "analysis_id"),
                "states": states.withColumn("step", F.col("step") + 1)}
    return work


class StateMachine(StatefulProcessor):
    """The state of an analysis, kept from batch to batch; a step that the graph does not allow changes nothing.

    The steps of a micro-batch are taken in order of time. At most three steps of an analysis are ever accepted, so
    a batch is searched that many times for the next, and never walked. Held of a batch are place and state of its rows.
    """

    def __init__(self, transitions: Sequence[tuple[str, str]] = C.TRANSITIONS, first: str = "RECEBIDA"):
        self.after = {None: {first}}
        for a, b in transitions:
            self.after.setdefault(a, set()).add(b)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = pd.concat([r[["at", "event_id", "state"]].astype({"state": "category"}) for r in rows])
        held = held.astype({"state": "string"}).sort_values(["at", "event_id"], ignore_index=True)
        current = self.state.get()[0] if self.state.exists() else None
        begin, before, kind = 0, [], np.full(len(held), "ilegal", object)
        while True:
            fits = np.flatnonzero(held["state"].iloc[begin:].isin(self.after.get(current, ())).to_numpy())
            stop = begin + int(fits[0]) + 1 if len(fits) else len(held)
            before += [current] * (stop - begin)
            if not len(fits):
                break
            kind[stop - 1] = "primeira" if current is None else "legal"
            current, begin = held["state"].iloc[stop - 1], stop
        if current is not None:
            self.state.update((current,))
        yield pd.DataFrame({"analysis_id": key[0], "event_id": held["event_id"], "before": before, "state": held["state"], "kind": kind})

    def close(self) -> None:
        pass


def transitions(stream: DataFrame) -> DataFrame:
    """stream(analysis_id, event_id, at, state): every step with the state before it and what it is; those that are
    refused are rows, too. ``operators.events.transitions`` says the same of a log that is all there."""
    kinds = dict(stream.dtypes)
    return stream.select("analysis_id", "event_id", "at", "state").groupBy("analysis_id").transformWithStateInPandas(
        StateMachine(), f"analysis_id {kinds['analysis_id']}, event_id {kinds['event_id']}, before string, state string, kind string", "append", "None")


class RateCap(StatefulProcessor):
    """Fixed window per user in order of time; a refused event still counts.

    The rows of a user in a micro-batch are put in order first. With ``expire`` a window that nobody has
    touched for twice its length is forgotten.
    """

    def __init__(self, cap: int = C.RATE_CAP, window_seconds: int = C.RATE_WINDOW_SECONDS, expire: bool = True):
        self.cap, self.window, self.expire = cap, window_seconds * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        limit = [2 * self.window // 1000] if self.expire else []
        self.state = handle.getValueState("window", "opened bigint, position bigint", *limit)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        at = batch["at"].to_numpy(np.int64)
        position = np.empty(len(at), np.int64)
        opened, count = self.state.get() if self.state.exists() else (None, 0)
        i = 0
        while i < len(at):  # once per window
            if opened is None or at[i] >= opened + self.window:
                opened, count = int(at[i]), 0
            j = max(i + 1, int(np.searchsorted(at, opened + self.window, side="left")))
            position[i:j] = count + np.arange(1, j - i + 1)
            count += j - i
            i = j
        self.state.update((opened, count))
        yield pd.DataFrame({"event_id": batch["event_id"], "user_id": key[0], "allowed": position <= self.cap})

    def close(self) -> None:
        pass


def rate_capped(stream: DataFrame, cap: int = C.RATE_CAP,
                window_seconds: int = C.RATE_WINDOW_SECONDS, expire: bool = True) -> DataFrame:
    """stream(event_id, user_id, at): each event with whether it is allowed.

    Expiry follows the clock, for which Spark runs batches without data as well: a stream that only
    drains what is there asks for none.
    """
    return stream.groupBy("user_id").transformWithStateInPandas(
        RateCap(cap, window_seconds, expire), "event_id bigint, user_id bigint, allowed boolean",
        "append", "ProcessingTime" if expire else "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query of keyed state is started: the state store that can hold it, whatever the session's own is."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drain what is there now into a Parquet folder and read it back."""
    query = (stream.writeStream.format("parquet").option("path", folder)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
