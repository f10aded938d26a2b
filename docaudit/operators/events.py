"""Event processing as tables: routes, retries, dead letters, states, caps, outbox."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import text as T
from docaudit.operators.ordered import attach, first_per_group, hot_keys, over_ordered
from docaudit.session import cut_lineage

EVENT = ("event_id string, correlation_id string, occurred_at timestamp, schema_version int, "
         "analysis_id string, file_name string, sha256 string")
#: A month with so many calls is summed in blocks, not in one task.
MONTH_ROWS = 100_000
REQUIRED = ("event_id", "correlation_id", "occurred_at", "analysis_id")
PERMANENT = ("ParteIlegivel", "UncheckedIO", "BinarioAusente", "AnaliseNaoEncontrada")


def parse_events(raw: DataFrame, value: Column) -> DataFrame:
    """JSON values to event columns; ``decoded`` is false where a required field is missing.

    The type is fixed, so a value that does not decode becomes a row to route, not an error.
    """
    wire = ("eventId string, correlationId string, occurredAt timestamp, schemaVersion int, "
            "analiseId string, nomeArquivo string, sha256 string")
    names = [x.split()[0] for x in EVENT.split(", ")]
    parsed = raw.withColumn("e", F.from_json(value, wire))
    fields = [F.col(f"e.{w.split()[0]}").alias(n) for w, n in zip(wire.split(", "), names)]
    rows = parsed.select(*[c for c in raw.columns if c not in names], *fields)
    return rows.withColumn("decoded", reduce(lambda a, b: a & b, [
        F.col(n).isNotNull() for n in REQUIRED]))


def unprocessed(events: DataFrame, ledger: DataFrame, states: DataFrame | None = None,
                at: str | None = None) -> DataFrame:
    """Events that the ledger does not know, one row per id, the first by arrival if ``at`` names it.

    With states(analysis_id, state) events of a finished analysis are left out: they go to the ledger
    without being worked on.
    """
    first = first_per_group(events, "event_id", [at]) if at else events.dropDuplicates(["event_id"])
    fresh = first.join(ledger.select("event_id").distinct(), "event_id", "left_anti")
    if states is None:
        return fresh
    done = states.filter(F.col("state").isin(*C.TERMINAL_STATES)).select("analysis_id").distinct()
    return fresh.join(done, "analysis_id", "left_anti")


def failure_route(error_class: Column) -> Column:
    """Permanent failures go straight to the dead letters; the others are tried again."""
    return (F.when(error_class.isNull(), "ok")
            .when(error_class.isin(*PERMANENT), "dlt").otherwise("retry"))


def retry_schedule(failures: DataFrame, attempts: int = C.RETRY_ATTEMPTS,
                   initial_ms: int = C.RETRY_INITIAL_MS, factor: float = C.RETRY_MULTIPLIER,
                   cap_ms: int = C.RETRY_CAP_MS) -> DataFrame:
    """Per failed event, each attempt with its delay and the time since the failure."""
    delays = [min(initial_ms * factor ** k, cap_ms) for k in range(attempts)]
    steps = F.array(*[F.struct(
        F.lit(k + 1).alias("attempt"), F.lit(int(d)).cast("bigint").alias("delay_ms"),
        F.lit(int(sum(delays[:k + 1]))).cast("bigint").alias("after_ms"),
        F.lit(k + 1 == attempts).alias("last")) for k, d in enumerate(delays)])
    return failures.select("*", F.inline(steps))


@dataclass(frozen=True)
class DeadLetters:
    letters: DataFrame
    states: DataFrame
    ledger: DataFrame


def register_dead_letters(failed: DataFrame, known: DataFrame, states: DataFrame) -> DeadLetters:
    """failed(event_id, analysis_id, topic, exception, cause, message, at): once per event.

    The cause is kept before its wrapper; a terminal analysis keeps its state; every event is
    in the ledger afterwards.
    """
    first = first_per_group(failed, "event_id", ["at"])
    new = first.join(known.select("event_id"), "event_id", "left_anti")
    letters = new.select(
        "event_id", "analysis_id", F.coalesce("topic", F.lit("desconhecido")).alias("topic"),
        T.truncate_error(F.coalesce("cause", "exception"), 500).alias("exception"),
        T.truncate_error(F.col("message"), 1000).alias("message"), "at")
    hit = letters.select("analysis_id").distinct().withColumn("failed", F.lit(True))
    updated = states.join(hit, "analysis_id", "left").select(
        "analysis_id", F.when(F.col("failed") & ~F.col("state").isin(*C.TERMINAL_STATES),
                              "FALHOU").otherwise(F.col("state")).alias("state"))
    ledger = letters.select("event_id", F.lit(C.CONSUMER).alias("consumer"))
    return DeadLetters(letters, updated, ledger)


def transitions(log: DataFrame) -> DataFrame:
    """log(analysis_id, event_id, ts, state) with the state before each step and what the step is.

    An analysis begins with its first RECEBIDA. A step that the graph does not allow is refused and
    changes nothing. The graph has no cycle, so at most three steps of an analysis are accepted; each
    is a minimum over the rows after the one before, and no group is ever put in order.
    """
    place = F.struct("ts", "event_id")
    log = log.withColumn("__at", place)
    state, at = F.col("state"), F.col("__at")

    def accepted(rows: DataFrame, allowed: Column, name: str) -> DataFrame:
        found = rows.filter(allowed).groupBy("analysis_id").agg(F.min(F.struct("__at", "state")).alias(name))
        return rows.join(found, "analysis_id", "left")

    def follows(name: str) -> Column:
        return reduce(lambda a, b: a | b, [
            (F.col(f"{name}.state") == x) & (state == y) for x, y in C.TRANSITIONS]) & (at > F.col(f"{name}.__at"))

    rows = accepted(log, state == "RECEBIDA", "__s0")
    rows = accepted(rows, follows("__s0"), "__s1")
    rows = accepted(rows, follows("__s1"), "__s2")
    before = F.lit(None).cast("string")
    kind = F.lit("ilegal")
    for name, what in (("__s0", "primeira"), ("__s1", "legal"), ("__s2", "legal")):
        before = F.when(at > F.col(f"{name}.__at"), F.col(f"{name}.state")).otherwise(before)
        kind = F.when(at == F.col(f"{name}.__at"), what).otherwise(kind)
    return rows.withColumns({"before": before, "kind": kind}).drop("__at", "__s0", "__s1", "__s2")


# ------------------------------------------------------------------------- rate cap
def _fold(window: int, cap: int, user: str):
    """Walks rows sorted by user and time, from window to window, in constant memory.

    A user's rows may span batches, so the open window of the last user is kept between them.
    Rows carry the window that earlier slices left open, or NULL.
    """
    def fold(batches):
        current, start, count = None, None, 0
        for batch in batches:
            users, at = batch[user].to_numpy(), batch["at"].to_numpy(np.int64)
            left = batch["left_open"].to_numpy(dtype=float, na_value=np.nan)
            opened, position = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            ends = np.append(np.flatnonzero(users[1:] != users[:-1]) + 1, len(at))
            i = 0
            for end in ends if len(at) else ():
                if users[i] != current:
                    current, start, count = users[i], None, 0
                    if not np.isnan(left[i]):
                        start = int(batch["left_open"].iloc[i])
                        count = int(batch["left_position"].iloc[i])
                while i < end:
                    if start is None or at[i] >= start + window:
                        start, count = int(at[i]), 0
                    j = i + int(np.searchsorted(at[i:end], start + window, side="left"))
                    opened[i:j] = start
                    position[i:j] = count + np.arange(1, j - i + 1)
                    count += j - i
                    i = j
            yield pd.DataFrame({"event_id": batch["event_id"], user: users, "at": at,
                                "opened": opened, "position": position,
                                "allowed": position <= cap})
    return fold


def _time_slices(times: DataFrame, user: str, rows: int) -> list[tuple[int | None, int | None]]:
    """Cuts in time so that no user has more than about ``rows`` events between two of them.

    Only users with more events than that need cuts: the quantiles of their own times.
    """
    busy = times.groupBy(user).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    parts = busy.agg(F.max("n")).first()[0]
    if parts is None:
        return [(None, None)]
    fractions = [i * rows / parts for i in range(1, -(-parts // rows))]
    cuts = times.join(busy.select(user), user, "left_semi").groupBy(user).agg(
        F.percentile_approx("at", fractions, 10 * len(fractions)).alias("cuts")).select(F.explode("cuts")).distinct()
    cuts = sorted(r[0] for r in cuts.collect())
    return list(zip([None, *cuts], [*cuts, None]))


def rate_cap(events: DataFrame, user: str, at: Column, cap: int = C.RATE_CAP,
             window_seconds: int = C.RATE_WINDOW_SECONDS, slice_rows: int = 5_000_000,
             slices: list[tuple[int | None, int | None]] | None = None) -> DataFrame:
    """Fixed windows that open at a user's first event; later events beyond the cap are refused.

    Refused events count too. A user's windows depend on each other in time, so a log with a
    very busy user is processed in slices of time that carry (opened, position) per user, as
    a stream would; no task ever holds more than a slice of one user.
    """
    times = events.select("event_id", user, at.alias("at"))
    types = dict(times.dtypes)
    schema = (f"event_id {types['event_id']}, {user} {types[user]}, at bigint, opened bigint, "
              "position bigint, allowed boolean")
    window = window_seconds * 1_000_000
    slices = _time_slices(times, user, slice_rows) if slices is None else slices
    state, results = None, []
    for low, high in slices:
        part = times
        if low is not None:
            part = part.filter(F.col("at") >= low)
        if high is not None:
            part = part.filter(F.col("at") < high)
        nothing = F.lit(None).cast("bigint")
        part = (part.withColumns({"left_open": nothing, "left_position": nothing})
                if state is None else attach(part, state, user, "left"))
        done = part.repartition(user).sortWithinPartitions(user, "at", "event_id").mapInPandas(
            _fold(window, cap, user), schema)
        if len(slices) > 1:
            done = cut_lineage(done)
            last = done.groupBy(user).agg(F.max_by(
                F.struct("opened", "position"), F.struct("at", "event_id")).alias("s"))
            last = last.select(user, F.col("s.opened").alias("left_open"),
                               F.col("s.position").alias("left_position"))
            if state is not None:
                last = last.unionByName(state.join(last.select(user), user, "left_anti"))
            state = cut_lineage(last)
        results.append(done)
    return reduce(DataFrame.unionByName, results)


# --------------------------------------------------------------------------- budget
def budget_gate(calls: DataFrame, month: Column, spread: Column, cost: str = "cost_cents",
                cap: int = C.MONTHLY_BUDGET_CENTS) -> DataFrame:
    """Blocked once the month's accepted calls reached the cap; non-positive costs add nothing.

    Totals never fall, so the sum over all earlier calls passes the cap exactly when the sum over the
    accepted ones does. From there on the spent total stands still at the first one that reached it.
    """
    paid = F.greatest(F.col(cost), F.lit(0))
    named = calls.withColumns({"month": month, "paid": paid})
    # Months are few and hold all calls. The rows are read twice: for the totals, and to be judged by them.
    rows = cut_lineage(over_ordered(named, ["month"], ["ts", "event_id"], spread, running={"upto": F.col("paid")},
                                    hot=hot_keys(named, ["month"], MONTH_ROWS)))
    reached = rows.groupBy("month").agg(F.min(F.when(F.col("upto") >= cap, F.col("upto"))).alias("reached"))
    before = F.col("upto") - F.col("paid")
    return rows.join(F.broadcast(reached), "month").withColumns(
        {"spent_before": F.least(before, "reached"), "blocked": before >= cap}).drop("upto", "paid", "reached")


# --------------------------------------------------------------------------- outbox
def outbox_state(attempts: DataFrame) -> DataFrame:
    """attempts(event_id, analysis_id, at, ok, error) folded to one row per event."""
    failed = ~F.col("ok")
    return attempts.groupBy("event_id", "analysis_id").agg(
        F.min("at").alias("created_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("published_at"),
        F.count(F.when(failed, 1)).alias("attempts"),
        F.max_by("error", F.when(failed, F.col("at"))).alias("e")).select(
        "event_id", "analysis_id", "created_at", "published_at", "attempts",
        F.when(F.col("published_at").isNull(), T.truncate_error(F.col("e"), 500)).alias(
            "last_error"))


def pending_batch(outbox: DataFrame, limit: int = C.OUTBOX_BATCH,
                  max_attempts: int = C.OUTBOX_MAX_ATTEMPTS) -> DataFrame:
    """Oldest unpublished events that may still be tried; a top-n per task, then of all."""
    return outbox.filter(F.col("published_at").isNull() & (F.col("attempts") < max_attempts)
                         ).orderBy("created_at", "event_id").limit(limit)


@dataclass(frozen=True)
class Registration:
    analyses: DataFrame
    binaries: DataFrame
    events: DataFrame


def register_requests(requests: DataFrame) -> Registration:
    """requests(analysis_id, owner_id, name, mime, content, correlation_id, at): three tables.

    The event names the analysis and the hash, never the bytes; its key is the analysis.
    """
    rows = requests.withColumn("sha256", F.sha2("content", 256))
    analyses = rows.select(
        "analysis_id", "owner_id", "correlation_id", "name", "mime",
        F.octet_length("content").cast("bigint").alias("size"), "sha256",
        F.lit("RECEBIDA").alias("state"), F.col("at").alias("created_at"))
    value = F.to_json(F.struct(
        F.sha2(F.concat_ws("/", "analysis_id", "correlation_id"), 256).alias("eventId"),
        F.col("correlation_id").alias("correlationId"), F.col("at").alias("occurredAt"),
        F.lit(1).alias("schemaVersion"), F.col("analysis_id").alias("analiseId"),
        F.col("name").alias("nomeArquivo"), "sha256"))
    return Registration(analyses, requests.select("analysis_id", "content"),
                        rows.select(F.col("analysis_id").alias("key"), value.alias("value")))

