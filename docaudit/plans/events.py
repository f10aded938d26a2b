"""Event operators over the whole event log."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import events as E
from docaudit.operators import views as V
from docaudit.plans import oracle as O
from docaudit.plans.oracle import values, with_views
from docaudit.plans.packages import document_packages
from docaudit.plans.registry import ORACLES, query
from docaudit.schemas import TABLES
from docaudit.session import cut_lineage, new_folder
from docaudit.sources import derived as D
from docaudit.streaming import consume as S
from docaudit.streaming.logs import committed

c = F.col


def _events(spark, sf_dir):
    return D.table(spark, sf_dir, "events")


@query("parsed_events", """select event_id::varchar source_id, case when event_id%9=0 then null else
    event_id::varchar end event_id, case when event_id%11=0 then null else user_id::varchar end analysis_id,
    event_id%9<>0 and event_id%11<>0 and event_id%13<>0 decoded from events where event_id%13<>0
    union all select event_id::varchar, null, null, false from events where event_id%13=0""")
def parsed_events(spark, sf_dir):
    e = c("event_id")
    body = F.to_json(F.struct(
        F.when(e % 9 != 0, e.cast("string")).alias("eventId"), F.lit("c").alias("correlationId"),
        F.lit("2024-01-01T00:00:00Z").alias("occurredAt"), F.lit(1).alias("schemaVersion"),
        F.when(e % 11 != 0, c("user_id").cast("string")).alias("analiseId")))
    raw = _events(spark, sf_dir).select(e.cast("string").alias("source_id"), F.when(
        e % 13 == 0, "nao e json").otherwise(body).alias("value"))
    return E.parse_events(raw, c("value")).select("source_id", "event_id", "analysis_id", "decoded")


@query("unprocessed_events", "select event_id from events where event_type<>'view' and user_id%10>1")
def unprocessed_events(spark, sf_dir):
    events = _events(spark, sf_dir)
    ledger = events.filter("event_type = 'view'").select("event_id")
    states = events.select(c("user_id").alias("analysis_id"), F.when(c("user_id") % 10 == 0, "CONCLUIDA").when(
        c("user_id") % 10 == 1, "FALHOU").otherwise("PROCESSANDO").alias("state"))
    events = events.withColumn("analysis_id", c("user_id"))
    return E.unprocessed(events.unionByName(events), ledger, states, "ts").select("event_id")


O.add_view("e_failures", """select event_id, user_id analysis_id, ts, case event_id%7 when 0 then
    'ParteIlegivel' when 1 then 'UncheckedIO' when 2 then 'BinarioAusente' when 3 then
    'AnaliseNaoEncontrada' when 4 then 'TimeoutException' when 5 then 'SQLException' end error_class
    from events""", [])


def _failures(spark, sf_dir):
    names = ["ParteIlegivel", "UncheckedIO", "BinarioAusente", "AnaliseNaoEncontrada",
             "TimeoutException", "SQLException"]
    kind = F.get(F.array(*map(F.lit, names)), (c("event_id") % 7).cast("int"))
    return _events(spark, sf_dir).select("event_id", c("user_id").alias("analysis_id"), "ts", "props",
                                         kind.alias("error_class"))


@query("failure_routes", with_views(f"""select event_id, case when error_class is null then 'ok' when
    error_class in ({values(E.PERMANENT)}) then 'dlt' else 'retry' end route from e_failures""",
    "e_failures"))
def failure_routes(spark, sf_dir):
    return _failures(spark, sf_dir).select("event_id", E.failure_route(c("error_class")).alias("route"))


@query("retry_schedule", with_views("""select event_id, k+1 attempt, least(500*2^k, 10000)::bigint delay_ms,
    (500*(2^(k+1)-1))::bigint after_ms, k=3 "last" from e_failures, (select unnest([0, 1, 2, 3]) k)
    where error_class in ('TimeoutException', 'SQLException')""", "e_failures"))
def retry_schedule(spark, sf_dir):
    failed = _failures(spark, sf_dir)
    return E.retry_schedule(failed.filter(E.failure_route(c("error_class")) == "retry").select(
        "event_id"))


def _dead(spark, sf_dir):
    failed = _failures(spark, sf_dir).filter("error_class IS NOT NULL").select(
        "event_id", "analysis_id", F.when(c("event_id") % 2 == 0, "analise").alias("topic"),
        F.lit("ListenerExecutionFailed").alias("exception"),
        F.when(c("event_id") % 3 != 0, c("error_class")).alias("cause"),
        F.repeat("props", F.lit(60)).alias("message"), c("ts").alias("at"))
    known = failed.filter("analysis_id = 7").select("event_id")
    states = D.event_log(spark, sf_dir).groupBy("analysis_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return E.register_dead_letters(failed.unionByName(failed), known, states)


O.add_view("e_letters", """select event_id, user_id analysis_id, case when event_id%2=0 then 'analise'
    else 'desconhecido' end topic, case when event_id%3<>0 then error_class else
    'ListenerExecutionFailed' end exception, left(repeat(props, 60), 1000) message from events join
    (select event_id, error_class from e_failures) using (event_id) where error_class is not null
    and user_id<>7""", ["e_failures"])


@query("dead_letters", with_views("select * from e_letters", "e_letters"))
def dead_letters(spark, sf_dir):
    return _dead(spark, sf_dir).letters.drop("at")


@query("states_after_failures", with_views("""select analysis_id, case when state in ('CONCLUIDA', 'FALHOU')
    or analysis_id not in (select analysis_id from e_letters) then state else 'FALHOU' end state from (
    select analysis_id, arg_max(state, (ts, event_id)) state from d_event_log group by 1)""",
    "e_letters", "d_event_log"))
def states_after_failures(spark, sf_dir):
    return _dead(spark, sf_dir).states


@query("state_transitions", with_views("""select * from (with recursive e as (select *, row_number() over (partition by
    analysis_id order by ts, event_id) n from d_event_log), w(analysis_id, event_id, n, before, state, cur, kind) as (
    select analysis_id, event_id, n, null::varchar, state, case when state='RECEBIDA' then state end,
    case when state='RECEBIDA' then 'primeira' else 'ilegal' end from e where n=1 union all
    select e.analysis_id, e.event_id, e.n, cur, e.state, case when (cur is null and e.state='RECEBIDA') or
    (cur='RECEBIDA' and e.state in ('PROCESSANDO', 'FALHOU')) or (cur='PROCESSANDO' and e.state in ('CONCLUIDA',
    'FALHOU')) then e.state else cur end, case when cur is null and e.state='RECEBIDA' then 'primeira' when
    (cur='RECEBIDA' and e.state in ('PROCESSANDO', 'FALHOU')) or (cur='PROCESSANDO' and e.state in ('CONCLUIDA',
    'FALHOU')) then 'legal' else 'ilegal' end from w join e on e.analysis_id=w.analysis_id and e.n=w.n+1)
    select analysis_id, event_id, before, state, kind from w)""", "d_event_log"))
def state_transitions(spark, sf_dir):
    return E.transitions(D.event_log(spark, sf_dir)).select("analysis_id", "event_id", "before", "state", "kind")


@query("rate_capped_events", f"""with recursive e as (select user_id, event_id, epoch_us(ts) t, row_number()
    over (partition by user_id order by ts, event_id) n from events), w(user_id, event_id, n, t, o, p) as (
    select user_id, event_id, n, t, t, 1 from e where n=1 union all select e.user_id, e.event_id, e.n, e.t,
    case when e.t>=o+{C.RATE_WINDOW_SECONDS * 20_000_000} then e.t else o end,
    case when e.t>=o+{C.RATE_WINDOW_SECONDS * 20_000_000} then 1 else p+1 end from w join e on
    e.user_id=w.user_id and e.n=w.n+1) select event_id, user_id, p::bigint as position, p<=2 allowed from w""")
def rate_capped_events(spark, sf_dir):
    """Two per 20 hours, so that the given users, a few events a day each, reach the cap."""
    return E.rate_cap(_events(spark, sf_dir), "user_id", D.micros(c("ts")), cap=2,
                      window_seconds=C.RATE_WINDOW_SECONDS * 20).select(
        "event_id", "user_id", "position", "allowed")


@query("budget_gate", """with recursive e as (select event_id, strftime(ts, '%Y-%m') as month, floor(value)::bigint-5
    cost_cents, row_number() over (partition by strftime(ts, '%Y-%m') order by ts, event_id) n from events),
    w(event_id, month, n, cost_cents, spent) as (select event_id, month, n, cost_cents, 0::bigint from e where n=1
    union all select e.event_id, e.month, e.n, e.cost_cents, case when spent>=1000 then spent else
    spent+greatest(w.cost_cents, 0) end from w join e on e.month=w.month and e.n=w.n+1)
    select event_id, month, cost_cents, spent spent_before, spent>=1000 blocked from w""")
def budget_gate(spark, sf_dir):
    from docaudit.functions import text as T
    calls = _events(spark, sf_dir).select(
        "event_id", "ts", (F.floor("value") - 5).cast("bigint").alias("cost_cents"))
    return E.budget_gate(calls, T.month_key(c("ts")), D.micros(c("ts"))).drop("ts")


O.add_view("e_outbox", """select event_id, min(analysis_id) analysis_id, min(t) created_at, max(case when ok
    then t end) published_at, count(case when not ok then 1 end) attempts, case when max(case when ok then t
    end) is null then left(arg_max(error, case when not ok then t end), 500) end last_error from (
    select concat(user_id, '/', day(ts)) event_id, user_id analysis_id, epoch_us(ts) t, event_type='purchase'
    ok, repeat(props, 50) error from events where event_type in ('purchase', 'error')) group by 1""", [])


def _outbox(spark, sf_dir):
    log = _events(spark, sf_dir).filter("event_type IN ('purchase', 'error')").select(
        F.concat_ws("/", "user_id", F.dayofmonth("ts")).alias("event_id"),
        c("user_id").alias("analysis_id"), D.micros(c("ts")).alias("at"),
        (c("event_type") == "purchase").alias("ok"), F.repeat("props", F.lit(50)).alias("error"))
    return E.outbox_state(log)


@query("outbox_state", with_views("select * from e_outbox", "e_outbox"))
def outbox_state(spark, sf_dir):
    return _outbox(spark, sf_dir)


@query("pending_batch", with_views("""select event_id, created_at, attempts from e_outbox where published_at is
    null and attempts<10 order by created_at, event_id limit 50""", "e_outbox"))
def pending_batch(spark, sf_dir):
    return E.pending_batch(_outbox(spark, sf_dir)).select("event_id", "created_at", "attempts")


@query("outbox_diagnostics", with_views("""select analysis_id, sum(attempts)::bigint attempts, count(case when
    published_at is null then 1 end) pending, arg_max(last_error, case when last_error is not null then event_id
    end) last_error, coalesce(max(d), 0) dead_letters from e_outbox left join (select analysis_id, count(*) d from
    e_letters group by 1) using (analysis_id) group by 1""", "e_outbox", "e_letters"))
def outbox_diagnostics(spark, sf_dir):
    return V.outbox_diagnostics(_outbox(spark, sf_dir), _dead(spark, sf_dir).letters)


@query("registered_requests", """select doc_id::varchar analysis_id, strlen(text)::bigint size, sha256(text)
    sha256, 'RECEBIDA' state, doc_id::varchar as key, json_extract_string(to_json({'s': sha256(text)}), '$.s')
    event_sha from documents""")
def registered_requests(spark, sf_dir):
    requests = D.table(spark, sf_dir, "documents").select(
        c("doc_id").cast("string").alias("analysis_id"), F.lit(1).alias("owner_id"),
        F.concat("doc_id", F.lit(".docx")).alias("name"), F.lit("application/octet-stream").alias("mime"),
        c("text").cast("binary").alias("content"), c("doc_id").cast("string").alias("correlation_id"),
        F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("at"))
    made = E.register_requests(requests)
    events = made.events.select("key", F.get_json_object("value", "$.sha256").alias("event_sha"))
    return made.analyses.select("analysis_id", "size", "sha256", "state").join(
        events, c("analysis_id") == c("key"))


def _event_stream(spark, sf_dir):
    return (spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir))


@query("streamed_unique_events", "select event_id, user_id, event_type from events")
def streamed_unique_events(spark, sf_dir):
    """Every event arrives twice; the stream keeps one."""
    events = _event_stream(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp"))
    twice = S.deduplicated(events.unionByName(events), "ts", "60 days")
    return S.run_to_table(twice.select("event_id", "user_id", "event_type"),
                          new_folder(spark, "unique"), new_folder(spark, "unique-state"))


@query("streamed_transitions", ORACLES["state_transitions"])
def streamed_transitions(spark, sf_dir):
    """The state machine as a stream over the same log."""
    log = D.event_log_of(_event_stream(spark, sf_dir)).withColumn("at", D.micros(c("ts")))
    with S.keyed_state(spark):
        return S.run_to_table(S.transitions(log), new_folder(spark, "transitions"), new_folder(spark, "transitions-state"))


@query("streamed_analyses", with_views("""select a.analysis_id, events, case when d.doc_id%31=3 then 'CONCLUIDA' when d.doc_id is
    null and a.analysis_id%2=1 then null when d.doc_id is null or d.doc_id not in (select doc_id from k_ok) then 'FALHOU' else
    'CONCLUIDA' end state, case when d.doc_id%31=3 then null when d.doc_id is null and a.analysis_id%2=1 then 'AnaliseNaoEncontrada'
    when d.doc_id is null then 'BinarioAusente' when d.doc_id not in (select doc_id from k_ok) then 'ParteIlegivel' end exception,
    case when d.doc_id%31=3 then 0 else coalesce(n, 0) end findings from (select event_id//5 analysis_id, count(*) events
    from events group by 1) a left join documents d on d.doc_id=a.analysis_id left join (select doc_id, count(*) n from k_findings
    group by 1) f on f.doc_id=a.analysis_id""", "k_ok", "k_findings"))
def streamed_analyses(spark, sf_dir):
    """Every event asks for the analysis of a document, five for each; some documents are missing, some analyses unknown or
    at their end. The stream is consumed twice, the second time without its checkpoint: the ledger knows all."""
    documents = D.table(spark, sf_dir, "documents").select("doc_id")
    stream = _event_stream(spark, sf_dir).select("event_id", F.floor(c("event_id") / 5).alias("analysis_id"), c("ts").alias("occurred_at"))
    asked = _events(spark, sf_dir).select(F.floor(c("event_id") / 5).alias("analysis_id")).distinct()
    packages = cut_lineage(document_packages(spark, sf_dir, asked.withColumnRenamed("analysis_id", "doc_id")).withColumnRenamed("doc_id", "analysis_id"))
    known = asked.join(documents.withColumnRenamed("doc_id", "analysis_id").withColumn("there", F.lit(True)), "analysis_id", "left").filter(
        "there or analysis_id % 2 = 0")
    analyses = cut_lineage(known.select("analysis_id", F.when(c("there") & (c("analysis_id") % 31 == 3), "CONCLUIDA").otherwise("RECEBIDA").alias("state")))
    ledger, output = new_folder(spark, "ledger"), new_folder(spark, "analyses")
    for _ in range(2):
        S.consume(stream, S.analyse(packages, analyses), ledger, output, new_folder(spark, "consumption"), lambda _: analyses,
                  F.to_date("occurred_at")).awaitTermination()
    last = committed(spark, output, "states").groupBy("analysis_id").agg(F.max_by("state", "step").alias("last"))
    letters = committed(spark, output, "dead_letters").select("analysis_id", "exception")
    found = committed(spark, output, "findings").groupBy(c("doc_id").alias("analysis_id")).agg(F.count(F.lit(1)).alias("findings"))
    booked = spark.read.parquet(ledger).join(_events(spark, sf_dir), "event_id").groupBy(F.floor(c("event_id") / 5).alias("analysis_id")).agg(F.count(F.lit(1)).alias("events"))
    rows = booked.join(analyses, "analysis_id", "left").withColumn("analysis_id", c("analysis_id").cast("string"))
    for table in (last, letters, found):
        rows = rows.join(table, "analysis_id", "left")
    return rows.select(c("analysis_id").cast("bigint").alias("analysis_id"), "events", F.coalesce("last", "state").alias("state"),
                       "exception", F.coalesce("findings", F.lit(0)).alias("findings"))
