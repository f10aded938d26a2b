"""Agreement, confusion, class metrics and review queues over the labelled lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import dataset as DS
from docaudit.operators import metrics as M
from docaudit.operators.ordered import longest_run
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.sources import derived as D

c = F.col
_SIDES = [(f, y) for f in ("provisional_label", "label") for y in C.LABELS]
O.add_view("d_pairs", """select id, provisional_label, label from d_rows where
    label_origin='humano' and provisional_label is not null""", ["d_rows"])
O.add_view("d_agree", "select *, agreements/total::double po, " + "+".join(
    f"(provisional_label_{y}/total::double)*(label_{y}/total::double)" for y in C.LABELS)
    + " pe from (select count(case when provisional_label=label then 1 end) agreements, "
    "count(*) total, " + ", ".join(f"count(case when {f}='{y}' then 1 end) {f}_{y}"
                                   for f, y in _SIDES) + " from d_pairs)", ["d_pairs"])
_KAPPA = "case when pe>=1 then case when po>=1 then 1.0 else 0.0 end else (po-pe)/(1-pe) end"


def _pairs(spark, sf_dir):
    return DS.registered_reviews(D.alt_rows(spark, sf_dir)).select(
        "id", "provisional_label", "label")


@query("agreement", with_views(f"select *, ({_KAPPA})::double kappa from d_agree", "d_agree"))
def agreement(spark, sf_dir):
    return M.agreement(_pairs(spark, sf_dir), "provisional_label", "label")


@query("confusion", with_views(f"""select truth, predicted, count(id) n from (
    select t.y truth, p.y predicted from (select unnest([{O.values(C.LABELS)}]) y) t,
    (select unnest([{O.values(C.LABELS)}]) y) p) left join d_pairs on label=truth and
    provisional_label=predicted group by all""", "d_pairs"))
def confusion(spark, sf_dir):
    return M.confusion(_pairs(spark, sf_dir), "label", "provisional_label")


O.add_view("d_report", f"""select y as label, s support, pr as precision, re as recall,
    case when pr+re=0 then 0.0 else 2*pr*re/(pr+re) end f1 from (select *,
    coalesce(tp/nullif(p, 0)::double, 0.0) pr, coalesce(tp/nullif(s, 0)::double, 0.0) re from (
    select y, count(case when label=y and provisional_label=y then 1 end) tp,
    count(case when provisional_label=y then 1 end) p, count(case when label=y then 1 end) s
    from (select unnest([{O.values(C.LABELS)}]) y), d_pairs group by 1))""", ["d_pairs"])


@query("class_report", with_views("select * from d_report", "d_report"))
def class_report(spark, sf_dir):
    return M.class_report(_pairs(spark, sf_dir), "label", "provisional_label")


@query("metric_averages", with_views("""select round(avg(precision), 9) macro_precision,
    round(avg(recall), 9) macro_recall, round(avg(f1), 9) macro_f1,
    round(sum(precision*support)/sum(support), 9) weighted_precision,
    round(sum(recall*support)/sum(support), 9) weighted_recall,
    round(sum(f1*support)/sum(support), 9) weighted_f1 from d_report""", "d_report"))
def metric_averages(spark, sf_dir):
    rows = M.averages(M.class_report(_pairs(spark, sf_dir), "label", "provisional_label"))
    return rows.select(*[F.round(x, 9).alias(x) for x in rows.columns])


@query("minority_class", with_views("""select label, recall, precision, f1, support,
    support>=5 evaluable, case when support<5 then concat(support, ' amostra(s) de ', label,
    ' no conjunto avaliado, abaixo do minimo de 5') end reason from d_report
    order by support, label limit 1""", "d_report"))
def minority_class(spark, sf_dir):
    return M.minority_class(M.class_report(_pairs(spark, sf_dir), "label", "provisional_label"))


@query("baseline_verdicts", """with s as (select o_orderkey, (o_orderkey%101)/100.0::double m,
    (o_custkey%89)/88.0::double j, (o_orderkey%67)/66.0::double h from orders)
    select o_orderkey, case when h>=j then 'heuristica' else 'classe majoritaria' end best_baseline,
    m-greatest(j, h) gain, m-greatest(j, h)>0 beats_baselines, case when m<=j then concat(
    'MODELO INUTIL: macro-F1 ', printf('%.3f', m), ' nao supera a classe majoritaria (',
    printf('%.3f', j), '). Ele nao aprendeu nada.') when m<=h then concat(
    'MODELO NAO SE JUSTIFICA: macro-F1 ', printf('%.3f', m), ' contra ', printf('%.3f', h),
    ' da heuristica. Se algumas regras alcancam o modelo, use as regras.') else concat(
    'MODELO SUPERA OS BASELINES: macro-F1 ', printf('%.3f', m), ' contra ', printf('%.3f',
    greatest(j, h)), ' da ', case when h>=j then 'heuristica' else 'classe majoritaria' end, ' (+',
    printf('%.3f', m-greatest(j, h)), ').') end sentence from s""")
def baseline_verdicts(spark, sf_dir):
    scores = D.table(spark, sf_dir, "orders").select(
        "o_orderkey", (c("o_orderkey") % 101 / F.lit(100.0)).alias("m"),
        (c("o_custkey") % 89 / F.lit(88.0)).alias("j"),
        (c("o_orderkey") % 67 / F.lit(66.0)).alias("h"))
    return M.verdict(scores, "m", "j", "h").drop("m", "j", "h")


@query("fold_summary", """select event_type predictor, round(avg(value), 6) mean,
    round(stddev_pop(value), 6) deviation, min(value) minimum, max(value) maximum
    from events group by 1""")
def fold_summary(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").select(c("event_type").alias("predictor"), "value")
    return M.fold_summary(events, "predictor", "value").withColumns({
        "mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("nearest_ranks", """select event_type, count(*) n, round(avg(value), 3) mean, """ + ", ".join(
    f"max(case when rn=least(n-1, floor({f}*n)::bigint)+1 then value end) p{int(f * 100)}"
    for f in (0.5, 0.95, 0.99)) + """, max(value) maximum from (select *, count(*) over
    (partition by event_type) n, row_number() over (partition by event_type order by value, event_id)
    rn from events) group by 1""")
def nearest_ranks(spark, sf_dir):
    return M.nearest_ranks(D.table(spark, sf_dir, "events"), "event_type", "value", "event_id")


O.add_view("d_pending", """select * from d_rows where provisional_label is not null and label is null
    and alt<>''""", ["d_rows"])


def _queue_sql(seed: int) -> str:
    return f"""select id, provisional_label, row_number() over (order by sha256(concat(
    'mistura:{seed}:', id)), id) place from (select *, row_number() over (partition by
    provisional_label order by sha256(concat('classe:{seed}:', id)), id) o from d_pending) where o<=50"""


O.add_view("d_queue", _queue_sql(42), ["d_pending"])


@query("review_queue", with_views("select * from d_queue", "d_queue"))
def review_queue(spark, sf_dir):
    return M.review_queue(M.pending(D.alt_rows(spark, sf_dir))).select(
        "id", "provisional_label", "place")


@query("missing_per_class", with_views(f"""select y as label, greatest(50-count(id), 0) missing from
    (select unnest([{O.values(C.LABELS)}]) y) left join d_pending on provisional_label=y
    group by 1""", "d_pending"))
def missing_per_class(spark, sf_dir):
    return M.missing_per_class(M.pending(D.alt_rows(spark, sf_dir)))


@query("review_report", with_views(f"""select total, total-agreements divergences,
    (total-agreements)/total::double correction_rate, kappa, case when kappa<0 then 'pior que o acaso'
    when kappa<0.2 then 'insignificante' when kappa<0.4 then 'fraca' when kappa<0.6 then 'moderada'
    when kappa<0.8 then 'substancial' else 'quase perfeita' end band, """ + ", ".join(
    f"{f}_{y}" for f, y in _SIDES) + f""", total>=150 and kappa>=0.6 meets, case when total<150 then
    concat('INCOMPLETO: ', total, ' amostras revisadas contra as 150. O kappa de ', printf('%.3f',
    kappa), ' e indicativo.') when kappa<0.6 then concat('NAO ATENDE: kappa ', printf('%.3f', kappa),
    ' abaixo de 0.60.') else 'ATENDE' end verdict from (select *, ({_KAPPA})::double kappa from
    d_agree)""", "d_agree"))
def review_report(spark, sf_dir):
    return M.review_report(_pairs(spark, sf_dir))


@query("queue_longest_run", with_views("""select max(n) longest_run from (select count(*) n from (
    select place-row_number() over (partition by provisional_label order by place) g,
    provisional_label from d_queue) group by g, provisional_label)""", "d_queue"))
def queue_longest_run(spark, sf_dir):
    queue = M.review_queue(M.pending(D.alt_rows(spark, sf_dir)))
    return longest_run(queue.withColumn("all", F.lit(0)), ["all"], ["place"], c("place"),
                       "provisional_label").select("longest_run")


@query("event_longest_runs", """select user_id, max(n) longest_run from (select user_id, count(*) n
    from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id)-
    row_number() over (partition by user_id, event_type order by ts, event_id) g from events)
    group by user_id, event_type, g) group by 1""")
def event_longest_runs(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    return longest_run(events, ["user_id"], ["ts", "event_id"], D.micros(c("ts")), "event_type")
