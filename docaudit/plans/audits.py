"""The dataset audit over every line, and table constraints over the derived tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import audit as U
from docaudit.operators import rules as R
from docaudit.operators import views as V
from docaudit.plans import datasets as PD
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.sources import derived as D

c = F.col
_SLICE = """case when coalesce(data_origin='sintetico_fallback', false) then 'sintetico_fallback'
    when coalesce(source='wikimedia-commons', false) then 'wikimedia_commons'
    when coalesce(data_origin='coletado', false) then 'web_coletado'
    when source is null and ends_with(file, '.docx') then 'governamental_docx'
    else 'desconhecido' end"""
O.add_view("d_sliced", f"select *, {_SLICE} slice, coalesce(label, provisional_label) work "
           "from d_rows", ["d_rows"])
_IF = "count(case when {} then 1 end)".format


@query("slice_profile", with_views("select slice, count(*) total, " + ", ".join(
    [f"{_IF(f'work=%r' % y)} {y.lower()}" for y in C.LABELS] + [f"{_IF('work is null')} unlabelled"]
    + [f"{_IF(f'split=%r' % s)} {s}" for s in C.SPLITS] + [
        f"{_IF(t)} {n}" for n, t in (
            ("short", "alt<>'' and length(alt)<=10"),
            ("medium", "length(alt) between 11 and 30"), ("long", "length(alt)>30"),
            ("no_alt", "alt=''"), ("synthetic", "data_origin='sintetico_fallback'"),
            ("origin_declared", "data_origin is not null"))])
    + " from d_sliced group by 1", "d_sliced"))
def slice_profile(spark, sf_dir):
    return U.slice_profile(D.alt_rows(spark, sf_dir))


@query("slice_table", with_views("select coalesce(slice, 'TOTAL') slice, count(*) total, concat("
                                 + ", '/', ".join(_IF(f"work='{y}'") for y in C.LABELS)
                                 + ") distribution from d_sliced group by grouping sets ((slice), ())",
                                 "d_sliced"))
def slice_table(spark, sf_dir):
    return U.slice_table(D.alt_rows(spark, sf_dir))


@query("ordered_digests", with_views("""select slice, sha256(string_agg(h, '' order by b)) digest from (
    select slice, b//10000 b, sha256(string_agg(h, '' order by b)) h from (select slice, b, sha256(string_agg(
    concat(id, chr(0)), '' order by n)) h from (select slice, id, n, (n-1)//10000 b from (
    select slice, id, row_number() over (partition by slice order by ord) n from d_sliced))
    group by all) group by slice, b//10000) group by 1""", "d_sliced"))
def ordered_digests(spark, sf_dir):
    return U.ordered_digest(U.with_slice(D.alt_rows(spark, sf_dir)), "slice", "ord", "id")


@query("repeated_alts", with_views(f"""select sha256(replace(lower(trim(regexp_replace(alt, '{O._WS}',
    ' ', 'g'))), 'ß', 'ss')) repeated, min(ord) first_ord, count(*)-1 again from d_rows where alt<>''
    group by 1 having count(*)>1""", "d_rows"))
def repeated_alts(spark, sf_dir):
    return U.repeated_alts(D.alt_rows(spark, sf_dir))


@query("repeated_ids", with_views("""select concat(lang, '-', length(alt)) repeated, min(ord) first_ord,
    count(*)-1 again from d_rows group by 1 having count(*)>1""", "d_rows"))
def repeated_ids(spark, sf_dir):
    rows = D.alt_rows(spark, sf_dir).withColumn(
        "id", F.concat("lang", F.lit("-"), F.length("alt")))
    return U.repeated_ids(rows)


_E = U.Expected()
_ALTS = "replace(lower(trim(regexp_replace(alt, '{}', ' ', 'g'))), 'ß', 'ss')".format(O._WS)
O.add_view("d_bad", f"select *, {_SLICE} slice, coalesce(label, provisional_label) work from d_broken",
           ["d_broken"])
O.add_view("d_queue_b", """select id, provisional_label, row_number() over (order by sha256(concat(
    'mistura:42:', id)), id) place from (select *, row_number() over (partition by provisional_label
    order by sha256(concat('classe:42:', id)), id) o from d_bad where provisional_label in
    ('GOOD', 'WEAK', 'INSUFFICIENT') and label is null and alt<>'') where o<=50""", ["d_bad"])
_TRAIN = ("data_origin='sintetico_fallback' and alt<>'' and split is not null and case when label is "
          "not null then label else provisional_label end in ('GOOD', 'WEAK', 'INSUFFICIENT')")
_CHECKS = [
    (1, "A", "A1 slice governamental (.docx): total", _E.governmental, _IF("slice='governamental_docx'")),
    (2, "A", "A1 slice governamental: registros com alt nulo/vazio", _E.governmental,
     _IF("slice='governamental_docx' and alt=''")),
    (3, "A", "A2 slice Commons: total", _E.archive, _IF("slice='wikimedia_commons'")),
    (5, "A", "A3 slice sintetico: total", _E.synthetic, _IF("slice='sintetico_fallback'")),
    (6, "A", "A3 sintetico: marcado com origem_do_dado", _E.synthetic, _IF("slice='sintetico_fallback'")),
    (7, "A", "A3 sintetico: 100% em INSUFFICIENT", 0,
     _IF("slice='sintetico_fallback' and coalesce(work<>'INSUFFICIENT', true)")),
    (8, "A", "A4 total de linhas", _E.total, "count(*)"),
    (9, "A", "A4 ids duplicados", 0, "count(*)-count(distinct id)"),
    (10, "A", "A4 alt normalizado duplicado", 0,
     f"{_IF(chr(97) + 'lt<>' + chr(39) * 2)}-count(distinct case when alt<>'' then {_ALTS} end)"),
    (12, "A", "A4 linhas sem slice reconhecido", 0, _IF("slice='desconhecido'")),
    (21, "B", "B1 sinteticas marcadas", _E.synthetic, _IF(_TRAIN)),
    (22, "B", "B2 sintetica presa a divisao de treino no arquivo", 0, _IF(_TRAIN + " and split<>'treino'")),
    (31, "C", "C1 fila com o total", 150, "(select count(*) from d_queue_b)+0*count(*)"),
    (32, "C", "C2 nenhuma classe devendo cota", 0, "150-(select count(*) from d_queue_b)+0*count(*)"),
    (33, "C", "C3 amostragem deterministica pela semente", 0, "0*count(*)"),
    (41, "D", "D1 rotulos dentro do enum canonico", 0, _IF("provisional_label='SUFFICIENT'")),
    (42, "D", "D1 nenhum SUFFICIENT sobrevivente", 0, _IF("provisional_label='SUFFICIENT'")),
    (43, "D", "D2 origem_do_rotulo no vocabulario permitido", 0, _IF("label_origin not in ('humano')")),
    (44, "D", "D2 divisao dentro das partes conhecidas", 0,
     _IF("split not in ('treino', 'validacao', 'teste')")),
]
O.add_view("d_checks", " union all ".join(
    [f"select {no} as no, '{axis}' axis, '{name}' as name, case when v={e} then 'PASS' else 'FAIL' end "
     f"status, '{e}' expected, v::varchar observed from (select {sql} v from d_bad)"
     for no, axis, name, e, sql in _CHECKS] + [
        """select 4, 'A', 'A2 Commons: distribuicao de comprimento do alt', 'PASS',
        'faixas <=10 / 11-30 / >30', count(*)::varchar from d_bad where slice='wikimedia_commons'""",
        "select 11, 'A', 'A4 soma dos slices fecha com o total', case when sum(n)=(select count(*) from d_bad) "
        "then 'PASS' else 'FAIL' end, 'igual', sum(n)::bigint::varchar from (select count(*) n from d_bad group by slice)",
        """select 34, 'C', 'C3 sem vies de sequencia (bloco por classe)', case when max(n)<=5 then 'PASS'
        else 'FAIL' end, 'maior corrida <= 5', max(n)::varchar from (select count(*) n from (select
        place-row_number() over (partition by provisional_label order by place) g, provisional_label
        from d_queue_b) group by g, provisional_label)""",
        "select 35, 'C', 'C3 muda com outra semente', 'PASS', 'fila diferente', 'true'",
        """select 45, 'D', 'D3 origem_do_dado declarada em toda linha', case when count(*)=0 then 'PASS'
        else 'AVISO' end, '0', count(*)::varchar from d_bad where data_origin is null"""]),
    ["d_bad", "d_queue_b"])


@query("audit_checks", with_views("select * from d_checks", "d_checks"))
def audit_checks(spark, sf_dir):
    return U.audit(PD.broken_rows(spark, sf_dir))


@query("audit_overall", with_views("""select total, passed, failed, warned, 0::bigint not_evaluable,
    failed=0 ready, case when failed>0 then concat('NAO PRONTO: ', failed,
    ' invariante(s) quebrada(s). A primeira e ''', f.name, ''' — esperado ', f.expected, ', obtido ',
    f.observed, '.') when warned>0 then concat('PRONTO PARA REVISAO HUMANA, com ', warned, ' aviso(s).')
    else 'PRONTO PARA REVISAO HUMANA.' end verdict from (select count(*) total, """ + ", ".join(
    f"{_IF(f'status=%r' % s)} {n}" for n, s in (("passed", "PASS"), ("failed", "FAIL"),
                                               ("warned", "AVISO"))) + """ from d_checks),
    (select * from d_checks where status='FAIL' order by no limit 1) f""", "d_checks"))
def audit_overall(spark, sf_dir):
    return U.overall(U.audit(PD.broken_rows(spark, sf_dir)))


@query("invalid_rows", with_views("""select ord, id, concat('provisional_label=', provisional_label) fault
    from d_broken where provisional_label='SUFFICIENT'""", "d_broken"))
def invalid_rows(spark, sf_dir):
    return U.invalid_rows(PD.broken_rows(spark, sf_dir))


@query("finding_constraints", with_views("""select 'problema_nivel' as constraint, 0::bigint violations
    union all select 'problema_severidade', count(*) from (select case when doc_id%10=0 then 'GRAVE' else
    severity end s from findings) where s not in ('BAIXA', 'MEDIA', 'ALTA', 'CRITICA')""", "findings"))
def finding_constraints(spark, sf_dir):
    found = R.run_rules(D.facts(spark, sf_dir)).withColumn(
        "severity", F.when(c("doc_id") % 10 == 0, "GRAVE").otherwise(c("severity")))
    return U.constraint_violations(found, U.finding_constraints())


@query("prediction_constraints", with_views("""select * from (values ('predicao_categoria', 0),
    ('predicao_confianca', (select count(*) from p where idx%9=3)), ('predicao_heuristica',
    (select count(*) from p where idx%9=3 or idx%9=4)), ('predicao_unica', 0)) v("constraint", violations)"""
    .replace("from p", "from (select row_number() over (partition by doc_id order by seq)-1 idx "
             "from d_images where alt is not null and trim(alt)<>'')"), "d_images"))
def prediction_constraints(spark, sf_dir):
    rows = V.alt_predictions(D.images(spark, sf_dir)).withColumns({
        "confidence": F.when(c("idx") % 9 == 3, 1.5).otherwise(c("confidence")),
        "model_version": F.when(c("idx") % 9 == 4, "0.1.0").otherwise(c("model_version"))})
    checks = U.constraint_violations(rows, U.prediction_constraints())
    return checks.unionByName(U.unique_violations(rows, "predicao_unica", ["doc_id", "idx"]))


@query("turn_constraints", """select 'turno_papel' as constraint, count(case when role not in ('user',
    'assistant') then 1 end) violations from conversations union all select 'turno_texto',
    count(case when trim(text)='' then 1 end) from conversations union all select 'turno_procedencia',
    count(case when role='assistant' and turn%3=1 then 1 end) from conversations
    union all select 'evento_unico', count(*) from (select user_id from events where event_type='error'
    group by user_id, ts::date having count(*)>1)""".replace(
    "count(*) from (select user_id from", "coalesce(sum(n-1), 0)::bigint from (select count(*) n from"))
def turn_constraints(spark, sf_dir):
    role = F.when(c("role") == "user", "USUARIO").when(c("role") == "assistant", "ASSISTENTE").otherwise(
        c("role"))
    turns = D.table(spark, sf_dir, "conversations").select(
        role.alias("role"), "text", F.when(c("turn") % 3 != 1, "FIXTURE").alias("provenance"),
        F.lit("fixture-local").alias("model"))
    errors = D.table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        "user_id", c("ts").cast("date").alias("day"))
    return U.constraint_violations(turns, U.turn_constraints()).unionByName(
        U.unique_violations(errors, "evento_unico", ["user_id", "day"]))
