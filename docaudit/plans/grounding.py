"""Guards, prompts and recommendations: questions are the given conversation turns."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import grounding as G
from docaudit.operators import rules as R
from docaudit.operators import views as V
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.plans.scalars import marked_turns
from docaudit.session import cut_lineage
from docaudit.sources import derived as D

c = F.col
_CITE = """case when (conv_id+turn)%5=0 then '' else concat(text, case (conv_id+turn)%4 when 0 then
    ' criterio 1.1.1' when 1 then ' fere 1.4.3 e 2.4.4' when 2 then ' (3.1.1)' else '' end) end"""
O.add_view("g_questions", f"select conv_id doc_id, turn question_id, {_CITE} question "
           "from conversations", [])
O.add_view("g_criteria", """select doc_id, string_agg(criterion, ', ' order by criterion) t,
    list(criterion) l from (select distinct doc_id, criterion from findings) group by 1""", ["findings"])
O.add_view("g_unfounded", rf"""select q.*, t, list_filter(case when trim(question)='' then [] else
    regexp_extract_all(question, '{C.CRITERION}', 1) end, lambda x: not list_contains(coalesce(l, []), x)) u
    from g_questions q left join g_criteria using (doc_id)""", ["g_questions", "g_criteria"])
O.add_view("g_guarded", """select doc_id, question_id, question, case when t is null or len(u)>0 then
    'RECUSADA' else 'ACEITA' end status, case when t is null then
    'a analise nao encontrou problema nenhum: nao ha o que recomendar' when len(u)>0 then concat(
    'a pergunta cita ', array_to_string(u, ', '), ', que esta analise nao verificou. O sistema so responde '
    'sobre o que mediu: ', t) end reason from g_unfounded""".replace("responde '\n    'sobre", "responde sobre"),
    ["g_unfounded"])


def questions(spark, sf_dir):
    """Every conversation turn as a question to the document of the same number."""
    k = c("conv_id") + c("turn")
    cite = (F.when(k % 4 == 0, " criterio 1.1.1").when(k % 4 == 1, " fere 1.4.3 e 2.4.4")
            .when(k % 4 == 2, " (3.1.1)").otherwise(""))
    text = F.when(k % 5 == 0, "").otherwise(F.concat("text", cite))
    return D.table(spark, sf_dir, "conversations").select(
        c("conv_id").alias("doc_id"), c("turn").alias("question_id"), text.alias("question"))


def _findings(spark, sf_dir):
    return R.run_rules(D.facts(spark, sf_dir))


@query("guarded_questions", with_views("select * from g_guarded", "g_guarded"))
def guarded_questions(spark, sf_dir):
    return G.guard_questions(questions(spark, sf_dir), _findings(spark, sf_dir))


@query("guarded_replies", with_views("""select doc_id, question_id reply_id, case when len(u)>0 then
    concat('a resposta citou ', array_to_string(u, ', '), ', que esta analise nao verificou, e foi descartada')
    end reason, len(u)=0 accepted from g_unfounded""", "g_unfounded"))
def guarded_replies(spark, sf_dir):
    replies = questions(spark, sf_dir).select("doc_id", c("question_id").alias("reply_id"),
                                              c("question").alias("reply"))
    return G.guard_replies(replies, _findings(spark, sf_dir))


O.add_view("g_recs", """select o_orderkey doc_id, unnest(['titulo_ausente', 'IDIOMA_NAO_DECLARADO',
    'REGRA_INVENTADA', null]) rule_id from orders""", [])


def _recommendations(spark, sf_dir):
    ids = F.array(F.lit("titulo_ausente"), F.lit("IDIOMA_NAO_DECLARADO"), F.lit("REGRA_INVENTADA"),
                  F.lit(None).cast("string"))
    return D.table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("doc_id"), F.explode(ids).alias("rule_id"))


@query("grounded_recommendations", with_views("""select doc_id, rule_id from g_recs where exists (
    select 1 from findings f where f.doc_id=g_recs.doc_id and f.rule_id=upper(g_recs.rule_id))""",
    "g_recs", "findings"))
def grounded_recommendations(spark, sf_dir):
    return G.filter_recommendations(_recommendations(spark, sf_dir), _findings(spark, sf_dir))[0]


@query("dropped_recommendations", with_views("""select doc_id, count(*) dropped from g_recs where not
    exists (select 1 from findings f where f.doc_id=g_recs.doc_id and f.rule_id=upper(g_recs.rule_id))
    group by 1""", "g_recs", "findings"))
def dropped_recommendations(spark, sf_dir):
    return G.filter_recommendations(_recommendations(spark, sf_dir), _findings(spark, sf_dir))[1]


@query("cited_rules", with_views("""select doc_id, string_agg(concat(rule_id, ' (', criterion, ')'), ', '
    order by p, rule_id) citations from (select doc_id, rule_id, criterion, min(length(evidence)) p
    from findings group by all) group by 1""", "findings"))
def cited_rules(spark, sf_dir):
    found = _findings(spark, sf_dir).withColumn("seq", F.length("evidence"))
    return G.cited_rules(found)


@query("sanitized_findings", with_views("select doc_id, rule_id, criterion, severity, evidence "
                                        "from findings", "findings"))
def sanitized_findings(spark, sf_dir):
    return G.sanitized_findings(_findings(spark, sf_dir))


@query("prompt_blocks", with_views("""select doc_id, 0 section, 0::bigint as position, '{0}' block from (
    select distinct doc_id from findings) union all select doc_id, 1, n, concat('- ', rule_id, ' (',
    criterion, ', severidade ', severity, ')', chr(10), '<<EVIDENCIA:', s, '>>', chr(10), evidence, chr(10),
    '<</EVIDENCIA:', s, '>>') from (select *, left(sha256(concat('t/', doc_id, '/', n)), 16) s from (
    select *, row_number() over (partition by doc_id order by sha256(concat(rule_id, '/', evidence))) n from findings))
    """.format(G.INSTRUCTION.replace("'", "''")), "findings"))
def prompt_blocks(spark, sf_dir):
    return G.prompt_blocks(_findings(spark, sf_dir), seed="t")


@query("last_turns", """select conv_id, turn, role from (select *, row_number() over (partition by conv_id
    order by turn desc) o from conversations) where o<=5""")
def last_turns(spark, sf_dir):
    return G.last_turns(D.table(spark, sf_dir, "conversations"), n=5).select("conv_id", "turn", "role")


@query("next_exchange", "select conv_id, (count(*)//2+1)::bigint next_exchange from conversations group by 1")
def next_exchange(spark, sf_dir):
    return G.turn_number(D.table(spark, sf_dir, "conversations"))


O.add_view("g_existing", "select * from findings join (select doc_id from d_docs where title is null) "
           "using (doc_id)", ["findings", "d_docs"])


@query("generated_recommendations", with_views("""select doc_id, rule_id, count(*) n from findings where
    doc_id in (select doc_id from d_docs where state='CONCLUIDA') and doc_id not in (select doc_id from
    g_existing) group by all""", "findings", "d_docs", "g_existing"))
def generated_recommendations(spark, sf_dir):
    facts = D.facts(spark, sf_dir)
    # Written, so that the joins don't go below the rules, where one task would sort the rows of all of them.
    found = cut_lineage(R.run_rules(facts).select("doc_id", "rule_id", "criterion"))
    untitled = facts.docs.filter("title IS NULL").select("doc_id")
    existing = V.recommend(found.join(untitled, "doc_id", "left_semi"))
    stored, _ = G.generate_recommendations(facts.docs, found, existing)
    return stored.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("appended_turns", with_views("""select doc_id, question_id, unnest([0, 1]) half, unnest(['USUARIO',
    'ASSISTENTE']) role, unnest([question, concat('resposta ', question_id)]) as text, unnest([null, 'FIXTURE'])
    provenance from g_guarded where status='ACEITA' and trim(question)<>''""", "g_guarded"))
def appended_turns(spark, sf_dir):
    guarded = G.guard_questions(questions(spark, sf_dir), _findings(spark, sf_dir))
    return G.append_turns(guarded.withColumn("reply", F.concat(F.lit("resposta "), "question_id"))).select(
        "doc_id", "question_id", "half", "role", "text", "provenance")
