"""Rules, findings, scores and views over the derived documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.operators import rules as R
from docaudit.operators import score as S
from docaudit.operators import views as V
from docaudit.plans.oracle import alt_quality, with_views
from docaudit.plans.registry import query
from docaudit.session import cut_lineage, new_folder
from docaudit.sources import derived as D
from docaudit.sources.catalog import catalogue
from docaudit.sources.stored import store

c = F.col
_NAMES = ("image", "table", "heading", "title", "link", "language")


def _rule(index: int):
    def run(spark, sf_dir):
        return R.run_rules(D.facts(spark, sf_dir, shared=False), [R.RULES[index]])
    return run


for _i, _name in enumerate(_NAMES):
    query(f"rule_{_name}", with_views(f"select * from f_{_name}", f"f_{_name}"))(_rule(_i))


@query("rule_engine_counts", with_views(
    """select rule_id, criterion, level, severity, count(*) findings,
       count(distinct doc_id) documents from findings group by all""", "findings"))
def rule_engine_counts(spark, sf_dir):
    return R.run_rules(D.facts(spark, sf_dir)).groupBy(
        "rule_id", "criterion", "level", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


@query("evaluated_principles", with_views(
    """select case left(criterion, 1) when '1' then 'PERCEPTIVEL' when '2' then 'OPERAVEL'
       when '3' then 'COMPREENSIVEL' else 'ROBUSTO' end principle, count(*) findings
       from findings group by 1""", "findings"))
def evaluated_principles(spark, sf_dir):
    from docaudit.functions import text as T
    return R.run_rules(D.facts(spark, sf_dir)).groupBy(
        T.principle_of(F.col("criterion")).alias("principle")).agg(
        F.count(F.lit(1)).alias("findings"))


@query("findings_with_catalogue", with_views(
    "select criterion, criterion_title, applicability, count(*) findings from findings join "
    "(values " + ", ".join(f"('{c}', '{t}', '{a.upper()}')" for c, t, _, a in C.CRITERIA)
    + ") v(criterion, criterion_title, applicability) using (criterion) group by all", "findings"))
def findings_with_catalogue(spark, sf_dir):
    found = R.with_catalogue(R.run_rules(D.facts(spark, sf_dir)), catalogue(spark))
    return found.groupBy("criterion", "criterion_title", "applicability").agg(
        F.count(F.lit(1)).alias("findings"))


def _findings(spark, sf_dir):
    facts = D.facts(spark, sf_dir)
    return facts, R.run_rules(facts)


@query("principle_scores", with_views("select * from principle_scores", "principle_scores"))
def principle_scores(spark, sf_dir):
    facts, found = _findings(spark, sf_dir)
    return S.principle_scores(facts.docs, found)


@query("global_scores", with_views("select * from global_scores", "global_scores"))
def global_scores(spark, sf_dir):
    facts, found = _findings(spark, sf_dir)
    return S.global_scores(facts.docs, found)


@query("score_of_finished", with_views(
    """select doc_id, state, case when state='CONCLUIDA' then global_score end global_score
       from d_docs join global_scores using (doc_id)""", "d_docs", "global_scores"))
def score_of_finished(spark, sf_dir):
    facts, found = _findings(spark, sf_dir)
    return S.score_of_finished(S.global_scores(facts.docs, found), facts.docs)


_COUNT = "(select doc_id, count(*) n from {} group by 1)"


@query("document_summary", with_views(
    """select doc_id, coalesce(i.n, 0) images, coalesce(t.n, 0) tables, coalesce(h.n, 0) headings,
       coalesce(l.n, 0) links, coalesce(f.n, 0) findings, coalesce(p.n, 0) predictions
       from d_docs left join """ + " left join ".join(
        f"(select doc_id, count(*) n from {t} group by 1) {a} using (doc_id)" for t, a in (
            ("d_images", "i"), ("d_tables", "t"), ("d_headings", "h"), ("d_links", "l"),
            ("findings", "f"), ("(select * from d_images where alt is not null and trim(alt)<>'')",
                                "p"))),
    "d_docs", "d_images", "d_tables", "d_headings", "d_links", "findings"))
def document_summary(spark, sf_dir):
    facts, found = _findings(spark, sf_dir)
    scored = facts.images.filter(Q.alt_state(F.col("alt")) == C.ALT_PRESENT)
    return V.document_summary(facts, found, scored)


@query("alt_state_counts", with_views(
    """select part, case when alt is null then 'AUSENTE' when trim(alt)='' then 'VAZIO'
       else 'PRESENTE' end alt_state, count(*) images from d_images group by all""", "d_images"))
def alt_state_counts(spark, sf_dir):
    return D.images(spark, sf_dir).groupBy(
        "part", Q.alt_state(F.col("alt")).alias("alt_state")).agg(
        F.count(F.lit(1)).alias("images"))


@query("alt_predictions", with_views(
    f"""select doc_id, row_number() over (partition by doc_id order by seq)-1 as idx, part,
        name, alt, {alt_quality('trim(alt)')} category, cast(null as double) confidence,
        true used_heuristic, cast(null as varchar) model_version from d_images
        where alt is not null and trim(alt)<>''""", "d_images"))
def alt_predictions(spark, sf_dir):
    return V.alt_predictions(D.images(spark, sf_dir))


@query("positional_predictions", with_views(
    f"""select * from (with i as (select doc_id, seq, alt, row_number() over (partition by doc_id order by seq)
        rn, count(*) over (partition by doc_id) n from d_images where alt is not null and
        trim(alt)<>''), r as (select doc_id, seq, {alt_quality('trim(alt)')} category,
        row_number() over (partition by doc_id order by seq) rn,
        count(*) over (partition by doc_id) n from d_images where alt is not null and
        trim(alt)<>'' and not (doc_id%9=0 and seq=1))
        select i.doc_id, i.rn-1 as idx, i.alt, case when i.doc_id%4=0 and i.rn=2 then null
        else r.category end category from i join r on i.doc_id=r.doc_id and i.rn=r.rn
        where i.n=r.n and not (i.doc_id%4=0 and i.rn=2))""", "d_images"))
def positional_predictions(spark, sf_dir):
    """Answers that come back by position: some documents lose one, some have an empty one."""
    images = D.images(spark, sf_dir).filter(Q.alt_state(F.col("alt")) == C.ALT_PRESENT)
    answers = images.filter(~((F.col("doc_id") % 9 == 0) & (F.col("seq") == 1))).select(
        "doc_id", "seq", Q.alt_quality(F.col("alt")).alias("category"))
    return V.join_by_position(images.select("doc_id", "seq", "alt"), answers, blank=(
        (F.col("doc_id") % 4 == 0) & (F.col("idx") == 1)))


@query("finding_recommendations", with_views(
    "select doc_id, rule_id, criterion, case rule_id " + " ".join(
        "when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in C.RECOMMENDATIONS.items())
    + f" else '{C.DEFAULT_RECOMMENDATION}' end as text, 'FIXTURE' provenance, 'fixture-local' model "
    "from findings", "findings"))
def finding_recommendations(spark, sf_dir):
    return V.recommend(_findings(spark, sf_dir)[1])


@query("analysis_headers", with_views(
    """select doc_id, owner_id, state, title, coalesce(n, 0) total_findings,
       coalesce(p, 0) total_predictions, case when state='CONCLUIDA' then global_score end
       global_score from d_docs join global_scores using (doc_id)
       left join (select doc_id, count(*) n from findings group by 1) using (doc_id)
       left join (select doc_id, count(*) p from d_images where alt is not null and
       trim(alt)<>'' group by 1) using (doc_id)""",
    "d_docs", "global_scores", "findings", "d_images"))
def analysis_headers(spark, sf_dir):
    """The view of many owners at once, each row with its owner."""
    facts, found = _findings(spark, sf_dir)
    view = V.analysis_view(facts.docs, found, V.alt_predictions(facts.images))
    return view.headers


@query("owner_findings", with_views(
    """select doc_id, rule_id, evidence from findings semi join
       (select * from d_docs where owner_id=37) using (doc_id)""", "findings", "d_docs"))
def owner_findings(spark, sf_dir):
    """The owner's documents come first: only their lines are numbered and judged."""
    mine = cut_lineage(D.docs(spark, sf_dir).filter("owner_id = 37"))
    facts = D.facts(spark, sf_dir, only=mine)
    view = V.analysis_view(mine, cut_lineage(R.run_rules(facts)), V.alt_predictions(facts.images))
    return V.of_owner(view, F.lit(37)).findings.select("doc_id", "rule_id", "evidence")


@query("owner_findings_by_time", with_views(
    """select owner_id, row_number() over (partition by owner_id order by created_at, doc_id, rule_id, evidence)
       as position, created_at, doc_id, rule_id, evidence from findings join d_docs using (doc_id) join (select o_orderkey doc_id,
       epoch_us(o_orderdate) created_at from orders) using (doc_id) where owner_id in (37, 38, 40)""", "findings", "d_docs"))
def owner_findings_by_time(spark, sf_dir):
    """All findings are stored in order of each owner's time; three owners read theirs, without a sort."""
    facts, found = _findings(spark, sf_dir)
    of = D.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"), c("o_custkey").alias("owner_id"),
                                                 D.micros(c("o_orderdate")).alias("created_at"))
    rows = found.join(of, "doc_id").select("owner_id", "created_at", "doc_id", "rule_id", "evidence")
    table = store(rows, new_folder(spark, "findings-by-owner"), "owner_id", ["created_at", "doc_id", "rule_id", "evidence"], c("created_at"))
    return reduce(DataFrame.unionByName, [table.of(spark, owner) for owner in (37, 38, 40)])


@query("retention_cascade", with_views(
    """select child, count(*) kept from (
       select doc_id, 'findings' child from findings union all
       select doc_id, 'images' from d_images union all select doc_id, 'links' from d_links)
       where doc_id in (select doc_id from d_docs where state<>'RECEBIDA') group by 1""",
    "findings", "d_docs", "d_images", "d_links"))
def retention_cascade(spark, sf_dir):
    facts, found = _findings(spark, sf_dir)
    surviving = facts.docs.filter("state <> 'RECEBIDA'")
    # Counted by document and written first: else the join goes below the rules, and one task sorts the rows of all of them.
    children = {"findings": found, "images": facts.images, "links": facts.links}
    counted = {n: cut_lineage(df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))) for n, df in children.items()}
    kept = V.cascade(surviving, counted)
    parts = [df.select(F.lit(name).alias("child"), "n") for name, df in kept.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("child").agg(F.sum("n").alias("kept"))
