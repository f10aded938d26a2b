"""Page facts, archive answers, category walks and quota-limited collection."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import collect as K
from docaudit.operators import rules as R
from docaudit.operators import score as S
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.session import cut_lineage
from docaudit.sources import archive as A
from docaudit.sources import derived as D
from docaudit.sources import html as H

c = F.col
_PLAIN = ("replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', '', 'g'), "
          "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")
_NOT_CONTENT = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"


def _each(pattern: str) -> str:
    return (f"select page_id, x[i] tag, i-1 seq from (select page_id, x, unnest(range(1, len(x)+1)) "
            f"i from (select page_id, regexp_extract_all(regexp_replace(html, "
            f"'{_NOT_CONTENT}', '', 'g'), '{pattern}') x from pages))")


# The oracle reads the regular markup of the given pages by pattern; what is planted behind it is known.
O.add_view("p_headings0", f"""select page_id doc_id, 'html' part, seq::int seq, regexp_extract(tag,
    '(?i)^<h([1-6])', 1)::int as level, {_PLAIN.format('tag')} as text from (
    {_each(r'(?is)<h[1-6][^>]*>.*?</h[1-6]>')})""", [])
O.add_view("p_headings", """select * from p_headings0 union all select page_id, 'html', coalesce(n, 0)::int, 3, 'fim'
    from pages left join (select doc_id, count(*) n from p_headings0 group by 1) on doc_id=page_id where page_id%3=2""",
           ["p_headings0"])
O.add_view("p_links0", rf"""select page_id doc_id, 'html' part, seq::int seq,
    {_PLAIN.format('tag')} as text, nullif({_PLAIN.format('h')}, '') target from (select *,
    regexp_extract(tag, '(?is)^<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) h from (
    {_each(r'(?is)<a\b[^>]*>.*?</a>')}))""", [])
O.add_view("p_links", """select * from p_links0 union all select page_id, 'html', coalesce(n, 0)::int, 'Saiba mais',
    concat('/u/', page_id) from pages left join (select doc_id, count(*) n from p_links0 group by 1) on doc_id=page_id
    where page_id%3=1""", ["p_links0"])
O.add_view("p_images", """select page_id doc_id, 'html' part, i::int seq, '' as name, case when i=1 then 'a > b' end alt
    from pages, (select unnest([0, 1]) i) where page_id%3=0""", [])
O.add_view("p_languages", r"""select page_id doc_id, 'word/styles.xml' part, 0 seq, v as value from
    (select page_id, trim(regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']([^"'']*)["'']',
    1)) v from pages) where v<>'' and lower(v)<>'x-none'""", [])
O.add_view("p_docs", rf"""select page_id doc_id, {_PLAIN.format(
    "list_extract(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1), 1)")} title
    from pages""", [])


def _pages(spark, sf_dir):
    return D.table(spark, sf_dir, "pages")


def _planted(spark, sf_dir):
    """The pages with images, an unquoted attribute or an element that is never closed behind their end."""
    k = c("page_id") % 3
    more = (F.when(k == 0, '<img src=x><IMG alt="a > b">').when(k == 1, F.concat(
        F.lit("<a href=/u/"), "page_id", F.lit(">Saiba mais</a>"))).otherwise("<h3>fim"))
    return _pages(spark, sf_dir).withColumn("html", F.concat("html", more))


def page_facts(spark, sf_dir, shared=True) -> R.Facts:
    """All facts of the pages from one parse. Tables of pages are no facts: nothing marks their headers."""
    pages = _planted(spark, sf_dir)
    found = H.html_elements(pages)
    found = cut_lineage(found) if shared else found
    tables = found.select(c("page_id").alias("doc_id"), F.lit("html").alias("part"), c("seq").alias("table_idx"),
                          F.lit(0).alias("n_rows"), F.lit(True).alias("first_row_header")).filter("false")
    return R.Facts(H.page_docs(found, pages), H.page_images(found), tables, H.page_headings(found),
                   H.page_links(found), H.page_languages(found))


for _name in ("headings", "links", "languages", "docs", "images"):
    query(f"page_{_name}", with_views(f"select * from p_{_name}", f"p_{_name}"))(
        lambda spark, sf_dir, name=_name: getattr(page_facts(spark, sf_dir, shared=False), name))


@query("page_elements", with_views("""select page_id, 'html' tag, cast(null as varchar) href, lang,
    '' as text from (select page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) lang from pages)
    union all select doc_id, 'title', null, null, title from p_docs
    union all select doc_id, concat('h', level), null, null, text from p_headings
    union all select doc_id, 'a', target, null, text from p_links
    union all select doc_id, 'img', null, null, '' from p_images""",
    "p_docs", "p_headings", "p_links", "p_images"))
def page_elements(spark, sf_dir):
    return H.html_elements(_planted(spark, sf_dir)).select("page_id", "tag", "href", "lang", "text")


@query("page_scores", with_views(f"""select doc_id, principle, greatest(0, 100-coalesce(p, 0)) score, coalesce(n, 0)
    problems from (select doc_id, v.* from p_docs, (values ('1', 'PERCEPTIVEL'), ('2', 'OPERAVEL'),
    ('3', 'COMPREENSIVEL')) v(digit, principle)) left join (select doc_id, digit, sum(p)::bigint p, sum(n)::bigint n from (
    select doc_id, '2' digit, 8*count(*) p, count(*) n from (select *, trim(text) t from p_links)
    where t<>'' and ({O.norm_link('t')} in ({O.values(C.GENERIC_LINK_TEXTS)}) or
    regexp_matches(lower(t), '{C.URL_START}') or lower(t)=lower(coalesce(target, ''))) group by 1
    union all select doc_id, '1', 8*count(*), count(*) from (select *, lag(level, 1, 0) over (
    partition by doc_id order by seq) b from p_headings) where level>b+1 group by 1
    union all select doc_id, '1', 15*count(*), count(*) from p_images where alt is null group by 1) group by 1, 2
    ) using (doc_id, digit)""", "p_docs", "p_links", "p_headings", "p_images"))
def page_scores(spark, sf_dir):
    facts = page_facts(spark, sf_dir)
    return S.principle_scores(facts.docs, R.run_rules(facts)).select(
        "doc_id", "principle", "score", "problems")


# ----------------------------------------------------- pages with images, from documents
def image_pages(spark, sf_dir):
    """Every document as a page with one image per line, in four ways to write an alt."""
    escaped = c("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), ("\"", "&quot;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    escaped = F.split(escaped, "\n")
    first_word = lambda x: F.split(x, " ")[0]
    tag = lambda x, i: (
        F.when(i % 4 == 0, F.concat(F.lit('<p><img src=a.png alt="'), x, F.lit('"></p>')))
        .when(i % 4 == 1, '<img src="b.png">').when(i % 4 == 2, "<IMG ALT>")
        .otherwise(F.concat(F.lit("<img alt='"), F.replace(first_word(x), F.lit("'"), F.lit("")),
                            F.lit(".png' />"))))
    return D.table(spark, sf_dir, "documents").select(
        c("doc_id").alias("page_id"), F.concat(F.lit("https://example.org/d/"), "doc_id").alias("url"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform(escaped, tag), "\n"),
                 F.lit("</body>")).alias("html"))


O.add_view("d_img", """select doc_id page_id, (line_no)::int seq, line_no%4<>1 has_alt,
    case line_no%4 when 0 then line when 2 then '' when 3 then
    concat(replace(string_split(line, ' ')[1], '''', ''), '.png') end alt from d_lines""",
           ["d_lines"])


def page_images(pages):
    images = H.image_alts(pages)
    from docaudit.operators.ordered import attach, over_ordered
    counted = over_ordered(images, ["page_id"], ["seq"], c("seq"), running={
        "with_alt": F.when(c("has_alt"), 1).otherwise(0)})
    idx = F.when(c("has_alt"), c("with_alt") - 1)
    rows = attach(counted, pages.select("page_id", "url"), "page_id", "inner")
    return rows.select(c("page_id").alias("page_ord"), "url",
                       F.coalesce(idx, c("with_alt") - F.lit(0.5)).alias("idx"), "has_alt", "alt")


def page_collection(spark, sf_dir) -> K.Collection:
    return K.collect_pages(image_pages(spark, sf_dir), C.QUOTA, page_images, "page_id")


@query("image_alts", with_views("select * from d_img", "d_img"))
def image_alts(spark, sf_dir):
    rows = H.image_alts(image_pages(spark, sf_dir))
    return rows.withColumn("seq", (c("seq") - 1).cast("int"))


_CLEAN = (r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(replace("
          r"replace(replace(replace(alt, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''),"
          r" '&amp;', '&')), '<[^>]+>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), "
          r"'[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')), '')").replace('\\"', '"')
O.add_view("d_judged", f"""select *, {O.insufficient_reason('t')} reason, {O.norm_alt('t')} g
    from (select page_id, seq, has_alt, count(case when has_alt then 1 end) over (partition by page_id
    order by seq)-1 idx, {_CLEAN} t from d_img)""", ["d_img"])
O.add_view("d_taken", """select * from (select *, row_number() over (order by page_id, idx) k from (
    select *, row_number() over (partition by g order by page_id, idx) o from d_judged
    where reason is not null) where o=1) where k<=50""", ["d_judged"])
O.add_view("d_stop", """select case when count(*)>=50 then max(page_id) end p,
    case when count(*)>=50 then max_by(idx, k) end i from d_taken""", ["d_taken"])
O.add_view("d_pages", """select page_id page_ord, concat('https://example.org/d/', page_id) url,
    count(*) images, count(case when not has_alt then 1 end) no_alt,
    count(case when has_alt and t is null then 1 end) empty_alt,
    count(case when t is not null and reason is null then 1 end) not_insufficient,
    coalesce(max(n), 0) accepted, count(case when reason is not null and (p is null or page_id<p or
    (page_id=p and idx<=i)) then 1 end)-coalesce(max(n), 0) duplicates
    from d_judged left join (select page_id, count(*) n from d_taken group by 1) using (page_id),
    d_stop where p is null or page_id<=p group by 1""", ["d_judged", "d_taken", "d_stop"])


@query("collected_alts", with_views("select page_id page_ord, idx::double idx, t alt, reason, g group_key "
                                    "from d_taken", "d_taken"))
def collected_alts(spark, sf_dir):
    return page_collection(spark, sf_dir).accepted.select(
        "page_ord", c("idx").cast("double").alias("idx"), "alt", "reason", "group_key")


@query("collection_by_page", with_views("select * from d_pages", "d_pages"))
def collection_by_page(spark, sf_dir):
    return page_collection(spark, sf_dir).per_page


@query("collection_totals", with_views("select " + ", ".join(
    f"sum({n})::bigint {n}" for n in ("images", "no_alt", "empty_alt", "not_insufficient",
                                      "duplicates", "accepted")) + " from d_pages", "d_pages"))
def collection_totals(spark, sf_dir):
    return page_collection(spark, sf_dir).totals


# ------------------------------------------------------------------------- archive
def archive_answers(spark, sf_dir):
    """Documents as JSON answers of a media archive; some without caption or licence."""
    lines, k = F.split("text", "\n"), c("doc_id")
    page = F.struct(
        k.alias("pageid"), F.concat(F.lit("File:"), k, F.lit(".jpg")).alias("title"),
        F.struct(F.when(k % 3 != 0, F.array(lines[0], F.lit("x"))).alias("label")).alias(
            "entityterms"),
        F.array(F.struct(
            F.concat(F.lit("https://example.org/f/"), k).alias("descriptionurl"),
            F.struct(
                F.struct(F.when(k % 7 != 0, F.get(lines, F.lit(1))).alias("value")).alias(
                    "ImageDescription"),
                F.struct(F.when(k % 5 != 0, "CC0").alias("value")).alias("LicenseShortName"),
            ).alias("extmetadata"))).alias("imageinfo"))
    body = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    return D.table(spark, sf_dir, "documents").select(c("source").alias("category"),
                                                      body.alias("body"))


def archive_files(spark, sf_dir):
    return A.flatten_answers(archive_answers(spark, sf_dir), c("body"), c("category"))


O.add_view("a_files", """select doc_id pageid, concat('File:', doc_id, '.jpg') title,
    case when doc_id%3<>0 then l[1] end caption, case when doc_id%7<>0 then l[2] end description,
    case when doc_id%5<>0 then 'CC0' else 'nao declarada' end license,
    concat('https://example.org/f/', doc_id) url, source category
    from (select *, string_split(text, chr(10)) l from documents)""", [])
_ARCHIVE_CLEAN = (
    rf"(case when T='' or lower(T) in ({O.values(C.JUNK_LITERALS)}) or regexp_matches(T, "
    rf"'{C.ARCHIVE_FILE_NAME}') or regexp_matches(T, '{C.ORPHAN_EXTENSION}') or not "
    rf"regexp_matches(T, '{C.HAS_LETTER}') then null else T end)")


def _archive_text(x: str) -> str:
    for _ in range(2):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                             ("&amp;", "&")):
            x = f"replace({x}, '{entity}', '{char}')"
        x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = rf"regexp_replace(nfc_normalize({x}), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"
    x = f"trim(regexp_replace({x}, '{O._WS}', ' ', 'g'))"
    return f"""trim(regexp_replace({x}, '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g'))"""


O.add_view("a_texts", f"""select *, coalesce({_ARCHIVE_CLEAN.replace('T', 'c1')},
    {_ARCHIVE_CLEAN.replace('T', 'c2')}) alt, case when {_ARCHIVE_CLEAN.replace('T', 'c1')} is not null
    then 'commons/legenda' when {_ARCHIVE_CLEAN.replace('T', 'c2')} is not null then
    'commons/descricao' end alt_origin from (select *, {_archive_text('caption')} c1,
    {_archive_text('description')} c2 from a_files)""", ["a_files"])
O.add_view("a_taken", f"""select * from (select *, row_number() over (order by pageid) k from (
    select *, row_number() over (partition by g order by pageid) o from (select *,
    {O.norm_alt('alt')} g from a_texts) where alt is not null) where o=1) where k<=100""",
           ["a_texts"])


@query("archive_files", with_views("select * from a_files", "a_files"))
def archive_files_query(spark, sf_dir):
    return archive_files(spark, sf_dir)


def archive_collection(spark, sf_dir) -> K.Collection:
    return K.collect_archive(archive_files(spark, sf_dir).withColumn("ord", c("pageid")), 100)


@query("archive_accepted", with_views("select pageid, alt, alt_origin, g group_key from a_taken",
                                      "a_taken"))
def archive_accepted(spark, sf_dir):
    return archive_collection(spark, sf_dir).accepted.select(
        "pageid", "alt", "alt_origin", "group_key")


@query("archive_discards", with_views(
    """select reason, count(*) files from (select case when coalesce(caption, '')='' and
       coalesce(description, '')='' then 'sem_texto' when alt is null then 'limpeza' else
       'duplicado' end reason from a_texts where pageid not in (select pageid from a_taken) and
       pageid<=(select case when count(*)>=100 then max(pageid) else 1e18 end from a_taken))
       group by 1""", "a_texts", "a_taken"))
def archive_discards(spark, sf_dir):
    return archive_collection(spark, sf_dir).totals.filter("files > 0")


@query("category_walk", """with recursive e as (select concat('r', n_regionkey) parent,
    concat('n', n_nationkey) child from nation union all select concat('n', c_nationkey),
    concat('c', c_custkey) from customer union all select concat('c', c_custkey), 'r0' from customer
    union all select concat('c', o_custkey), concat('o', o_orderkey) from orders),
    w(category, depth) as (select 'r0', 0 union select 'r1', 0 union select child, depth+1
    from w join e on parent=category where depth<2)
    select category, min(depth)::int as depth from w group by 1""")
def category_walk(spark, sf_dir):
    t = lambda n: D.table(spark, sf_dir, n)
    key = lambda p, n: F.concat(F.lit(p), n)
    edges = t("nation").select(key("r", "n_regionkey").alias("parent"),
                               key("n", "n_nationkey").alias("child"))
    edges = edges.union(t("customer").select(key("n", "c_nationkey"), key("c", "c_custkey")))
    edges = edges.union(t("customer").select(key("c", "c_custkey"), F.lit("r0")))
    edges = edges.union(t("orders").select(key("c", "o_custkey"), key("o", "o_orderkey")))
    seeds = t("region").filter("r_regionkey < 2").select(key("r", "r_regionkey").alias("category"))
    return A.expand_categories(edges, seeds, 2)
