"""Text functions and classifiers over every line of every document, page and turn."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.sources import derived as D

c = F.col


@query("normalized_alts", with_views(
    f"select doc_id, line_no, {O.norm_alt('alt')} as norm from d_lines", "d_lines"))
def normalized_alts(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.normalize_alt(c("alt")).alias("norm"))


_KEY = "case when norm<>'' then norm else concat('__sem_alt__', doc_id) end"


@query("split_assignment", with_views(
    f"""select doc_id, line_no, k group_key, {O.bucket('k')} bucket, {O.split_of('k')} split
        from (select doc_id, line_no, {_KEY} k from
              (select *, {O.norm_alt('alt')} norm from d_lines))""", "d_lines"))
def split_assignment(spark, sf_dir):
    keyed = D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.group_key(c("alt"), c("doc_id")).alias("group_key"))
    return keyed.select("*", T.bucket(c("group_key")).alias("bucket"),
                        T.split_of(c("group_key")).alias("split"))


@query("link_text_normalized", with_views(
    f"select doc_id, line_no, {O.norm_link('alt')} as norm from d_lines", "d_lines"))
def link_text_normalized(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.normalize_link(c("alt")).alias("norm"))


# Every fifth line ends in letters whose folding isn't their lower case.
_TO_FOLD, _FOLDED = "\ufb03 Stra\u1e9ee \u039f\u03a3 \u03c2 \u0535\u0582\u0587 \u01f0 \u13f8\uab70", "ffi strasse \u03bf\u03c3 \u03c3 \u0565\u0582\u0565\u0582 j\u030c \u13f0\u13a0"


@query("audit_normalized", with_views(
    f"""select doc_id, line_no, trim(replace(lower(trim(regexp_replace(alt, '{O._WS}', ' ', 'g'))), 'ß', 'ss') ||
        case when line_no%5=0 then ' {_FOLDED}' else '' end) as norm from d_lines""", "d_lines"))
def audit_normalized(spark, sf_dir):
    more = F.when(c("line_no") % 5 == 0, f" {_TO_FOLD}").otherwise("")
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.normalize_audit(F.concat("alt", more)).alias("norm"))


@query("url_texts", f"""select page_id, regexp_matches(lower(url), '{C.URL_START}') is_url,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path from pages""")
def url_texts(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select(
        "page_id", T.is_url(c("url")).alias("is_url"), T.url_host(c("url")).alias("host"),
        T.url_path(c("url")).alias("path"))


@query("ellipsis_summaries", with_views(
    f"""select doc_id, line_no, {O.ellipsis('alt')} short, case when alt='' then '(sem texto)'
        else {O.ellipsis('alt')} end summary from d_lines""", "d_lines"))
def ellipsis_summaries(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.ellipsis(c("alt")).alias("short"),
        T.heading_summary(c("line")).alias("summary"))


@query("token_tests", with_views(
    f"""select doc_id, line_no, len({O.tokens('alt')})::int n_tokens,
        {O.has_structure('alt')} has_structure, {O.repeats_word('alt')} repeats_word
        from d_lines""", "d_lines"))
def token_tests(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.size(T.tokens(c("alt"))).alias("n_tokens"),
        T.has_structure(c("alt")).alias("has_structure"),
        T.repeats_word(c("alt")).alias("repeats_word"))


@query("heading_levels", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    case when n between 0 and 8 then n+1 end outline,
    case when regexp_matches(s, '^(heading|titulo|ttulo)[1-9]$') then right(s, 1)::int end style,
    not (l_returnflag='N') on_flag
    from (select *, cast(l_quantity as int)%12-1 n, regexp_replace(lower(concat(
    case l_linenumber%3 when 0 then 'Heading ' when 1 then 'Título-' else 'Body' end,
    cast(l_quantity as int)%11)), '[^a-z0-9]', '', 'g') s from lineitem)""")
def heading_levels(spark, sf_dir):
    n = c("l_quantity").cast("int")
    prefix = (F.when(c("l_linenumber") % 3 == 0, "Heading ")
              .when(c("l_linenumber") % 3 == 1, "Título-").otherwise("Body"))
    flag = F.when(c("l_returnflag") == "N", "False").when(c("l_returnflag") == "A", "1")
    return D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        T.outline_level((n % 12 - 1).cast("string")).alias("outline"),
        T.style_level(F.concat(prefix, (n % 11).cast("string"))).alias("style"),
        T.ooxml_on(flag).alias("on_flag"))


@query("content_parts", """with names as (select o_orderkey, case o_orderkey%12
    when 0 then 'word/document.xml' when 1 then 'word/styles.xml' when 2 then
    'word/theme/theme1.xml' when 3 then 'word/glossary/document.xml' when 4 then
    'word/commentsExtended.xml' when 5 then 'word/comments.xml' when 6 then 'docProps/core.xml'
    when 7 then 'word/media/image1.png' when 8 then 'word/_rels/document.xml.rels' when 9 then
    concat('word/header', o_custkey, '.xml') when 10 then 'word/commentsIds1.xml'
    else 'word/footnotes.xml' end part from orders)
    select o_orderkey, part from names where starts_with(part, 'word/') and ends_with(part, '.xml')
    and part not like 'word/%/%' and part not in ('word/styles.xml') and
    not regexp_matches(part, '^word/comments(Extended|Ids|Extensible)')""")
def content_parts(spark, sf_dir):
    names = ["word/document.xml", "word/styles.xml", "word/theme/theme1.xml",
             "word/glossary/document.xml", "word/commentsExtended.xml", "word/comments.xml",
             "docProps/core.xml", "word/media/image1.png", "word/_rels/document.xml.rels", None,
             "word/commentsIds1.xml", "word/footnotes.xml"]
    part = F.coalesce(F.element_at(F.array(*map(F.lit, names)),
                                   (c("o_orderkey") % 12 + 1).cast("int")),
                      F.concat(F.lit("word/header"), c("o_custkey"), F.lit(".xml")))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", part.alias("part")).filter(
        T.is_content_part(c("part")))


@query("cited_criteria", rf"""select doc_id, i-1 pos, x[i] criterion from (
    select doc_id, x, unnest(range(1, len(x)+1)) i from (select doc_id, regexp_extract_all(
    concat(text, ' criterio ', 1+doc_id%5, '.', doc_id%4, '.', 1+doc_id%9, ' e 1.1.1'),
    '{C.CRITERION}', 1) x from documents))""")
def cited_criteria(spark, sf_dir):
    d = c("doc_id")
    text = F.concat(c("text"), F.lit(" criterio "), 1 + d % 5, F.lit("."), d % 4, F.lit("."),
                    1 + d % 9, F.lit(" e 1.1.1"))
    return D.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(T.cited_criteria(text)).alias("pos", "criterion")).select(
        "doc_id", c("pos").cast("bigint").alias("pos"), "criterion")


def _sanitized_sql(x: str) -> str:
    s = f"regexp_replace({x}, '{C.CONTROL_RUN}', ' ', 'g')"
    for marker in C.ROLE_MARKERS:
        s = f"regexp_replace({s}, '{marker}', '[removido]', 'g')"
    return rf"trim(regexp_replace({s}, '\s{{2,}}', ' ', 'g'))"


O.add_view("d_turns", """select conv_id, turn, concat(case turn%4 when 0 then 'System : ' when 1
    then '## [INST] ' when 2 then '<|im_start|>' else '' end, text) as text
    from conversations""", [])
O.add_view("d_clean", f"""select conv_id, turn, case when length(s)>500 then
    concat(left(s, 495), '[...]') else s end clean from
    (select conv_id, turn, {_sanitized_sql('text')} s from d_turns)""", ["d_turns"])


def marked_turns(spark, sf_dir):
    """Conversation turns, some opened with a marker that a reader could take for a role."""
    mark = (F.when(c("turn") % 4 == 0, "System : ").when(c("turn") % 4 == 1, "## [INST] ")
            .when(c("turn") % 4 == 2, "<|im_start|>").otherwise(""))
    return D.table(spark, sf_dir, "conversations").withColumn("text", F.concat(mark, "text"))


@query("sanitized_turns", with_views("select * from d_clean", "d_clean"))
def sanitized_turns(spark, sf_dir):
    return marked_turns(spark, sf_dir).select(
        "conv_id", "turn", T.sanitize(c("text")).alias("clean"))


@query("enveloped_turns", with_views(
    """select conv_id, turn, concat('<<PERGUNTA:', n, '>>', chr(10), clean, chr(10), '<</PERGUNTA:',
       n, '>>') envelope from (select *, left(sha256(concat(conv_id, '/', turn)), 16) n
       from d_clean)""", "d_clean"))
def enveloped_turns(spark, sf_dir):
    nonce = F.left(F.sha2(F.concat_ws("/", "conv_id", "turn"), 256), F.lit(16))
    return marked_turns(spark, sf_dir).select("conv_id", "turn", T.envelope(
        "PERGUNTA", T.sanitize(c("text")), nonce).alias("envelope"))


@query("hashes_and_bands", with_views(
    """select doc_id, line_no, sha256(line) sha, concat('sintetico:', left(sha256(alt), 12)) id,
       case when length(alt)<=10 then '<=10' when length(alt)<=30 then '11-30' else '>30' end band,
       left(alt, 500) error from d_lines""", "d_lines"))
def hashes_and_bands(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", T.content_sha256(c("line")).alias("sha"),
        T.synthetic_id(c("alt")).alias("id"), T.length_band(c("alt")).alias("band"),
        T.truncate_error(c("alt")).alias("error"))


@query("instants", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') iso,
    strftime(ts, '%Y-%m') as month from events""")
def instants(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(
        "event_id", T.instant_iso(c("ts")).alias("iso"), T.month_key(c("ts")).alias("month"))


@query("kappa_bands", """select o_orderkey, case when k<0 then 'pior que o acaso' when k<0.2 then
    'insignificante' when k<0.4 then 'fraca' when k<0.6 then 'moderada' when k<0.8 then
    'substancial' else 'quase perfeita' end band from (select o_orderkey,
    (o_orderkey%120-20)/100.0::double k from orders)""")
def kappa_bands(spark, sf_dir):
    k = (c("o_orderkey") % 120 - 20) / F.lit(100.0)
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.kappa_band(k).alias("band"))


@query("alt_quality", with_views(
    f"select doc_id, line_no, {O.alt_quality('alt')} category from d_lines", "d_lines"))
def alt_quality(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).select(
        "doc_id", "line_no", Q.alt_quality(c("line")).alias("category"))


@query("provisional_labels", with_views(
    f"select doc_id, line_no, {O.provisional('alt')} as label from d_lines where alt<>''",
    "d_lines"))
def provisional_labels(spark, sf_dir):
    return D.alt_lines(spark, sf_dir).filter("alt <> ''").select(
        "doc_id", "line_no", Q.provisional_label(c("alt")).alias("label"))


O.add_view("d_words", r"""select doc_id, line_no, i-1 word_no, w[i] word from (
    select doc_id, line_no, w, unnest(range(1, len(w)+1)) i from (
    select doc_id, line_no, string_split(alt, ' ') w from d_lines where alt<>''))""", ["d_lines"])


def words(spark, sf_dir):
    """Every word of every line, some dressed as file names, hashes and stock phrases."""
    rows = D.alt_lines(spark, sf_dir).filter("alt <> ''").select(
        "doc_id", "line_no", F.posexplode(F.split("alt", " ")).alias("word_no", "word"))
    kind = (c("doc_id") + c("line_no") + c("word_no")) % 8
    dressed = (F.when(kind == 1, F.concat("word", F.lit(".PNG")))
               .when(kind == 2, F.left(F.sha2("word", 256), F.lit(12)))
               .when(kind == 3, "Ilustração").when(kind == 4, F.concat(F.lit("descricao de "), "word"))
               .otherwise(c("word")))
    return rows.select("doc_id", "line_no", c("word_no").cast("bigint").alias("word_no"),
                       dressed.alias("word"))


O.add_view("d_dressed", """select doc_id, line_no, word_no, case (doc_id+line_no+word_no)%8
    when 1 then concat(word, '.PNG') when 2 then left(sha256(word), 12) when 3 then 'Ilustração'
    when 4 then concat('descricao de ', word) else word end word from d_words""", ["d_words"])


@query("insufficient_reasons", with_views(
    f"""select doc_id, coalesce({O.insufficient_reason('word')}, 'passa') reason, count(*) words
        from (select doc_id, regexp_replace(word, '^{O._WS}|{O._WS}$', '', 'g') word
        from d_dressed) group by all""", "d_dressed"))
def insufficient_reasons(spark, sf_dir):
    reason = F.coalesce(Q.insufficient_reason(c("word")), F.lit("passa"))
    return words(spark, sf_dir).groupBy("doc_id", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("words"))


@query("slices", """select s slice, count(*) n from (select case
    when coalesce(o='sintetico_fallback', false) or coalesce(f='sintetico', false)
    then 'sintetico_fallback'
    when coalesce(f='wikimedia-commons', false) or coalesce(o='wikimedia_commons', false)
    then 'wikimedia_commons' when coalesce(o='coletado', false) then 'web_coletado'
    when f is null and ends_with(a, '.docx') then 'governamental_docx' else 'desconhecido' end s
    from (select case o_orderkey%5 when 0 then 'sintetico' when 1 then 'wikimedia-commons'
    when 2 then 'outra' end f, case o_custkey%4 when 0 then 'sintetico_fallback' when 1 then
    'wikimedia_commons' when 2 then 'coletado' end o, concat(o_orderkey,
    case when o_orderkey%2=0 then '.docx' else '.pdf' end) a from orders)) group by 1""")
def slices(spark, sf_dir):
    k, u = c("o_orderkey"), c("o_custkey")
    source = (F.when(k % 5 == 0, "sintetico").when(k % 5 == 1, "wikimedia-commons")
              .when(k % 5 == 2, "outra"))
    origin = (F.when(u % 4 == 0, "sintetico_fallback").when(u % 4 == 1, "wikimedia_commons")
              .when(u % 4 == 2, "coletado"))
    file = F.concat(k, F.when(k % 2 == 0, ".docx").otherwise(".pdf"))
    return D.table(spark, sf_dir, "orders").groupBy(
        Q.slice_of(source, origin, file).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("cleaned_web_texts", r"""with t as (select page_id, regexp_extract(html,
    '(?is)<title[^>]*>(.*?)</title>', 1) raw from pages) select page_id, nullif(trim(
    regexp_replace(regexp_replace(regexp_replace(html_unescape_basic, '<[^>]+>', ' ', 'g'),
    '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g')), '') clean from (
    select page_id, nfc_normalize(replace(replace(replace(replace(replace(raw, '&lt;', '<'),
    '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) html_unescape_basic from t)""")
def cleaned_web_texts(spark, sf_dir):
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return D.table(spark, sf_dir, "pages").select(
        "page_id", T.clean_web_text(raw).alias("clean"))


@query("cleaned_archive_texts", with_views(rf"""select doc_id, line_no, word_no, case when
    t='' or lower(t) in ({O.values(C.JUNK_LITERALS)}) or regexp_matches(t,
    '{C.ARCHIVE_FILE_NAME}') or regexp_matches(t, '{C.ORPHAN_EXTENSION}') or
    not regexp_matches(t, '{C.HAS_LETTER}') then null else t end clean from (
    select doc_id, line_no, word_no, trim(regexp_replace(trim(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(nfc_normalize(replace(replace(replace(replace(replace(word,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')),
    '<[^>]+>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '{O._WS}', ' ', 'g'),
    'zzzz', '')), '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g')) t from d_dressed)""", "d_dressed"))
def cleaned_archive_texts(spark, sf_dir):
    return words(spark, sf_dir).select(
        "doc_id", "line_no", "word_no", T.clean_archive_text(c("word")).alias("clean"))
