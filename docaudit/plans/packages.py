"""Documents written as packages, shredded, and read back as facts."""
from __future__ import annotations

from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.operators import facts as X
from docaudit.operators import rules as R
from docaudit.plans import oracle as O
from docaudit.plans.oracle import with_views
from docaudit.plans.registry import query
from docaudit.session import cut_lineage
from docaudit.sources import derived as D
from docaudit.sources import packages as P

c = F.col
_XMLNS = " ".join(f'xmlns:{p}="{uri}"' for uri, p in C.NS.items())


def _body(x, i):
    run = F.concat(F.lit("<w:r><w:t>"), x, F.lit("</w:t></w:r>"))
    p = lambda *inner: F.concat(F.lit("<w:p>"), *inner, F.lit("</w:p>"))
    s = lambda v: v.cast("string")
    heading = p(F.lit('<w:pPr><w:pStyle w:val="Heading'), s(1 + i % 3), F.lit('"/></w:pPr>'), run)
    descr = F.when(i % 2 == 0, F.concat(F.lit(' descr="'), F.split(x, " ")[0], F.lit('"'))).otherwise("")
    image = p(F.lit('<w:r><w:drawing><wp:inline><wp:docPr id="1" name="img'), s(i), F.lit('"'), descr,
              F.lit("/><a:graphic><a:graphicData><pic:pic><a:blip/></pic:pic></a:graphicData></a:graphic>"
                    "</wp:inline></w:drawing></w:r>"))
    link = p(F.lit('<w:hyperlink r:id="r'), s(i), F.lit('">'), run, F.lit("</w:hyperlink>"))
    mark = F.when(i % 2 == 0, "<w:trPr><w:tblHeader/></w:trPr>").otherwise("")
    table = F.concat(F.lit("<w:tbl><w:tr>"), mark, F.lit("<w:tc>"), p(run), F.lit("</w:tc></w:tr>"),
                     F.repeat(F.lit("<w:tr><w:tc><w:p/></w:tc></w:tr>"), i % 3), F.lit("</w:tbl>"))
    k = i % 7
    return (F.when(k == 0, heading).when(k == 1, image).when(k == 2, link).when(k == 3, table)
            .otherwise(p(run)))


def document_packages(spark, sf_dir, only=None):
    """Every document, or those whose ids ``only`` has, as a package whose paragraphs, images, links and tables are its lines."""
    d = c("doc_id")
    lines = c("lines")
    body = F.array_join(F.transform(lines, _body), "")
    wrap = lambda name, x: F.concat(F.lit(f"<{name} {_XMLNS}>"), x, F.lit(f"</{name}>"))
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    rels = F.array_join(F.transform(numbers, lambda i: F.when((i % 7 == 2) & (i % 2 == 0), F.concat(
        F.lit('<rel:Relationship Id="r'), i.cast("string"), F.lit(f'" Type="{C.HYPERLINK_TYPE}" Target="'),
        F.lit("https://example.org/"), i.cast("string"), F.lit('"/>'))).otherwise("")), "")
    title = (F.when(d % 3 == 1, "<dc:title>  </dc:title>").when(
        d % 3 == 2, F.concat(F.lit("<dc:title>"), "lang", F.lit("</dc:title>"))).otherwise(""))
    lang = F.when(d % 4 < 2, '<w:docDefaults><w:lang w:val="pt-BR"/></w:docDefaults>').otherwise("")
    part = lambda name, xml: F.struct(F.lit(name).alias("name"), xml.alias("xml"))
    parts = F.array(
        part("[Content_Types].xml", F.when(d % 19 != 0, F.lit("<Types/>"))),
        part(C.DOCUMENT_PART, F.when(d % 17 != 0, wrap("w:document", body))),
        part(C.STYLES_PART, wrap("w:styles", lang)), part(C.PROPERTIES_PART, wrap("w:props", title)),
        part("word/_rels/document.xml.rels", wrap("rel:Relationships", rels)),
        part("word/header1.xml", F.when(d % 23 == 0, F.lit("<w:hdr>")).otherwise(wrap("w:hdr", F.lit("")))))
    documents = D.table(spark, sf_dir, "documents")
    if only is not None:
        # Packages cost far more to make and read than texts to move: tasks of even size, however the files are cut.
        documents = documents.join(only.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "lang").hint("rebalance")
    cut = documents.select("doc_id", "lang", F.split(P.xml_text(c("text")), "\n").alias("lines"))  # read by body and relationships
    return P.write_packages(cut.select("doc_id", parts.alias("parts")))


def _written(spark, sf_dir):
    """The packages as a table: a core runs one Python worker that makes them, then one that reads them, not both at once."""
    return cut_lineage(document_packages(spark, sf_dir))


def _shredded(spark, sf_dir, materialize=True):
    """Written once where facts read the elements several times."""
    return P.shred(_written(spark, sf_dir), materialize)


O.add_view("k_lines", r"""select doc_id, i-1 i, regexp_replace(l[i], '[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]',
    '', 'g') line from (select doc_id, string_split(text, chr(10)) l, unnest(range(1,
    len(string_split(text, chr(10)))+1)) i from documents) where doc_id%17<>0""", [])
O.add_view("k_docs", """select doc_id, case when doc_id%3=1 then '  ' when doc_id%3=2 then lang end title
    from documents""", [])
O.add_view("k_images", """select doc_id, 'word/document.xml' part, row_number() over (partition by doc_id order
    by i) seq, concat('img', i) as name, case when i%2=0 then string_split(line, ' ')[1] end alt from k_lines
    where i%7=1""", ["k_lines"])
O.add_view("k_tables", """select doc_id, 'word/document.xml' part, row_number() over (partition by doc_id order
    by i) table_idx, (1+i%3) n_rows, i%2=0 first_row_header from k_lines where i%7=3""", ["k_lines"])
O.add_view("k_headings", """select doc_id, 'word/document.xml' part, row_number() over (partition by doc_id order
    by i) seq, 1+i%3 as level, line as text from k_lines where i%7=0""", ["k_lines"])
O.add_view("k_links", """select doc_id, 'word/document.xml' part, row_number() over (partition by doc_id order
    by i) seq, line as text, case when i%2=0 then concat('https://example.org/', i) end target from k_lines
    where i%7=2""", ["k_lines"])
O.add_view("k_languages", """select doc_id, 'word/styles.xml' part, 1 seq, 'pt-BR' as value from documents
    where doc_id%4<2""", [])


@query("package_titles", with_views("select * from k_docs", "k_docs"))
def package_titles(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id").join(
        X.titles(_shredded(spark, sf_dir, False)[0]), "doc_id", "left")


@query("package_images", with_views("""select doc_id, part, seq::int seq, name, alt, case when alt is null
    then 'AUSENTE' when trim(alt)='' then 'VAZIO' else 'PRESENTE' end alt_state from k_images""", "k_images"))
def package_images(spark, sf_dir):
    return X.images(_shredded(spark, sf_dir)[0])


@query("package_tables", with_views("""select doc_id, part, table_idx::int table_idx, n_rows::int n_rows,
    first_row_header from k_tables""", "k_tables"))
def package_tables(spark, sf_dir):
    return X.tables(_shredded(spark, sf_dir)[0])


@query("package_headings", with_views("select doc_id, part, seq::int seq, level::int as level, text "
                                      "from k_headings", "k_headings"))
def package_headings(spark, sf_dir):
    return X.headings(_shredded(spark, sf_dir)[0])


@query("package_links", with_views("select doc_id, part, seq::int seq, text, target from k_links", "k_links"))
def package_links(spark, sf_dir):
    return X.links(_shredded(spark, sf_dir)[0])


@query("package_languages", with_views("select * from k_languages", "k_languages"))
def package_languages(spark, sf_dir):
    return X.languages(_shredded(spark, sf_dir, False)[0])


O.add_view("k_text", r"""select doc_id, 2*i k, trim(regexp_replace(case when i%7=1 then '' else line end,
    '^[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g')) t,
    i from k_lines""", ["k_lines"])


@query("package_alt_candidates", with_views("""select doc_id, 'word/document.xml' part, (row_number() over (
    partition by doc_id order by i)-1)::int idx, concat('img', i) as name, coalesce(a, '') alt, case when a is
    null then 'ausente' else 'wp:docPr/@descr' end alt_origin, coalesce(left(b, 400), '') context_before,
    coalesce(left(f, 400), '') context_after from (select doc_id, i, last_value(nullif(t, '') ignore nulls) over
    (partition by doc_id order by i rows between unbounded preceding and 1 preceding) b, first_value(nullif(t,
    '') ignore nulls) over (partition by doc_id order by i rows between 1 following and unbounded following) f
    from k_text) join (select doc_id, i, case when i%2=0 then nullif(trim(string_split(line, ' ')[1]), '') end a
    from k_lines) using (doc_id, i) where i%7=1""", "k_text", "k_lines"))
def package_alt_candidates(spark, sf_dir):
    return X.alt_candidates(_shredded(spark, sf_dir)[0])


@query("package_part_report", """select doc_id, 'word/header1.xml' unreadable, '' too_large from documents
    where doc_id%23=0""")
def package_part_report(spark, sf_dir):
    return X.part_report(_shredded(spark, sf_dir, False)[1])


@query("package_reasons", """select doc_id, case when doc_id%19=0 then
    'pacote sem [Content_Types].xml: nao e OOXML' when doc_id%17=0 then
    'pacote sem word/document.xml: nao e WordprocessingML (DOCX)' end reason from documents""")
def package_reasons(spark, sf_dir):
    return P.package_reasons(_written(spark, sf_dir))


O.add_view("k_ok", "select doc_id from documents where doc_id%17<>0 and doc_id%19<>0 and doc_id%23<>0", [])
O.add_view("k_link_findings", O.VIEWS["f_link"].replace("from d_links", "from k_links"), ["k_links"])


O.add_view("k_findings", """select * from (
    select doc_id, 'IMAGEM_SEM_TEXTO_ALTERNATIVO' rule_id from k_images where alt is null union all
    select doc_id, 'TABELA_SEM_CABECALHO' from k_tables where not first_row_header union all
    select doc_id, 'TITULO_AUSENTE' from k_docs where title is null or trim(title)='' union all
    select doc_id, 'IDIOMA_NAO_DECLARADO' from k_docs where doc_id%4>=2 union all
    select doc_id, rule_id from k_link_findings union all
    select doc_id, 'ORDEM_HIERARQUICA_CABECALHOS' from (select doc_id, level, lag(level, 1, 0) over (partition by
    doc_id order by seq) b from k_headings) where level>b+1) semi join k_ok using (doc_id)""", ["k_images",
    "k_tables", "k_docs", "k_headings", "k_link_findings", "k_ok"])


@query("package_findings", with_views("select rule_id, count(*) n from k_findings group by 1", "k_findings"))
def package_findings(spark, sf_dir):
    """All rules over the packages that are packages and of which every part could be read."""
    packages = _written(spark, sf_dir)
    good = cut_lineage(P.package_reasons(packages).filter("reason IS NULL").select("doc_id"))
    elements, parts = P.shred(packages.join(good, "doc_id", "left_semi"))
    ids = cut_lineage(good.join(X.failed_documents(parts), "doc_id", "left_anti"))
    facts = X.all_facts(elements.join(ids, "doc_id", "left_semi"), ids)
    return R.run_rules(facts).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
