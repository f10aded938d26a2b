import pytest
from pyspark.sql import functions as F

from docaudit.operators import facts as X
from docaudit.operators import rules as R
from docaudit.operators import score as S
from docaudit.sources import packages as P
from packages import drawing, p, package, root, t

FALLBACK = ('<mc:AlternateContent><mc:Choice>{0}</mc:Choice><mc:Fallback><w:pict><v:shape id="s" alt="vml">'
            "<v:imagedata/></v:shape></w:pict></mc:Fallback></mc:AlternateContent>")
TRAPS = {
    "present": (p(drawing(attrs='descr="Grafico"')), [("img", "Grafico", "PRESENTE")]),
    "empty": (p(drawing(attrs='descr=""')), [("img", "", "VAZIO")]),
    "missing": (p(drawing()), [("img", None, "AUSENTE")]),
    "anchor": (p(drawing(frame="wp:anchor")), [("img", None, "AUSENTE")]),
    "title is no alt": (p(drawing(attrs='title="T"')), [("img", None, "AUSENTE")]),
    "fallback": (p(FALLBACK.format(drawing(attrs='descr="um"'))), [("img", "um", "PRESENTE")]),
    "vml": (p('<w:pict><v:shape id="v1" alt="Selo"><v:imagedata/></v:shape></w:pict>'),
            [("v1", "Selo", "PRESENTE")]),
    "blank": (p(drawing(attrs='descr="   "')), [("img", "   ", "VAZIO")]),
    "text box": (p(drawing(inner="<w:txbxContent><w:p/></w:txbxContent>")), []),
    "nested": (p(drawing("outer", 'descr="fora"', inner=p(drawing("inner", 'descr="dentro"')))),
               [("inner", "dentro", "PRESENTE")]),
}


def docs(spark, contents):
    return spark.createDataFrame(list(contents.items()), "doc_id string, content binary")


def shred(spark, contents):
    return P.shred(docs(spark, contents), materialize=False)


def test_image_traps(spark):
    elements, _ = shred(spark, {n: package(b) for n, (b, _) in TRAPS.items()})
    got = {n: [] for n in TRAPS}
    for r in X.images(elements).orderBy("doc_id", "seq").collect():
        got[r["doc_id"]].append((r["name"], r["alt"], r["alt_state"]))
    assert got == {n: want for n, (_, want) in TRAPS.items()}


def test_image_only_in_header_and_three_mixed(spark):
    header = package(parts={"word/header1.xml": root("w:hdr", p(drawing(attrs='descr="Brasao"')))})
    mixed = package(p(drawing("a", 'descr="x"')) + p(drawing("b")) + p(drawing("c", 'descr=""')))
    rows = X.images(shred(spark, {"h": header, "m": mixed})[0]).orderBy("doc_id", "seq").collect()
    assert [(r["part"], r["alt"]) for r in rows if r["doc_id"] == "h"] == [("word/header1.xml", "Brasao")]
    assert [r["alt_state"] for r in rows if r["doc_id"] == "m"] == ["PRESENTE", "AUSENTE", "VAZIO"]


def test_tables_count_own_rows_and_read_the_first_header(spark):
    inner = '<w:tbl><w:tblPr><w:tblHeader/></w:tblPr><w:tr><w:tc/></w:tr></w:tbl>'
    body = (f'<w:tbl><w:tr><w:trPr><w:tblHeader w:val="false"/></w:trPr><w:tc>{inner}</w:tc></w:tr>'
            "<w:tr><w:trPr><w:tblHeader/></w:trPr></w:tr></w:tbl>"
            "<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr></w:tr></w:tbl><w:tbl/>")
    rows = X.tables(shred(spark, {"d": package(body)})[0]).orderBy("table_idx").collect()
    assert [(r["n_rows"], r["first_row_header"]) for r in rows] == [
        (2, False), (1, False), (1, True), (0, False)]


def test_heading_levels_text_and_order(spark):
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>'
    body = (p("<w:t>A</w:t>", style("Heading1")) + p("<w:t>B</w:t>", style("Ttulo2"))
            + p("<w:t>C</w:t>", '<w:pPr><w:pStyle w:val="Heading1"/><w:outlineLvl w:val="2"/></w:pPr>')
            + p("<w:t>D</w:t>", '<w:pPr><w:outlineLvl w:val="9"/></w:pPr>')
            + p("<w:t>E</w:t><w:tab/><w:t>F</w:t>", style("heading 4")) + t("texto"))
    rows = X.headings(shred(spark, {"d": package(body)})[0]).orderBy("seq").collect()
    assert [(r["level"], r["text"]) for r in rows] == [(1, "A"), (2, "B"), (3, "C"), (4, "EF")]


def test_links_languages_title(spark):
    rel = ('<rel:Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
           'relationships/hyperlink" Target="{}"/>')
    parts = {
        "word/_rels/document.xml.rels": root("rel:Relationships", rel.format("https://a") + rel.format("https://b")),
        "word/styles.xml": root("w:styles", '<w:lang w:val=" pt-BR "/><w:lang w:val="x-NONE"/>'),
        "docProps/core.xml": root("w:core", "<dc:title>Um <![CDATA[titulo]]></dc:title>")}
    body = '<w:hyperlink r:id="r1"><w:r><w:t>clique</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="x"/>'
    elements, _ = shred(spark, {"d": package(p(body), parts)})
    assert [(r["text"], r["target"]) for r in X.links(elements).orderBy("seq").collect()] == [
        ("clique", "https://b"), ("", None)]
    assert [(r["part"], r["value"]) for r in X.languages(elements).collect()] == [("word/styles.xml", "pt-BR")]
    assert X.titles(elements).first()["title"] == "Um titulo"


def test_end_to_end_score_is_77(spark):
    table = "<w:tbl>" + "<w:tr><w:tc/></w:tr>" * 4 + "</w:tbl>"
    style = lambda n: f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>'
    body = (p("<w:t>Um</w:t>", style(1)) + p("<w:t>Tres</w:t>", style(3)) + p(drawing()) + table
            + p('<w:hyperlink r:id="r9"><w:r><w:t>clique aqui</w:t></w:r></w:hyperlink>'))
    ids = docs(spark, {"d": package(body)})
    elements, parts = P.shred(ids)
    facts = X.all_facts(elements, ids.select("doc_id"))
    found = R.run_rules(facts).cache()
    assert found.count() == 6
    scores = {r["principle"]: (r["score"], r["problems"]) for r in S.principle_scores(facts.docs, found).collect()}
    assert scores == {"PERCEPTIVEL": (62, 3), "OPERAVEL": (84, 2), "COMPREENSIVEL": (85, 1)}
    assert tuple(S.global_scores(facts.docs, found).first())[1:] == (77, "ROBUSTO")


def test_dataset_dialect(spark):
    vml = '<w:pict><v:shape><v:imagedata o:title="Selo antigo"/></v:shape></w:pict>'
    body = (t("antes") + t("  ") + p(drawing(attrs='descr=" " title="Titulo"')) + t("") + t("depois" + "x" * 500)
            + p(vml) + p('<a:blip/>')
            + p(drawing("n", inner='<pic:pic><pic:cNvPr name="c" descr="do cNvPr"/></pic:pic>')))
    elements, parts = P.shred(docs(spark, {"d": package(body, {"word/header1.xml": "<w:hdr>"})}))
    rows = X.alt_candidates(elements, parts).orderBy("idx").collect()
    assert [(r["alt"], r["alt_origin"]) for r in rows] == [
        ("Titulo", "wp:docPr/@title"), ("do cNvPr", "pic:cNvPr/@descr"),
        ("Selo antigo", "v:imagedata/@o:title"), ("", "ausente")]
    assert rows[0]["context_before"] == "antes"
    assert rows[0]["context_after"] == ("depois" + "x" * 500)[:400]
    assert X.part_report(parts).first()["unreadable"] == "word/header1.xml"


def test_text_box_image_counts_once(spark):
    box = p(f"<w:pict><w:txbxContent>{p(drawing(attrs='descr=\"na caixa\"'))}</w:txbxContent></w:pict>")
    elements, parts = P.shred(docs(spark, {"d": package(box)}))
    assert [r["alt"] for r in X.alt_candidates(elements, parts).collect()] == ["na caixa"]


def test_large_parts_are_reported_and_left_out(spark, monkeypatch):
    monkeypatch.setattr(P.C, "MAX_PART_BYTES", 2000)
    big = package(p(drawing(attrs='descr="x"')) + t("y" * 3000))
    elements, parts = P.shred(docs(spark, {"d": big}))
    assert X.part_report(parts).first()["too_large"] == "word/document.xml"
    assert X.alt_candidates(elements, parts).count() == 0


def test_all_images_of_a_part_over_the_limit_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(P.C, "MAX_PART_BYTES", 2000)
    big = package(t("antes") + p(drawing(attrs='descr="x"')) + t("y" * 3000) + p(drawing(attrs='descr="z"')))
    elements, parts = P.shred(docs(spark, {"d": big, "e": package(p(drawing()))}))
    assert X.part_report(parts).first()["too_large"] == "word/document.xml"
    rows = X.alt_candidates(elements).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["alt"], r["context_before"], r["context_after"]) for r in rows] == [
        ("d", "x", "antes", "y" * 400), ("d", "z", "y" * 400, ""), ("e", "", "", "")]


def test_package_query_keeps_the_images_of_large_parts(spark, monkeypatch, tmp_path):
    from docaudit.plans.packages import package_alt_candidates
    monkeypatch.setattr(P.C, "MAX_PART_BYTES", 3000)
    text = "\n".join(f"linha {i} do texto" for i in range(50))
    spark.createDataFrame([(1, text, "pt", "s", 1), (2, "um\ndois tres", "pt", "s", 1)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    rows = package_alt_candidates(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {1: 7, 2: 1}


def test_neighbours_take_time_in_proportion_to_the_part(spark):
    import time
    paragraphs = spark.range(120_000).selectExpr("'d' doc_id", "'a' part", "id p", "if(id % 1000 = 0, concat('t', id), '') text")
    began = time.time()
    got = X.neighbours(paragraphs).selectExpr("count_if(before = '')", "count_if(after = '')", "count_if(after = 't1000')").first()
    assert tuple(got) == (1, 1000, 1000) and time.time() - began < 30


def test_document_type_declarations_make_a_part_unreadable(spark):
    bomb = package(parts={"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><w>&a;</w>'})
    _, parts = shred(spark, {"d": bomb})
    assert [tuple(r) for r in X.failed_documents(parts).collect()] == [("d",)]


@pytest.mark.parametrize("content, reason", [
    (bytearray(b"<!DOCTYPE html>"), "conteudo nao e um pacote zip (assinatura PK ausente)"),
    (bytearray(b"PK\x03\x04lixo"), "pacote zip corrompido"),
    (package(drop=["[Content_Types].xml"]), "pacote sem [Content_Types].xml: nao e OOXML"),
    (package(drop=["word/document.xml"]), "pacote sem word/document.xml: nao e WordprocessingML (DOCX)"),
    (package(parts={f"x{i}": "" for i in range(2001)}), "pacote com entradas demais (limite 2000)"),
    (package(), None)])
def test_package_reasons(spark, content, reason):
    assert P.package_reasons(docs(spark, {"d": content})).first()["reason"] == reason


def test_package_reasons_reads_each_package_once_and_keeps_every_file(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch
    rows = [("a", package(t("um"))), ("a", b"no"), ("b", package(t("um"))), (None, package(t("um"))), (None, b"no"), ("c", b"PK no zip")]
    packages = spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id string, content binary")
    found = P.package_reasons(packages.mapInArrow(run, packages.schema)).collect()
    assert made.value == len(rows)
    none = "pacote sem [Content_Types].xml: nao e OOXML"
    broken = "conteudo nao e um pacote zip (assinatura PK ausente)"
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i!r}, reason={r!r})" for i, r in [
        ("a", broken), ("a", broken), ("b", None), ("c", "pacote zip corrompido"), (None, none), (None, none)])


class _Held:
    """Stands for a table of packages and keeps the function that would read it in the tasks."""
    dtypes = [("doc_id", "string")]

    def __getattr__(self, name):
        return lambda *_: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_a_small_part_is_read_once_and_a_large_one_in_blocks(spark, monkeypatch):
    import zipfile

    import pyarrow as pa
    large = root("w:hdr", p("<w:t>x</w:t>") * 20_000)  # over 256 KB
    contents = {"a": package(p(drawing())), "b": package(p(drawing()), parts={"word/header1.xml": "<w:hdr>" + p("")}),
                "c": package("", parts={"word/header1.xml": large}), "d": package("", parts={"word/header1.xml": large[:-1]}), "e": bytearray(b"nada")}
    opened, real = [], zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: (opened.append(name), real(self, name, *a, **k))[1])
    held = _Held()
    P.shred(held, False)
    batch = pa.RecordBatch.from_arrays([pa.array(list(contents)), pa.array([bytes(x) for x in contents.values()])], ["doc_id", "content"])
    got = list(held.run(iter([batch])))
    assert max(b.num_rows for b in got) <= P.BATCH_ROWS
    rows = [r for b in got for r in b.to_pylist()]
    status = {(r["doc_id"], r["part"]): r["tag"] for r in rows if r["kind"] == "part"}
    assert status[("a", "word/document.xml")] == status[("c", "word/header1.xml")] == "ok"
    assert status[("b", "word/header1.xml")] == status[("d", "word/header1.xml")] == status[("e", None)] == "unreadable"
    count = lambda doc, part: sum(r["doc_id"] == doc and r["part"] == part and r["kind"] != "part" for r in rows)
    assert count("c", "word/header1.xml") == 40_000 and count("b", "word/header1.xml") == count("d", "word/header1.xml") == 0
    assert count("a", "word/document.xml") > 3
    assert opened.count("word/document.xml") == 4 and opened.count("word/header1.xml") == 4  # only c's large one twice


def test_packages_are_made_in_tasks_of_even_size(spark, tmp_path):
    from docaudit.plans.packages import document_packages
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat("doc_id", F.lit(" "), i), 256)), "\n")
    docs = spark.range(600).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("pt").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    made = document_packages(spark, str(tmp_path), docs.select("doc_id").filter("doc_id % 3 > 0"))
    tasks = made.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) >= 4  # two files
