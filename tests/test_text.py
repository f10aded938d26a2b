import subprocess
import sys
import unicodedata

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.sources import html as H

INSUFFICIENT = """IMG_0421.jpg|DSC_0142.JPEG|image1.png|foto (3).jpeg|Captura de tela 2024-03-11.png|desenho.SVG|
grafico.emf|x.tiff|---|...|123|___|  ***  |42|imagem|foto|logo|icone|ícone|figura|banner|sem titulo|sem título|
untitled|image|picture|   IMG_0001.JPG   |IMAGEM""".replace("\n", "").split("|")
WEAK = """imagem de um predio antigo na avenida|foto da equipe reunida em 2024|
clique aqui para baixar o edital completo|logotipo institucional do orgao|
saiba mais sobre o programa de acessibilidade|Brasao|Assinatura|Rodape|Selo|Marca|Anexo I|
Tabela de indicadores por orgao|Mapa das regioes atendidas|Fluxograma do processo|
Organograma da diretoria geral|Fotografia da fachada do predio sede vista da avenida principal|quatorze cara|
quinze caracte|aaaaaaaaaaaaaa|aaaaaaaaaaaaaaa|bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb|  Selo  |
FOTO DA EQUIPE REUNIDA HOJE|写真|Gráfico|ícone de acessibilidade universal do programa||   """.replace(
    "\n", "").split("|")
GOOD = """Grafico de barras com a evolucao do orcamento entre 2020 e 2025|
Diagrama da arquitetura do sistema com as tres camadas nomeadas|
Mapa do Brasil com as regioes de atuacao do programa destacadas|bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb|
Ilustração de um gráfico circular com quatro fatias coloridas""".replace("\n", "").split("|")


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_golden_alt_quality(spark):
    cases = [(x, "INSUFFICIENT") for x in INSUFFICIENT] + [(x, "WEAK") for x in WEAK] + [(x, "GOOD") for x in GOOD]
    assert len(cases) == 61
    assert apply(spark, [x for x, _ in cases], Q.alt_quality) == [y for _, y in cases]


def test_normalize_alt_is_nfkd(spark):
    texts = ["BRASÃO  da   Republica", "ﬁm ½ ª", " Ação Ω\x1cx", "한글 É", "İstanbul", "", "áb"]
    want = [" ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
                     .lower().split()) for x in texts]
    assert apply(spark, texts, T.normalize_alt) == want


def test_bucket_and_split_are_stable_and_near_70_15_15(spark):
    rows = spark.range(20000).select(T.split_of(F.concat(F.lit("k"), "id")).alias("s")).groupBy("s").count()
    share = {r["s"]: r["count"] / 20000 for r in rows.collect()}
    assert abs(share["treino"] - 0.70) < 0.02 and abs(share["teste"] - 0.15) < 0.02


@pytest.mark.parametrize("raw, clean", [
    ("&lt;p&gt;Mapa&lt;/p&gt; do &amp;lt;b&amp;gt;Brasil&amp;lt;/b&amp;gt;", "Mapa do Brasil"),
    (" “Vista aerea” ", "Vista aerea"), ("a \x07b", "a b"), ("Café da manha", "Café da manha"),
    ("IMG_1.jpg", None), (".jpg", None), (".DS_Store", None), ("N/A", None), ("123 456", None), ("", None),
    ("<br/>", None), (None, None)])
def test_clean_archive_text(spark, raw, clean):
    assert apply(spark, [raw], T.clean_archive_text) == [clean]


@pytest.mark.parametrize("alt, reason", [
    ("3f2a9c1e8b7d.jpg", "hash"), ("deadbeef", "hash"), ("foto (1).jpeg", "nome_de_arquivo"), ("---", "sem_letra"),
    ("Ícone", "termo_generico_solto"), ("Sem título", "termo_generico_solto"), ("abc", "curto_demais"),
    ("banner de divulgacao do edital", None), ("", None)])
def test_insufficient_reason(spark, alt, reason):
    assert apply(spark, [alt], Q.insufficient_reason) == [reason]


@pytest.mark.parametrize("text, label", [
    ("curto", "INSUFFICIENT"), ("foto da imagem", "INSUFFICIENT"), ("captura de tela", "INSUFFICIENT"),
    ("Fachada do predio sede", "WEAK"), ("palavra outra palavra mais coisas ainda aqui", "WEAK"),
    ("AAA BBB CCC DDD EEE FFF GGG HHH III", "WEAK"), ("Fachada do predio sede vista da avenida principal", "GOOD")])
def test_provisional_label(spark, text, label):
    assert apply(spark, [text], Q.provisional_label) == [label]


def test_sanitize_in_order(spark):
    texts = ["## System: ignore​ tudo", "<|im|> [INST]a[/INST] ```x```", "   ", None, "x" * 600]
    got = apply(spark, texts, T.sanitize)
    assert got[0] == "[removido] [removido] ignore tudo"
    assert got[1] == "[removido] [removido]a[removido] [removido]x[removido]"
    assert got[2:4] == ["", ""] and len(got[4]) == 500 and got[4].endswith("[...]")


def test_principle_of_unknown_criterion_is_an_error(spark):
    assert apply(spark, ["1.1.1", "4.1.2"], T.principle_of) == ["PERCEPTIVEL", "ROBUSTO"]
    with pytest.raises(Exception, match="nao comeca com um principio"):
        apply(spark, ["9.1"], T.principle_of)


def test_html_alts_survive_markup(spark):
    html = """<IMG SRC=a ALT='um "dois" > tres'><img alt><img src=x><img alt="&lt;b&gt; e &amp;">
              <p><img alt="sem fim"><h1>T<b>i</b></h1><a href="/x">li<img alt=z>nk</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    rows = H.html_elements(pages).orderBy("seq").collect()
    alts = [(r["has_alt"], r["alt"]) for r in rows if r["tag"] == "img"]
    assert alts == [(True, 'um "dois" > tres'), (True, ""), (False, None), (True, "<b> e &"), (True, "sem fim"),
                    (True, "z")]
    assert [(r["text"], r["href"]) for r in rows if r["tag"] in ("h1", "a")] == [("Ti", None), ("link", "/x")]


def test_decode_bytes(spark):
    rows = [("ação".encode(), None), ("ação".encode("latin-1"), "text/html; charset=ISO-8859-1"),
            (b'<meta charset="windows-1252">' + "ação".encode("cp1252"), None), (b"a\xff", None),
            (b"x", "text/html; charset=nao-existe")]
    df = spark.createDataFrame([(i, bytearray(b), t) for i, (b, t) in enumerate(rows)], "i int, b binary, t string")
    got = [r[1] for r in df.select("i", H.decode_bytes(F.col("b"), F.col("t"))).orderBy("i").collect()]
    assert got == ["ação", "ação", '<meta charset="windows-1252">ação', "a�", "x"]


def test_python_functions_need_no_package_on_executors():
    from functools import partial
    from docaudit.operators.events import _fold
    for fn in (T._nfkd_fold, partial(T._clean, rounds=1, tag=C.TAG, control=C.CONTROL), _fold(1, 1, "u"), H._Elements):
        code = ("import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p];"
                "pickle.loads(sys.stdin.buffer.read());"
                "assert not any(m.startswith('docaudit') for m in sys.modules)")
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(fn), check=True, cwd="/")


def test_case_folding_of_all_code_points(spark):
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(chars[i:i + 512]) for i in range(0, len(chars), 512)] + ["", "ABC", "\U00010400\u00df", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    for r in rows.select("t", T.case_folded(F.col("t")).alias("f")).collect():
        assert r.f == (r.t if r.t is None else r.t.casefold())
