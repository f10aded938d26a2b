"""Collectors: element rows to fact tables.

Two dialects. The rule dialect ignores fallback subtrees and knows frames of both drawing
formats. The dataset dialect counts image nodes, reads titles as alts and keeps fallbacks.
They disagree on purpose and stay apart.
"""
from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators.rules import Facts
from docaudit.session import cut_lineage

_PART = ["doc_id", "part"]
c = F.col


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _visible(elements: DataFrame) -> DataFrame:
    return elements.filter(~c("in_fallback"))


def _content(elements: DataFrame) -> DataFrame:
    return elements.filter(T.is_content_part(c("part")))


def _numbered(rows: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Order inside one package, whose size the format bounds."""
    return rows.withColumn(name, F.row_number().over(
        W.partitionBy("doc_id").orderBy("part", order)))


def _joined_text(order: str = "open_seq") -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(order, "text")))
    return F.array_join(F.transform(pieces, lambda x: x["text"]), "")


def images(elements: DataFrame) -> DataFrame:
    """A frame is an image when its own content holds a bitmap; emitted where it closes."""
    rows = _content(_visible(elements))
    frames = rows.filter(c("tag").isin("wp:inline", "wp:anchor", "v:shape")).select(
        *_PART, c("eid").alias("frame"), "close_seq",
        F.when(c("tag") == "v:shape", F.struct(c("open_seq").alias("at"), _attr("id").alias("name"),
                                               _attr("alt").alias("alt"))).alias("own"))
    inside = rows.filter(c("tag").isin("wp:docPr", "pic:pic", "a:blip", "v:imagedata")
                         & c("frame_eid").isNotNull())
    named = F.when(c("tag") == "wp:docPr", F.struct(
        c("open_seq").alias("at"), _attr("name").alias("name"), _attr("descr").alias("alt")))
    facts = inside.groupBy(*_PART, c("frame_eid").alias("frame")).agg(
        F.max(named).alias("named"), F.bool_or(c("tag") != "wp:docPr").alias("bitmap"))
    found = frames.join(facts.filter("bitmap"), [*_PART, "frame"]).withColumn(
        "who", F.coalesce("named", "own"))
    return _numbered(found, "close_seq").select(
        "doc_id", "part", "seq", c("who.name").alias("name"), c("who.alt").alias("alt"),
        Q.alt_state(c("who.alt")).alias("alt_state"))


def tables(elements: DataFrame) -> DataFrame:
    """Own rows only; the last header mark inside the first row decides."""
    rows = _content(_visible(elements))
    opened = rows.filter(c("tag") == "w:tbl").select(*_PART, c("eid").alias("tbl"), "open_seq")
    opened = opened.withColumn("table_idx", F.row_number().over(
        W.partitionBy(*_PART).orderBy("open_seq")))
    lines = rows.filter((c("tag") == "w:tr") & c("tbl_eid").isNotNull()).groupBy(
        *_PART, c("tbl_eid").alias("tbl")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("eid").alias("first_tr"))
    marks = rows.filter((c("tag") == "w:tblHeader") & c("tr_eid").isNotNull()).select(
        *_PART, c("tbl_eid").alias("tbl"), c("tr_eid").alias("first_tr"), "open_seq",
        T.ooxml_on(_attr("w:val")).alias("on"))
    header = marks.groupBy(*_PART, "tbl", "first_tr").agg(
        F.max_by("on", "open_seq").alias("header"))
    full = lines.join(header, [*_PART, "tbl", "first_tr"], "left").drop("first_tr")
    return opened.join(full, [*_PART, "tbl"], "left").select(
        "doc_id", "part", "table_idx", F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.coalesce("header", F.lit(False)).alias("first_row_header"))


def headings(elements: DataFrame) -> DataFrame:
    """Outline level before style; all text whose innermost paragraph this is."""
    rows = _visible(elements).filter(c("part") == C.DOCUMENT_PART)
    paragraphs = rows.filter(c("tag") == "w:p").filter("kind = 'element'").select(
        *_PART, c("eid").alias("p"), "close_seq")
    level = lambda tag, value: F.max(F.when(
        (c("kind") == "element") & (c("tag") == tag) & value.isNotNull(),
        F.struct(c("open_seq").alias("at"), value.alias("v"))))["v"]
    inside = rows.filter(c("p_eid").isNotNull()).groupBy(*_PART, c("p_eid").alias("p")).agg(
        F.coalesce(level("w:outlineLvl", T.outline_level(_attr("w:val"))),
                   level("w:pStyle", T.style_level(_attr("w:val")))).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            c("kind") == "text", F.struct("open_seq", "text")))), lambda x: x["text"]), "").alias(
            "text"))
    found = inside.filter("level IS NOT NULL").join(paragraphs, [*_PART, "p"])
    return _numbered(found, "close_seq").select("doc_id", "part", "seq", "level", "text")


def relationships(elements: DataFrame) -> DataFrame:
    """Hyperlink targets by owner part and id; a repeated id keeps its last target."""
    rows = _visible(elements).filter(
        (c("tag") == "rel:Relationship") & (_attr("Type") == C.HYPERLINK_TYPE)
        & _attr("Id").isNotNull() & _attr("Target").isNotNull())
    owner = F.concat(F.lit("word/"), F.regexp_extract("part", r"([^/]+)\.rels$", 1))
    return rows.select("doc_id", owner.alias("part"), _attr("Id").alias("rid"),
                       _attr("Target").alias("target"), "open_seq").groupBy(
        *_PART, "rid").agg(F.max_by("target", "open_seq").alias("target"))


def links(elements: DataFrame) -> DataFrame:
    rows = _content(_visible(elements))
    opened = rows.filter((c("tag") == "w:hyperlink") & (c("kind") == "element")).select(
        *_PART, c("eid").alias("link"), "close_seq", _attr("r:id").alias("rid"))
    text = rows.filter((c("kind") == "text") & c("link_eid").isNotNull()).groupBy(
        *_PART, c("link_eid").alias("link")).agg(_joined_text().alias("text"))
    found = opened.join(text, [*_PART, "link"], "left").join(
        relationships(elements), [*_PART, "rid"], "left")
    return _numbered(found, "close_seq").select(
        "doc_id", "part", "seq", F.coalesce("text", F.lit("")).alias("text"), "target")


def languages(elements: DataFrame) -> DataFrame:
    """Any declared language in the styles counts as the default of the document."""
    value = T.trim_ws(_attr("w:val"))
    rows = _visible(elements).filter(
        (c("tag") == "w:lang") & c("part").isin(C.STYLES_PART, C.DOCUMENT_PART)).select(
        *_PART, "open_seq", value.alias("value"))
    kept = rows.filter((c("value") != "") & (F.lower("value") != "x-none"))
    return _numbered(kept, "open_seq").select("doc_id", "part", "seq", "value")


def titles(elements: DataFrame) -> DataFrame:
    """NULL where the element is missing, text (maybe blank) where it exists."""
    rows = _visible(elements).filter((c("part") == C.PROPERTIES_PART) & (
        (c("tag") == "dc:title") | c("in_title")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        (c("kind") == "text") & c("in_title"), F.struct("open_seq", "text")))),
        lambda x: x["text"]), "").alias("title"))


def all_facts(elements: DataFrame, documents: DataFrame) -> Facts:
    docs = documents.select("doc_id").distinct().join(titles(elements), "doc_id", "left")
    return Facts(docs, images(elements), tables(elements), headings(elements), links(elements),
                 languages(elements))


def without(facts: Facts, documents: DataFrame) -> Facts:
    """The facts of all documents but these: a fact follows from the elements of its own document only."""
    return Facts(*[getattr(facts, f.name).join(documents.select("doc_id"), "doc_id", "left_anti") for f in fields(facts)])


def kept(facts: Facts) -> Facts:
    """The facts as tables, each worked out once: for plans that read them several times or would grow large."""
    return Facts(*[cut_lineage(getattr(facts, f.name)) for f in fields(facts)])


def failed_documents(parts: DataFrame) -> DataFrame:
    """In the rule dialect one unreadable part fails the document."""
    return parts.filter("status = 'unreadable'").select("doc_id").distinct()


# ------------------------------------------------------------------ dataset dialect
def alt_candidates(elements: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One row per image node, with alt by precedence and the text around it.

    All parts count, however large: they were read as streams. With ``parts`` those over the contract's limit are left
    out, as a reader has to that holds a whole part in memory.
    """
    rows = _content(elements)
    if parts is not None:
        rows = rows.join(parts.filter("status = 'too_large'").select(*_PART), _PART, "left_anti")
    rank = (F.when(c("tag") == "pic:pic", 0).when(c("tag") == "v:imagedata", 1)
            .when((c("tag") == "a:blip") & ~c("in_pic"), 2))
    nodes = rows.withColumn("rank", rank).filter("rank IS NOT NULL").select(
        *_PART, "rank", "open_seq", "tag", "attrs", c("anchor_eid").alias("anchor"),
        c("p_eid").alias("p"))
    anchors = rows.filter(c("tag").isin("wp:inline", "wp:anchor")).select(
        *_PART, c("eid").alias("anchor"), *[T.trim_ws(_attr(f"docPr@{n}")).alias(f"doc_{n}")
                                            for n in ("name", "descr", "title")])
    full = nodes.join(anchors, [*_PART, "anchor"], "left")
    given = lambda x: F.when(x != "", x)
    own = lambda tag, name: F.when(c("tag") == tag, given(T.trim_ws(_attr(name))))
    sources = [(given(c("doc_descr")), "wp:docPr/@descr"), (given(c("doc_title")), "wp:docPr/@title"),
               (own("pic:pic", "cNvPr@descr"), "pic:cNvPr/@descr"),
               (own("v:imagedata", "o:title"), "v:imagedata/@o:title"),
               (own("v:imagedata", "alt"), "v:imagedata/@alt")]
    origin = F.lit("ausente")
    for value, name in reversed(sources):
        origin = F.when(value.isNotNull(), name).otherwise(origin)
    place = W.partitionBy("doc_id").orderBy("part", "rank", "open_seq")
    named = full.select(
        *_PART, "p", (F.row_number().over(place) - 1).alias("idx"),
        F.coalesce(given(c("doc_name")), own("pic:pic", "cNvPr@name"), F.lit("")).alias("name"),
        F.coalesce(*[v for v, _ in sources], F.lit("")).alias("alt"), origin.alias("alt_origin"))
    around = neighbours(paragraph_texts(rows))
    return named.join(around, [*_PART, "p"], "left").select(
        "doc_id", "part", "idx", "name", "alt", "alt_origin",
        F.coalesce("before", F.lit("")).alias("context_before"),
        F.coalesce("after", F.lit("")).alias("context_after"))


def paragraph_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, part, p, text): all run text below each paragraph, also of nested ones."""
    paragraphs = rows.filter((c("tag") == "w:p") & (c("kind") == "element")).select(
        *_PART, c("eid").alias("p"))
    text = rows.filter(c("p_path").isNotNull()).select(
        *_PART, F.explode("p_path").alias("p"), "open_seq", "text").groupBy(*_PART, "p").agg(
        T.trim_ws(_joined_text()).alias("text"))
    return paragraphs.join(text, [*_PART, "p"], "left")


def neighbours(paragraphs: DataFrame, limit: int = C.CONTEXT_CHARS) -> DataFrame:
    """Nearest non-empty text before and after inside one part: each side is one pass, whatever the part's size."""
    cut = paragraphs.select(*_PART, "p", F.nullif(F.left("text", F.lit(limit)), F.lit("")).alias("text"))
    def nearest(order: Column) -> Column:
        w = W.partitionBy(*_PART).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.last_value("text", True).over(w), F.lit(""))
    return cut.select(*_PART, "p", nearest(c("p").asc()).alias("before"), nearest(c("p").desc()).alias("after"))


def part_report(parts: DataFrame) -> DataFrame:
    """Parts that were not read, per document and status."""
    return parts.filter("status <> 'ok'").groupBy("doc_id").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(c("status") == s, c("part")))), ",").alias(s)
        for s in ("unreadable", "too_large")])
