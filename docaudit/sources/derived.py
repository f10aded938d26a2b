"""Fact tables of the audit read from the given star schema and text tables.

Orders are documents, their lines are images, tables, headings and links. The same rules run
here at table size as on shredded packages.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators.ordered import attach, compute_once, over_ordered, spread_if_one_file
from docaudit.operators.rules import Facts
from docaudit.schemas import TABLES
from docaudit.session import cut_lineage

PART = "word/document.xml"
# Tables whose rows cost far more to compute on than to read.
TEXT_TABLES = ("documents", "pages", "conversations")
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by its declared schema, so that planning reads no footers."""
    rows = spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
    return spread_if_one_file(rows) if name in TEXT_TABLES else rows


def lines(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """All order lines, or those of the documents that ``only`` has, numbered once per order, with their part and the heading
    level before.

    Every kind of line fact is a selection of columns of this one table.
    """
    level = F.lit(1) + F.col("l_quantity").cast("int") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
        level.alias("level"))
    if only is not None:
        rows = rows.join(only.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    spread = F.col("l_linenumber") * F.lit(1e12) + F.col("l_partkey")
    rows = over_ordered(rows, ["l_orderkey"], _LINE_ORDER, spread, number="seq", previous={"before": ("level", 0)})
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name",
                                               F.lit(True).alias("has_part"))
    return attach(rows, part, "l_partkey")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    title = (F.when(key % 6 == 0, F.lit(None).cast("string"))
             .when(key % 11 == 0, "  ").otherwise(F.col("o_orderpriority")))
    state = (F.when(F.col("o_orderstatus") == "F", "CONCLUIDA")
             .when(F.col("o_orderstatus") == "O", "PROCESSANDO").otherwise("RECEBIDA"))
    return table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), F.col("o_custkey").alias("owner_id"), title.alias("title"),
        state.alias("state"))


def images(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    key = F.col("l_partkey")
    alt = (F.when(key % 5 == 0, F.lit(None).cast("string"))
           .when(key % 7 == 0, "  ").otherwise(F.col("p_name")))
    return (lines(spark, sf_dir) if of is None else of).filter("has_part").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(PART).alias("part"), "seq",
        F.col("p_brand").alias("name"), alt.alias("alt"))


def tables(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    rows = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity").cast("int"))
    return (lines(spark, sf_dir) if of is None else of).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(PART).alias("part"), F.col("seq").alias("table_idx"),
        rows.alias("n_rows"), (F.col("l_returnflag") == "R").alias("first_row_header"))


def headings(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return (lines(spark, sf_dir) if of is None else of).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(PART).alias("part"), "seq",
        "level", F.col("l_linestatus").alias("text"), "before")


def links(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    kind = F.col("l_partkey") % 6
    text = (F.when(kind == 0, "Clique aqui!").when(kind == 1, "saiba mais")
            .when(kind == 2, F.concat(F.lit("https://example.org/"), F.col("l_partkey")))
            .when(kind == 3, F.concat(F.lit("doc-"), F.col("l_suppkey")))
            .when(kind == 4, "  ").otherwise(F.col("p_name")))
    target = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("DOC-"), F.col("l_suppkey")))
    return (lines(spark, sf_dir) if of is None else of).filter("has_part").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(PART).alias("part"), "seq",
        text.alias("text"), target.alias("target"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("o_orderkey") % 4 == 0, "word/styles.xml").otherwise(PART)
    value = F.when(F.col("o_custkey") % 2 == 0, "pt-BR").otherwise("en-US")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 4 < 2).select(
        F.col("o_orderkey").alias("doc_id"), part.alias("part"),
        F.lit(1).cast("bigint").alias("seq"), value.alias("value"))


def facts(spark: SparkSession, sf_dir: str, shared: bool = True, only: DataFrame | None = None) -> Facts:
    """All facts, or those of the documents that ``only`` holds. Shared lines are numbered and joined once and written; without,
    each kind that is read plans them anew, which suits a query of one kind."""
    of = cut_lineage(lines(spark, sf_dir, only)) if shared else lines(spark, sf_dir, only)
    if only is not None:
        spoken = languages(spark, sf_dir).join(only.select("doc_id"), "doc_id", "left_semi")
        return Facts(only, images(spark, sf_dir, of), tables(spark, sf_dir, of), headings(spark, sf_dir, of), links(spark, sf_dir, of), spoken)
    return Facts(docs(spark, sf_dir), images(spark, sf_dir, of), tables(spark, sf_dir, of),
                 headings(spark, sf_dir, of), links(spark, sf_dir, of), languages(spark, sf_dir))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log_of(table(spark, sf_dir, "events"))


def event_log_of(events: DataFrame) -> DataFrame:
    """The steps of analyses that the events stand for; events may be a stream."""
    kind = F.col("event_type")
    state = (F.when(kind == "signup", "RECEBIDA").when(kind == "view", "PROCESSANDO")
             .when(kind == "purchase", "CONCLUIDA").when(kind == "error", "FALHOU"))
    return events.filter(kind != "click").select(
        F.col("user_id").alias("analysis_id"), "event_id", "ts", state.alias("state"))


def alt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of every document: the alt texts of the dataset queries."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n"))).select(
        "doc_id", F.col("pos").cast("bigint").alias("line_no"), "lang", "source",
        F.col("col").alias("line"), T.trim_ws(F.col("col")).alias("alt"))


def alt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as rows of an alt-text dataset of several sources, partly reviewed."""
    d, n = F.col("doc_id"), F.col("line_no")
    human = (F.when(F.col("quality") == 1, "GOOD").when(F.col("toxic") == 1, "INSUFFICIENT")
             .when(F.col("quality") == 0, "WEAK"))
    labels = table(spark, sf_dir, "labels")
    rows = compute_once(attach(alt_lines(spark, sf_dir), labels, "doc_id", "left"), alt=F.col("alt"))
    norm = F.col("norm")
    rows = compute_once(rows, norm=T.normalize_alt(F.col("alt")))
    group = T.group_key(F.col("alt"), F.concat(F.lit("doc-"), d, F.lit(".docx")), norm)
    # Filters on the labels and the split would else repeat what they are made of.
    rows = compute_once(rows, group_key=group, provisional_label=F.when(
        F.col("alt") != "", Q.provisional_label(F.col("alt"), norm)))
    rows = compute_once(rows, split=T.split_of(F.col("group_key")))
    return rows.select(
        (d * 100000 + n).alias("ord"), d.alias("doc_id"),
        F.concat(F.lit("doc-"), d, F.lit(".docx#"), n).alias("id"),
        F.concat(F.lit("doc-"), d, F.lit(".docx")).alias("file"), "alt", "lang",
        F.when((d % 4).isin(1, 2), "wikimedia-commons").when(d % 4 == 3, "web").alias("source"),
        F.when((d % 4 == 3) & (n % 2 == 0), "sintetico_fallback")
        .when(d % 4 == 3, "coletado").alias("data_origin"),
        "group_key", F.when((d + n) % 3 == 0, human).alias("label"), "split", "provisional_label",
        F.when(((d + n) % 3 == 0) & human.isNotNull(), "humano").alias("label_origin"))


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), ts)
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (
        seconds * 1_000_000).cast("bigint")
