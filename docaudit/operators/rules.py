"""Rules turn fact tables into findings.

A rule is a function from facts to (doc_id, part, evidence) rows. The engine adds what the
catalogue knows and unions the outputs, so the plan is one branch per rule and Spark prunes
each branch to the columns that rule reads.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators.ordered import keep_present, over_ordered, top_per_group
from docaudit.sources.catalog import applicability, check_rules

FINDING = ["doc_id", "rule_id", "criterion", "level", "severity", "part", "evidence"]


@dataclass(frozen=True)
class Facts:
    """docs(doc_id, title), images, tables, headings, links, languages: one row per fact."""
    docs: DataFrame
    images: DataFrame
    tables: DataFrame
    headings: DataFrame
    links: DataFrame
    languages: DataFrame


@dataclass(frozen=True)
class Rule:
    id: str
    criterion: str
    severity: str
    evaluate: Callable[[Facts], DataFrame]


def images_without_alt(facts: Facts) -> DataFrame:
    """A missing attribute only: a blank one declares the image decorative."""
    name = F.when(T.is_blank(F.col("name")), "(sem nome)").otherwise(F.col("name"))
    return facts.images.filter(Q.alt_state(F.col("alt")) == C.ALT_MISSING).select(
        "doc_id", "part", F.format_string(
            "imagem '%s' nao tem atributo de texto alternativo (descr)", name).alias("evidence"))


def tables_without_header(facts: Facts) -> DataFrame:
    return facts.tables.filter((F.col("n_rows") > 0) & ~F.col("first_row_header")).select(
        "doc_id", "part", F.format_string(
            "tabela %s (%s linhas) nao marca a primeira linha como cabecalho (w:tblHeader)",
            F.col("table_idx").cast("string"), F.col("n_rows").cast("string")).alias("evidence"))


def heading_jumps(facts: Facts) -> DataFrame:
    """A level more than one below the previous heading; going up is never a jump."""
    rows = facts.headings
    if "before" not in rows.columns:  # a source that numbered its headings may have looked back already
        rows = over_ordered(rows, ["doc_id"], ["seq"], F.col("seq"), previous={"before": ("level", 0)})
    level, before = F.col("level").cast("string"), F.col("before").cast("string")
    origin = F.when(F.col("before") == 0, F.concat(
        F.lit("o primeiro titulo do documento e H"), level, F.lit(", e nao H1"))).otherwise(
        F.concat(F.lit("titulo H"), level, F.lit(" vem logo depois de um H"), before))
    return rows.filter(F.col("level") > F.col("before") + 1).select(
        "doc_id", "part", F.concat(origin, F.lit(" — '"), T.heading_summary(F.col("text")),
                                   F.lit("'")).alias("evidence"))


def missing_titles(facts: Facts) -> DataFrame:
    evidence = F.when(F.col("title").isNull(),
                      "o pacote nao declara dc:title em docProps/core.xml").otherwise(
        "dc:title existe em docProps/core.xml mas esta em branco")
    return facts.docs.filter(T.is_blank(F.col("title"))).select(
        "doc_id", F.lit(C.PROPERTIES_PART).alias("part"), evidence.alias("evidence"))


def undescriptive_links(facts: Facts) -> DataFrame:
    text = T.trim_ws(F.coalesce(F.col("text"), F.lit("")))
    external = ~T.is_blank(F.col("target"))
    rows = facts.links.select("doc_id", "part", text.alias("text"), "target",
                              external.alias("external")).filter("text <> ''")
    own_url = T.is_url(F.col("text")) | (
        F.col("external") & (F.lower("text") == F.lower("target")))
    message = (
        F.when(T.normalize_link(F.col("text")).isin(*C.GENERIC_LINK_TEXTS),
               F.concat(F.lit("texto de link generico: '"), F.col("text"), F.lit("'")))
        .when(own_url, F.concat(F.lit("o texto do link e a propria URL: '"),
                                T.ellipsis(F.col("text")), F.lit("'"))))
    suffix = F.when(F.col("external"), F.concat(
        F.lit(" (destino: "), T.ellipsis(F.col("target")), F.lit(")"))).otherwise("")
    evidence = F.concat(message, suffix)
    return keep_present(rows, "evidence", evidence).select("doc_id", "part", "evidence")


def undeclared_languages(facts: Facts) -> DataFrame:
    """No default language; the first three distinct local ones are quoted.

    Repeated values collapse before the shuffle, so a document with many marks costs one row
    per distinct value.
    """
    per_value = facts.languages.groupBy("doc_id", "value").agg(
        F.min(F.struct("part", "seq")).alias("at"),
        F.bool_or(F.col("part") == C.STYLES_PART).alias("default"))
    default = per_value.groupBy("doc_id").agg(F.bool_or("default").alias("has_default"))
    first = top_per_group(per_value, ["doc_id"], ["at", "value"], 3).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                                 lambda v: v["value"]), ", ").alias("sample"))
    known = default.join(first, "doc_id")
    rows = facts.docs.select("doc_id").join(known, "doc_id", "left").filter(
        ~F.coalesce("has_default", F.lit(False)))
    evidence = F.when(F.col("sample").isNull(),
                      "o documento nao declara idioma em lugar nenhum (w:lang ausente)").otherwise(
        F.concat(F.lit("ha idioma declarado apenas em trechos ("), F.col("sample"),
                 F.lit("), mas nao no padrao do documento em word/styles.xml")))
    return rows.select("doc_id", F.lit(C.STYLES_PART).alias("part"), evidence.alias("evidence"))


_EVALUATE = dict(zip((r[0] for r in C.RULES), (
    images_without_alt, tables_without_header, heading_jumps, missing_titles,
    undescriptive_links, undeclared_languages)))
RULES = tuple(Rule(i, criterion, severity, _EVALUATE[i]) for i, criterion, severity in C.RULES)


def run_rules(facts: Facts, rules: Sequence[Rule] = RULES,
              criteria: Sequence[tuple] = C.CRITERIA) -> DataFrame:
    """Findings of all rules; a criterion that cannot be violated yields none."""
    check_rules(rules, criteria)
    levels = {c[0]: c[2] for c in criteria if applicability(c[3]) != "INAPLICAVEL"}
    rows = [r.evaluate(facts).select("doc_id", *[F.lit(v).alias(k) for k, v in (
        ("rule_id", r.id), ("criterion", r.criterion), ("level", levels[r.criterion]),
        ("severity", r.severity))], "part", "evidence")
        for r in rules if r.criterion in levels]
    if not rows:
        empty = rules[0].evaluate(facts).limit(0) if rules else facts.docs.select("doc_id").limit(0)
        return empty.select("doc_id", *[F.lit("").alias(c) for c in FINDING[1:]])
    return reduce(DataFrame.unionByName, rows)


def with_catalogue(findings: DataFrame, criteria: DataFrame) -> DataFrame:
    """Stored findings with what the catalogue says about their criterion."""
    # One row per criterion of a catalogue that catalog.py has checked.
    return findings.join(F.broadcast(criteria.select("criterion", F.col("title").alias(
        "criterion_title"), "applicability")), "criterion")


def evaluated_principles(rules: Sequence[Rule] = RULES,
                         criteria: Sequence[tuple] = C.CRITERIA) -> list[str]:
    """Principles that at least one applicable rule measures, in catalogue order."""
    check_rules(rules, criteria)
    usable = {c[0] for c in criteria if c[3].strip().upper() != "INAPLICAVEL"}
    digits = {r.criterion[0] for r in rules if r.criterion in usable}
    return [name for digit, name, _ in C.PRINCIPLES if digit in digits]
