"""The criterion catalogue and the checks that stop a job before it starts."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from docaudit import constants as C

MOST = 1000
SCHEMA = "criterion string, title string, level string, applicability string"


class CatalogueError(ValueError):
    """The catalogue or a rule that cites it is not usable."""


def applicability(value: str) -> str:
    """Closed set, read without regard to case or outer space; anything else is an error."""
    name = (value or "").strip().upper()
    if name not in C.ICT_APPLICABILITY:
        raise CatalogueError(f"unknown applicability {value!r}, expected {C.ICT_APPLICABILITY}")
    return name


def catalogue(spark: SparkSession, criteria: Iterable[tuple] = C.CRITERIA) -> DataFrame:
    rows = [(c, title, level, applicability(kind)) for c, title, level, kind in criteria]
    if len(rows) > MOST:
        raise CatalogueError(f"{len(rows)} criteria, expected a catalogue of at most {MOST}")
    for criterion, _, level, _ in rows:
        if level not in C.LEVELS:
            raise CatalogueError(f"criterion {criterion} has unknown level {level!r}")
    return spark.createDataFrame(rows, SCHEMA)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue from its JSON file; a table of a few rows, so it may be checked here."""
    rows = (spark.read.option("multiLine", True).json(path)
            .selectExpr("inline(criterios)").select("id", "titulo", "nivel", "aplicabilidadeIct"))
    n = rows.count()
    if n > MOST:
        raise CatalogueError(f"{n} criteria, expected a catalogue of at most {MOST}")
    return catalogue(spark, [tuple(r) for r in rows.collect()])


def check_rules(rules: Iterable, criteria: Iterable[tuple] = C.CRITERIA) -> None:
    """Every rule must cite a known criterion, or nothing runs."""
    known = {c[0] for c in criteria}
    bad = [f"{r.id} -> {r.criterion}" for r in rules if r.criterion not in known]
    if bad:
        raise CatalogueError("rules cite unknown criteria: " + ", ".join(bad))
