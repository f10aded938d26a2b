"""Collecting alt texts in scan order until a quota is met.

The source is read in growing ranges of its order, and no further than the quota needs. Only the
first occurrences inside the quota are ordered, by a top-n that every task trims first. Everything
else is an aggregate up to the place where the scan stopped.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators.ordered import compute_once, first_per_group
from docaudit.session import new_folder

#: Places in the first range of a scan, and how many times further each later range ends.
FIRST_RANGE, GROWTH = 1024, 4


@dataclass(frozen=True)
class Collection:
    accepted: DataFrame
    totals: DataFrame
    per_page: DataFrame | None = None


def _stop(accepted: DataFrame, order: str, limit: int) -> Column:
    """Place of the last acceptance when the limit was met, else NULL: nothing stopped it."""
    return accepted.agg(F.when(F.count(F.lit(1)) >= limit, F.max(order)).alias("stop")).scalar()


def _scanned(source: DataFrame, order: str, judge: Callable[[DataFrame], DataFrame], limit: int,
             start: int) -> DataFrame:
    """judge(source) as far as ``limit`` different values of its ``group_key`` need, or all of it.

    A range is a filter on ``order`` alone, so that a scan skips what lies elsewhere by the statistics of files and row
    groups. It is judged and written once; later ranges find it there. ``start`` is about where the order begins: a lower
    value costs empty ranges, a higher one nothing but a longer first range.
    """
    spark, place = source.sparkSession, F.col(order)
    paths, width = [], FIRST_RANGE
    inside = place.isNull() | (place < start + width)
    while True:
        rows = judge(source.filter(inside))
        paths.append(new_folder(spark, "range"))
        rows.write.parquet(paths[-1])
        seen = spark.read.schema(rows.schema).parquet(*paths)
        met = seen.select("group_key").filter("group_key IS NOT NULL").distinct().limit(limit).count()
        end = start + width
        if met >= limit or source.filter(place >= end).select(order).isEmpty():
            return seen
        width *= GROWTH
        inside = (place >= end) & (place < start + width)


def archive_candidates(files: DataFrame, source: str = "ambos") -> DataFrame:
    """files(ord, pageid, caption, description, ...) with the text that would be taken."""
    caption, description = F.col("caption"), F.col("description")
    if source == "legenda":
        description = F.lit(None).cast("string")
    if source == "descricao":
        caption = F.lit(None).cast("string")
    has = lambda c: F.coalesce(c != "", F.lit(False))
    first, second = T.clean_archive_text(caption), T.clean_archive_text(description)
    taken = compute_once(files, first=first, second=second,
                         any_text=has(caption) | has(description))
    text = F.coalesce("first", "second")
    origin = F.when(F.col("first").isNotNull(), "commons/legenda").when(
        F.col("second").isNotNull(), "commons/descricao")
    return compute_once(
        taken.withColumns({"alt": text, "alt_origin": origin}),
        group_key=F.when(text.isNotNull(), T.group_key(text, F.col("pageid")))).drop(
        "first", "second")


def collect_archive(files: DataFrame, limit: int, source: str = "ambos", start: int = 0) -> Collection:
    """Distinct texts in order up to the limit, and why visited files were left out."""
    rows = _scanned(files, "ord", lambda some: archive_candidates(some, source), limit, start)
    firsts = first_per_group(rows, "group_key", ["ord"]).filter("group_key IS NOT NULL")
    accepted = firsts.orderBy("ord").limit(limit)
    stop = _stop(accepted, "ord", limit)
    visited = rows.filter(stop.isNull() | (F.col("ord") <= stop))
    reason = (F.when(~F.col("any_text"), "sem_texto").when(F.col("alt").isNull(), "limpeza")
              .otherwise("texto"))
    counted = visited.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    taken = accepted.agg((-F.count(F.lit(1))).alias("n")).select(
        F.lit("texto").alias("reason"), "n")
    totals = counted.unionByName(taken).groupBy(
        F.when(F.col("reason") == "texto", "duplicado").otherwise(F.col("reason")).alias(
            "reason")).agg(F.sum("n").alias("files"))
    return Collection(accepted, totals)


def collect_pages(pages: DataFrame, quota: int, images: Callable[[DataFrame], DataFrame],
                  order: str = "page_ord", start: int = 0) -> Collection:
    """Insufficient alts in page order up to quota, of pages that ``order`` numbers.

    ``images`` makes rows (page_ord, url, idx, has_alt, alt) of pages; it is asked for a range of them at a time.
    ``idx`` counts the images of a page that carry an alt attribute.
    """
    def judged(some: DataFrame) -> DataFrame:
        cleaned = compute_once(images(some), text=T.clean_web_text(F.col("alt")))
        rows = compute_once(cleaned, reason=Q.insufficient_reason(F.col("text")),
                            group_key=T.normalize_alt(F.col("text")))
        return rows.select("page_ord", "url", "idx", "has_alt", "text", "reason", F.struct("page_ord", "idx").alias("place"),
                           F.when(F.col("reason").isNotNull(), F.col("group_key")).alias("group_key"))

    rows = _scanned(pages, order, judged, quota, start)
    found = rows.select(
        "place", "page_ord", "idx", "url", F.col("text").alias("alt"), "reason", "group_key")
    firsts = first_per_group(found, "group_key", ["place"])
    accepted = firsts.filter("group_key IS NOT NULL").orderBy("place").limit(quota)
    stop = _stop(accepted, "place", quota)
    visited = rows.filter(stop.isNull() | (F.col("page_ord") <= stop["page_ord"]))
    tried = (F.col("reason").isNotNull()
             & (stop.isNull() | (F.col("place") <= stop)))
    pages = visited.groupBy("page_ord", "url").agg(
        F.count(F.lit(1)).alias("images"),
        F.count(F.when(~F.col("has_alt"), 1)).alias("no_alt"),
        F.count(F.when(F.col("has_alt") & F.col("text").isNull(), 1)).alias("empty_alt"),
        F.count(F.when(F.col("text").isNotNull() & F.col("reason").isNull(), 1)).alias(
            "not_insufficient"),
        F.count(F.when(tried, 1)).alias("tried"))
    taken = accepted.groupBy("page_ord").agg(F.count(F.lit(1)).alias("accepted"))
    per_page = pages.join(taken, "page_ord", "left").na.fill(0, ["accepted"]).withColumn(
        "duplicates", F.col("tried") - F.col("accepted")).drop("tried")
    totals = per_page.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (
        "images", "no_alt", "empty_alt", "not_insufficient", "duplicates", "accepted")])
    return Collection(accepted.drop("place"), totals, per_page)
