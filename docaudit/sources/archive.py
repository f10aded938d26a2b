"""Media archive answers: flatten API pages, walk the category tree."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.operators.ordered import attach
from docaudit.session import cut_lineage

ANSWER = """struct<query: struct<pages: array<struct<
    pageid: bigint, title: string, entityterms: struct<label: array<string>>,
    imageinfo: array<struct<descriptionurl: string, extmetadata: struct<
        ImageDescription: struct<value: string>, LicenseShortName: struct<value: string>>>>>>>>"""


def flatten_answers(answers: DataFrame, body: Column, category: Column) -> DataFrame:
    """One row per file of JSON answers: first caption, description, licence, address."""
    pages = answers.select(category.alias("category"), F.explode(
        F.from_json(body, ANSWER)["query"]["pages"]).alias("p"))
    info = F.get(F.col("p.imageinfo"), F.lit(0))
    return pages.select(
        F.coalesce("p.pageid", F.lit(0)).cast("bigint").alias("pageid"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.get(F.col("p.entityterms.label"), F.lit(0)).alias("caption"),
        info["extmetadata"]["ImageDescription"]["value"].alias("description"),
        F.coalesce(info["extmetadata"]["LicenseShortName"]["value"],
                   F.lit("nao declarada")).alias("license"),
        F.coalesce(info["descriptionurl"], F.lit("")).alias("url"), "category")


def expand_categories(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Breadth first over edges(parent, child) from seeds(category), at most ``depth`` levels.

    One join and one anti-join per level; the walk ends at the first empty frontier. Each
    level is checkpointed, so the plan does not grow with the depth.
    """
    visited = seeds.select("category").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for level in range(1, max(depth, 0) + 1):
        reached = attach(edges, frontier.select(F.col("category").alias("parent")), "parent",
                         "left_semi")
        frontier = cut_lineage(
            reached.select(F.col("child").alias("category")).distinct()
            .join(visited.select("category"), "category", "left_anti")
            .withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
