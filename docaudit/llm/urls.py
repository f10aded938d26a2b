"""URL filter: rules first, for the rest a tree of path templates per host.

*Rules* are a short list given by the caller (verdict, host, path). A rule fits its host and all
subdomains when the url's path starts with the rule's path; the longest one wins.

*Tree.* A path is cut into segments, and what varies by its form (numbers, hexadecimal ids) becomes a
placeholder. Pages with one (host, path of placeholders) collapse to a row with counts before anything
else happens. Then, at every node of a host's tree: if it has many different children for its pages,
they become one wildcard; and a labelled child whose share of good pages does not differ from that of
its siblings together (two-proportion test) is merged with them. A child without labels is never merged,
as nothing says that it is alike. What a page's segments then read is its template.

*Verdict.* Purity of a template is (good + 1) / (good + bad + 2); below ``min_purity`` it is blocked. A
template without labels has one half and is allowed.

A null url, or one without ``://``, has the empty host and path; it fits no rule and is judged as the
empty template. Null ids and repeated rows stay as they are. An empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import ascii_lower, spread_join, written

#: (verdict, host, path)
Rule = tuple[str, str, str]
MIN_PURITY = 0.4
#: A node with so many different children, at least one for every two pages, is a wildcard.
WIDE = 8
#: Square of the normal quantile for 5 percent.
CRITICAL = 3.84
#: Segments that vary by their form, first match wins.
FORMS = ((r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}"),
         (r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{8,}$", "{hex}"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z), and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The rule that wins as host + path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    out = F.regexp_replace(segment, r"[0-9]+", "{n}")
    for pattern, name in reversed(FORMS):
        out = F.when(segment.rlike(pattern), name).otherwise(out)
    return out


def _rate_differs(good: Column, bad: Column, all_good: Column, all_bad: Column) -> Column:
    """Two-proportion test of a child against its siblings together."""
    n, m = good + bad, all_good + all_bad - good - bad
    pooled = all_good / (all_good + all_bad)
    gap = good / n - (all_good - good) / m
    return F.when((n > 0) & (m > 0), gap * gap > CRITICAL * pooled * (1 - pooled) * (1 / n + 1 / m)).otherwise(True)


def templates(pages: DataFrame) -> DataFrame:
    """(host, form, template, good, bad) of every (host, form): its segments generalised by the tree.

    ``pages`` has host, form (array of segments), good and bad (0 or 1 each).
    """
    rows = written(pages.groupBy("host", "form").agg(
        F.count("*").alias("pages"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-forms")
    step = rows.select("*", F.posexplode("form").alias("at", "segment"))
    step = step.withColumn("parent", F.array_join(F.slice("form", F.lit(1), F.col("at")), "/"))
    node = ["host", "at", "parent"]
    child = step.groupBy(*node, "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")])
    whole = child.groupBy(*node).agg(F.count("*").alias("children"), *[F.sum(c).alias("all_" + c) for c in ("pages", "good", "bad")])
    kinds = spread_join(child, whole, node)
    wide = (F.col("children") >= WIDE) & (2 * F.col("children") >= F.col("all_pages"))
    alike = ~_rate_differs(F.col("good"), F.col("bad"), F.col("all_good"), F.col("all_bad"))
    token = F.when(wide, "*").when(alike, "{alike}").otherwise(F.col("segment"))
    kinds = kinds.select(*node, "segment", token.alias("token"))
    named = spread_join(step.select("host", "form", "at", "parent", "segment", "good", "bad"), kinds, [*node, "segment"])
    again = named.groupBy("host", "form").agg(
        F.array_sort(F.collect_list(F.struct("at", "token"))).alias("tokens"),
        F.first("good").alias("good"), F.first("bad").alias("bad"))
    return again.select("host", "form", F.array_join("tokens.token", "/").alias("template"), "good", "bad")


def judge(pages: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url",
          min_purity: float = MIN_PURITY) -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) per page. Pages that a rule decides are the labels."""
    raw = pages.select(F.col(id).alias("id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    split = raw.select("id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    seen = split.select("*", rule.alias("rule"), ruled.alias("ruled"),
                        F.transform(F.split("path", "/"), _form).alias("form"))
    labels = [F.coalesce(F.col("ruled") == v, F.lit(False)).cast("long").alias(c) for v, c in (("allow", "good"), ("block", "bad"))]
    tree = written(templates(seen.select("host", "form", *labels)), "url-templates")
    pure = tree.groupBy("host", "template").agg(((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2)).alias("purity"))
    named = spread_join(tree.select("host", "form", "template"), pure, ["host", "template"])
    out = spread_join(seen, named, ["host", "form"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") < min_purity, "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
