"""Building the alt-text dataset: assemble, merge, split, review, check.

Rows carry ``ord``, their place in the file, and ``group_key``, the canonical alt.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import quality as Q
from docaudit.functions import text as T
from docaudit.operators.ordered import attach, compute_once, first_per_group

ROW = ["format_version", "source", "data_origin", "id", "file", "doc_sha256", "part",
       "image_name", "alt", "alt_origin", "has_alt", "context_before", "context_after",
       "group_key", "split", "org", "sphere", "category", "license", "url", "filter_reason",
       "provisional_label", "label_origin", "label", "reviewed_at"]
_TYPES = {"format_version": "int", "has_alt": "boolean"}


class DatasetError(ValueError):
    """The dataset cannot carry the next step; the message says why."""


def _row(df: DataFrame, **given: Column) -> DataFrame:
    """All columns of a dataset row; what is not given is NULL."""
    given = {"format_version": F.lit(C.FORMAT_VERSION), "context_before": F.lit(""),
             "context_after": F.lit("")} | given
    return df.select(*[given.get(n, F.lit(None)).cast(_TYPES.get(n, "string")).alias(n)
                       for n in ROW])


def assemble(candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """candidates(file, idx, part, name, alt, ...) with the provenance of their file.

    The label stays NULL: nobody has labelled. Images without alt stay, not trainable.
    """
    c = F.col
    keyed = attach(candidates, provenance, "file", "inner").withColumn(
        "group_key", T.group_key(c("alt"), c("file")))
    return _row(
        keyed, id=F.concat_ws("#", "file", c("idx").cast("string")), file=c("file"),
        doc_sha256=c("sha256"), part=c("part"), image_name=c("name"), alt=c("alt"),
        alt_origin=c("alt_origin"), has_alt=~T.is_blank(c("alt")),
        context_before=c("context_before"), context_after=c("context_after"),
        group_key=c("group_key"), split=T.split_of(c("group_key")), org=c("org"),
        sphere=c("sphere"), category=c("category"), license=c("license"), url=c("url"))


def archive_rows(accepted: DataFrame, labelled: bool = False) -> DataFrame:
    """Accepted archive files as rows; the pre-label becomes a label only on request."""
    c = F.col
    rows = compute_once(accepted, provisional=Q.provisional_label(c("alt")))
    extra = {"label": c("provisional"), "label_origin": F.lit("heuristica")} if labelled else {}
    return _row(
        rows, source=F.lit("wikimedia-commons"), id=F.concat(F.lit("commons:"), "pageid"),
        file=c("title"), image_name=F.regexp_replace("title", "^File:", ""), alt=c("alt"),
        alt_origin=c("alt_origin"), has_alt=F.lit(True), group_key=c("group_key"),
        split=T.split_of(c("group_key")), org=F.lit("Wikimedia Commons"),
        sphere=F.lit("acervo publico"), category=c("category"), license=c("license"),
        url=c("url"), provisional_label=c("provisional"), **extra)


def web_rows(accepted: DataFrame) -> DataFrame:
    """Collected web alts as rows; the id names host, path and place on the page."""
    c = F.col
    host = T.url_host(c("url"))
    return _row(
        accepted, source=F.lit("web-publica"), data_origin=F.lit("coletado"),
        id=F.concat(F.lit("web:"), host, T.url_path(c("url")), F.lit("#"),
                    c("idx").cast("bigint").cast("string")),
        file=host, alt=c("alt"), alt_origin=F.lit("html/img/@alt"), has_alt=F.lit(True),
        group_key=c("group_key"), split=T.split_of(c("group_key")), org=host,
        sphere=F.lit("web publica"), category=F.lit("pagina html"),
        license=F.lit("nao declarada"), url=c("url"), filter_reason=c("reason"),
        provisional_label=F.lit(C.INSUFFICIENT))


def synthetic_rows(spark: SparkSession, quantity: int = C.SYNTHETIC_MAXIMUM) -> DataFrame:
    """The fixed fallback texts, one of each pattern in turn, always in the training split."""
    if quantity < 0:
        raise DatasetError("quantity cannot be negative")
    texts = [(place, rank, alt, pattern) for rank, (pattern, alts) in enumerate(C.SYNTHETIC_ALTS)
             for place, alt in enumerate(alts)]
    catalogue = spark.createDataFrame(texts, "place int, rank int, alt string, pattern string")
    kept = catalogue.orderBy("place", "rank").limit(min(quantity, C.SYNTHETIC_MAXIMUM))
    c = F.col
    rows = kept.withColumn("norm", T.normalize_alt(c("alt")))
    return _row(
        rows, source=F.lit("sintetico"), data_origin=F.lit("sintetico_fallback"),
        id=T.synthetic_id(c("alt")), file=F.lit("catalogo_sintetico"), alt=c("alt"),
        alt_origin=F.lit("gerado"), has_alt=F.lit(True), group_key=c("norm"),
        split=F.lit(C.TRAIN), org=F.lit("docaudit"), sphere=F.lit("sintetico"),
        category=F.lit("fallback de classe rara"), license=F.lit("nao aplicavel"),
        filter_reason=c("pattern"), provisional_label=F.lit(C.INSUFFICIENT)).withColumns(
        {"place": F.lit(0)}).drop("place")


def known_groups(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("group_key"), T.normalize_alt(
        F.coalesce("alt", F.lit("")))).alias("group_key")).distinct()


def merge(existing: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Append new groups; the first of each wins and existing rows are untouched.

    Both sides of the anti-join hold one row per group, so no group weighs more than another.
    """
    firsts = first_per_group(new, "group_key", [order])
    fresh = firsts.join(known_groups(existing), "group_key", "left_anti")
    return existing.withColumn("appended", F.lit(False)).unionByName(
        fresh.withColumn("appended", F.lit(True)))


def is_insufficient() -> Column:
    return F.coalesce("label", "provisional_label") == C.INSUFFICIENT


def quota_state(rows: DataFrame, quota: int = C.QUOTA) -> DataFrame:
    have = F.count(F.when(is_insufficient(), 1))
    return rows.agg(have.alias("have"), F.greatest(F.lit(quota) - have, F.lit(0)).alias("missing"),
                    (have >= quota).alias("met"))


def fill_quota(existing: DataFrame, web: DataFrame, quota: int = C.QUOTA) -> DataFrame:
    """Synthetic rows for what the quota still lacks, of groups that nobody has yet."""
    spark = existing.sparkSession
    have = existing.agg(F.count(F.when(is_insufficient(), 1))).first()[0]
    missing = max(quota - have - web.limit(quota).count(), 0)
    taken = known_groups(existing).unionByName(known_groups(web)).distinct()
    rows = synthetic_rows(spark)
    # At most 50 candidates: the large side only answers which of their groups exist.
    exists = taken.join(F.broadcast(rows.select("group_key")), "group_key", "left_semi")
    order = {a: i for i, a in enumerate(_interleaved())}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("alt")]
    return rows.join(F.broadcast(exists), "group_key", "left_anti").orderBy(place).limit(
        missing).select(*ROW)


def _interleaved() -> list[str]:
    groups = [alts for _, alts in C.SYNTHETIC_ALTS]
    return [g[i] for i in range(max(map(len, groups))) for g in groups if i < len(g)]


def apply_reviews(rows: DataFrame, decisions: DataFrame, when: str, key: str = "ord") -> DataFrame:
    """decisions(key, label): reviewed rows take the human label, origin and date."""
    chosen = decisions.select(key, F.col("label").alias("__label"))
    joined = rows.join(chosen, key, "left")
    reviewed = F.col("__label").isNotNull()
    return joined.withColumns({
        "label": F.coalesce("__label", "label"),
        "label_origin": F.when(reviewed, "humano").otherwise(F.col("label_origin")),
        "reviewed_at": F.when(reviewed, F.lit(when)),
    }).drop("__label")


def registered_reviews(rows: DataFrame) -> DataFrame:
    """Every human decision in the file, of any session."""
    return rows.filter((F.col("label_origin") == "humano")
                       & F.col("provisional_label").isin(*C.LABELS)
                       & F.col("label").isin(*C.LABELS))


# ------------------------------------------------------------------- training input
def working_label(rows: DataFrame, kind: str = "humano") -> tuple[DataFrame, DataFrame]:
    """(samples, violations) for the label field of this kind; unlabelled rows are skipped."""
    field = {"humano": "label", "provisorio": "provisional_label"}.get(kind)
    if field is None:
        raise DatasetError(f"working label {kind!r} is neither humano nor provisorio")
    given = rows.filter(F.col(field).isNotNull())
    message = (
        F.when(~F.col(field).isin(*C.LABELS), F.format_string(
            f"linha %s: {field} '%s' fora do vocabulario", F.col("ord").cast("string"), field))
        .when(T.is_blank(F.col("alt")), F.format_string(
            "linha %s: rotulada como %s mas sem alt", F.col("ord").cast("string"), field))
        .when(~F.coalesce(F.col("split").isin(*C.SPLITS), F.lit(False)), F.format_string(
            "linha %s: divisao '%s' fora do vocabulario", F.col("ord").cast("string"), "split")))
    marked = given.withColumn("message", message)
    samples = marked.filter("message IS NULL").select(
        "ord", "id", F.col("alt").alias("text"), F.col(field).alias("y"), "group_key", "split",
        F.coalesce(F.col("data_origin") == "sintetico_fallback", F.lit(False)).alias("synthetic"))
    return samples, marked.filter("message IS NOT NULL").select("ord", "message")


def leaks(samples: DataFrame) -> DataFrame:
    """Groups that appear in two splits. Least and greatest split per group are enough."""
    return samples.groupBy("group_key").agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split")).filter(
        "first_split <> last_split")


def trainability(samples: DataFrame) -> DataFrame:
    """One row: counts per split and class, and the first gate that fails."""
    train = F.col("split") == C.TRAIN
    per_class = [F.count(F.when(train & (F.col("y") == y), 1)).alias(f"train_{y}")
                 for y in C.LABELS]
    counts = samples.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(train, 1)).alias("train"),
        F.count(F.when(~train, 1)).alias("evaluation"), *per_class)
    n = [F.col(f"train_{y}") for y in C.LABELS]
    classes = reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in n])
    scarce = reduce(lambda a, b: a | b, [(x > 0) & (x < C.TRAIN_MINIMUM_PER_CLASS) for x in n])
    gate = (F.when(F.col("total") == 0, "nenhuma amostra rotulada")
            .when(F.col("total") < C.TRAIN_MINIMUM, "amostras abaixo do minimo")
            .when(F.col("train") == 0, "nenhuma amostra no treino")
            .when(F.col("evaluation") == 0, "nenhuma amostra em validacao nem em teste")
            .when(classes < 2, "o treino tem uma classe so")
            .when(scarce, "classe abaixo do minimo no treino")
            .otherwise("treinavel"))
    return counts.withColumn("gate", gate)


def require_trainable(samples: DataFrame, violations: DataFrame) -> None:
    """Strict form: raise with the first violation, leak or gate."""
    bad = violations.orderBy("ord").limit(1).collect()
    if bad:
        raise DatasetError(bad[0]["message"])
    leak = leaks(samples).limit(1).collect()
    if leak:
        raise DatasetError(f"vazamento: o grupo {leak[0]['group_key']!r} aparece em "
                           f"{leak[0]['first_split']} e em {leak[0]['last_split']}")
    gate = trainability(samples).first()["gate"]
    if gate != "treinavel":
        raise DatasetError(gate)


# ---------------------------------------------------------------------- reports
def per_document_report(rows: DataFrame) -> DataFrame:
    has_alt = ~T.is_blank(F.col("alt"))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("images"), F.count(F.when(has_alt, 1)).alias("with_alt"),
        F.count(F.when(~has_alt, 1)).alias("without_alt"),
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))


def dataset_report(rows: DataFrame) -> DataFrame:
    """Totals, distinct alts, groups per split, and the sentence on volume."""
    per_group = rows.groupBy("group_key", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~T.is_blank(F.col("alt")), 1)).alias("a"))
    totals = per_group.agg(
        F.sum("n").alias("images"), F.sum("a").alias("images_with_alt"),
        F.count(F.when(F.col("a") > 0, 1)).alias("distinct_alts"),
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"groups_{s}") for s in C.SPLITS])
    n = F.col("distinct_alts")
    verdict = (F.when(n == 0, "SEM AMOSTRA: nenhuma imagem do corpus declara texto alternativo. "
                      "Nao ha o que rotular nem o que treinar a partir deste corpus.")
               .when(n < C.DATASET_MINIMUM, F.concat(
                   F.lit("INSUFICIENTE: "), n, F.lit(
                       f" alts distintos contra os {C.DATASET_MINIMUM} do ADR 0002.")))
               .otherwise(F.concat(F.lit("SUFICIENTE em volume: "), n, F.lit(" alts distintos."))))
    return totals.withColumn("verdict", verdict)


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column in one pass; a missing value counts as None."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value"))
        for c in columns])).alias("p")
    return rows.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
