"""Agreement and quality metrics, each from one aggregation over the label pairs."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import text as T
from docaudit.operators.ordered import over_ordered


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def agreement(pairs: DataFrame, a: str, b: str, labels: Sequence[str] = C.LABELS) -> DataFrame:
    """One row: total, divergences, marginals, observed and expected agreement, kappa."""
    sums = [_count(F.col(a) == F.col(b)).alias("agreements"), F.count(F.lit(1)).alias("total")]
    sums += [_count(F.col(c) == y).alias(f"{c}_{y}") for c in (a, b) for y in labels]
    counts = pairs.agg(*sums)
    n = F.col("total").cast("double")
    po = F.when(n > 0, F.col("agreements") / n)
    pe = F.when(n > 0, _add([(F.col(f"{a}_{y}") / n) * (F.col(f"{b}_{y}") / n) for y in labels]))
    rows = counts.withColumns({"po": po, "pe": pe})
    kappa = (F.when(F.col("pe") >= 1.0, F.when(F.col("po") >= 1.0, 1.0).otherwise(0.0))
             .otherwise((F.col("po") - F.col("pe")) / (1.0 - F.col("pe"))))
    return rows.withColumn("kappa", kappa)


def require_pairs(row) -> float:
    """Kappa of no sample is an error, not a number."""
    if not row["total"]:
        raise ValueError("nao da para calcular kappa sem nenhuma amostra.")
    return row["kappa"]


def confusion(pairs: DataFrame, truth: str, predicted: str,
              labels: Sequence[str] = C.LABELS) -> DataFrame:
    """Every (truth, predicted) cell in label order, zero where nothing fell."""
    cells = [(t, p) for t in labels for p in labels]
    counts = pairs.agg(*[_count((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"c{i}")
                         for i, (t, p) in enumerate(cells)])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"c{i}").alias("n"))
        for i, (t, p) in enumerate(cells)])))


def class_report(pairs: DataFrame, truth: str, predicted: str,
                 labels: Sequence[str] = C.LABELS) -> DataFrame:
    """Precision, recall, F1 and support per label; a division by zero is zero."""
    t, p = F.col(truth), F.col(predicted)
    counts = pairs.agg(*[x for y in labels for x in (
        _count((t == y) & (p == y)).alias(f"tp_{y}"), _count(p == y).alias(f"predicted_{y}"),
        _count(t == y).alias(f"support_{y}"))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))  # noqa: E731,E501
    rows = counts.select(F.inline(F.array(*[F.struct(
        F.lit(y).alias("label"), F.col(f"tp_{y}").alias("tp"),
        F.col(f"predicted_{y}").alias("predicted"), F.col(f"support_{y}").alias("support"))
        for y in labels])))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")),
                             "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.withColumn("f1", f1).drop("tp", "predicted")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted means of a class report of a few rows."""
    weight = F.col("support") / F.nullif(F.sum("support").over(_all()), F.lit(0))
    weighted = report.withColumn("w", F.coalesce(weight, F.lit(0.0)))
    names = ("precision", "recall", "f1")
    return weighted.agg(*[F.avg(n).alias(f"macro_{n}") for n in names],
                        *[F.sum(F.col(n) * F.col("w")).alias(f"weighted_{n}") for n in names])


def _all():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))


def minority_class(report: DataFrame, minimum: int = C.MINORITY_SUPPORT) -> DataFrame:
    """The class with least support, then least name, and whether its recall means anything."""
    row = report.agg(F.min_by(F.struct("label", "recall", "precision", "f1", "support"),
                              F.struct("support", "label")).alias("r")).select("r.*")
    reason = F.when(F.col("support") < minimum, F.format_string(
        "%s amostra(s) de %s no conjunto avaliado, abaixo do minimo de %s",
        F.col("support").cast("string"), "label", F.lit(str(minimum))))
    return row.withColumns({"evaluable": F.col("support") >= minimum, "reason": reason})


def verdict(scores: DataFrame, model: str, majority: str, heuristic: str) -> DataFrame:
    """Says in one sentence whether a model is better than both baselines."""
    m, j, h = F.col(model), F.col(majority), F.col(heuristic)
    best = F.greatest(j, h)
    name = F.when(h >= j, "heuristica").otherwise("classe majoritaria")
    three = lambda x: F.format_string("%.3f", x)
    sentence = (
        F.when(m <= j, F.concat(
            F.lit("MODELO INUTIL: macro-F1 "), three(m),
            F.lit(" nao supera a classe majoritaria ("), three(j),
            F.lit("). Ele nao aprendeu nada.")))
        .when(m <= h, F.concat(
            F.lit("MODELO NAO SE JUSTIFICA: macro-F1 "), three(m), F.lit(" contra "), three(h),
            F.lit(" da heuristica. Se algumas regras alcancam o modelo, use as regras.")))
        .otherwise(F.concat(
            F.lit("MODELO SUPERA OS BASELINES: macro-F1 "), three(m), F.lit(" contra "),
            three(best), F.lit(" da "), name, F.lit(" (+"), three(m - best), F.lit(")."))))
    return scores.withColumns({"best_baseline": name, "gain": m - best,
                               "beats_baselines": (m - best) > 0, "sentence": sentence})


def fold_summary(folds: DataFrame, by: str, value: str) -> DataFrame:
    return folds.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def nearest_ranks(df: DataFrame, by: str, value: str, order: str,
                  fractions: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean, nearest-rank percentiles and maximum per group, exactly.

    The rank comes from the ordered pass, so a group of any size is split into blocks.
    """
    ranked = over_ordered(df.select(by, value, order), [by], [value, order], F.col(value),
                          number="rn")
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    joined = ranked.join(n, by)
    index = lambda f: F.least(F.col("n") - 1, F.floor(F.lit(f) * F.col("n"))) + 1
    picks = [F.max(F.when(F.col("rn") == index(f), F.col(value))).alias(f"p{int(f * 100)}")
             for f in fractions]
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 3).alias("mean"), *picks,
        F.max(value).alias("maximum"))


# --------------------------------------------------------------------- human review
def pending(rows: DataFrame) -> DataFrame:
    """Pre-labelled rows with an alt that nobody has reviewed."""
    return rows.filter(F.col("provisional_label").isin(*C.LABELS) & F.col("label").isNull()
                       & ~T.is_blank(F.col("alt")))


def review_queue(available: DataFrame, per_class: int = C.REVIEW_PER_CLASS,
                 seed: int = 42) -> DataFrame:
    """``per_class`` rows of each pre-label, in an order that a seed fixes.

    Hash order stands for the shuffle; each task keeps its first rows per label, so the full
    classes never meet in one place. The queue itself has at most 3 x per_class rows.
    """
    from docaudit.operators.ordered import top_per_group
    if per_class < 1:
        raise ValueError("per_class precisa ser pelo menos 1.")
    mark = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), "id"), 256)  # noqa: E731,E501
    chosen = top_per_group(available.withColumn("h", mark("classe")), ["provisional_label"],
                           ["h", "id"], per_class)
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m", "id"))
    return chosen.withColumn("m", mark("mistura")).withColumn(
        "place", place.cast("bigint")).drop("h", "m", "rn")


def missing_per_class(available: DataFrame, per_class: int = C.REVIEW_PER_CLASS) -> DataFrame:
    counts = available.agg(*[_count(F.col("provisional_label") == y).alias(y) for y in C.LABELS])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(y).alias("label"), F.greatest(F.lit(per_class) - F.col(y), F.lit(0)).alias(
            "missing")) for y in C.LABELS])))


def review_report(decisions: DataFrame) -> DataFrame:
    """Totals, correction rate, kappa, and which of four sentences holds."""
    a = agreement(decisions, "provisional_label", "label")
    total, kappa = F.col("total"), F.col("kappa")
    meets = (total >= C.REVIEW_MINIMUM) & (kappa >= C.KAPPA_MINIMUM)
    three = F.format_string("%.3f", kappa)
    sentence = (
        F.when(total == 0, "SEM REVISAO: nenhuma amostra foi rotulada por humano.")
        .when(total < C.REVIEW_MINIMUM, F.concat(
            F.lit("INCOMPLETO: "), total, F.lit(f" amostras revisadas contra as "
                                                f"{C.REVIEW_MINIMUM}. O kappa de "), three,
            F.lit(" e indicativo.")))
        .when(~meets, F.concat(F.lit("NAO ATENDE: kappa "), three,
                               F.lit(f" abaixo de {C.KAPPA_MINIMUM:.2f}.")))
        .otherwise(F.concat(F.lit("ATENDE: "), total, F.lit(" amostras revisadas, kappa "), three,
                            F.lit(" ("), T.kappa_band(kappa), F.lit(")."))))
    sides = [F.col(f"{c}_{y}") for c in ("provisional_label", "label") for y in C.LABELS]
    return a.select(
        "total", (total - F.col("agreements")).alias("divergences"),
        F.when(total > 0, (total - F.col("agreements")) / total).otherwise(0.0).alias(
            "correction_rate"), F.coalesce(kappa, F.lit(0.0)).alias("kappa"),
        F.when(total > 0, T.kappa_band(kappa)).otherwise("sem amostra").alias("band"),
        *sides, F.coalesce(meets, F.lit(False)).alias("meets"), sentence.alias("verdict"))
