"""Rule-built classifiers of alternative texts. Each is one CASE expression."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit import constants as C
from docaudit.functions import text as T


def alt_state(alt: Column) -> Column:
    return (F.when(alt.isNull(), C.ALT_MISSING)
            .when(T.is_blank(alt), C.ALT_EMPTY).otherwise(C.ALT_PRESENT))


_GENERIC = "(" + "|".join(C.GENERIC_ALT_TEXTS) + ")"


def alt_quality(alt: Column) -> Column:
    """Served heuristic: file names and noise, short generic words, length."""
    def judge(clean: Column) -> Column:
        n, lower = F.length(clean), F.lower(clean)
        return (F.when(clean.rlike(C.SERVED_FILE_NAME) | clean.rlike(C.NOISE_ONLY),
                       C.INSUFFICIENT)
                .when((n < 15) & lower.rlike(_GENERIC), C.INSUFFICIENT)
                .when(lower.rlike("^" + _GENERIC), C.WEAK)
                .when(n < 15, C.WEAK)
                .when(n >= 40, C.GOOD)
                .otherwise(C.WEAK))
    return T.let(T.trim_ws(F.coalesce(alt, F.lit(""))), judge)


def provisional_label(alt: Column, norm: Column | None = None) -> Column:
    """Pre-label of a cleaned text; other cuts than the served heuristic on purpose."""
    norm = T.normalize_alt(alt) if norm is None else norm
    blocked = F.array(*map(F.lit, C.BLOCKED_TERMS))

    def judge(row: Column) -> Column:
        text, words, n = row["alt"], row["words"], F.length(row["alt"])
        return (F.when(n < 10, C.INSUFFICIENT)
                .when((F.size(words) > 0) & (F.size(F.array_except(words, blocked)) == 0),
                      C.INSUFFICIENT)
                .when(row["norm"].isin(*C.BLOCKED_TERMS), C.INSUFFICIENT)
                .when((n <= 30) | T.repeats_word(text), C.WEAK)
                .when(~T.has_structure(text), C.WEAK)
                .otherwise(C.GOOD))
    return T.let(F.struct(alt.alias("alt"), norm.alias("norm"), T.tokens(norm).alias("words")),
                 judge)


def insufficient_reason(alt: Column) -> Column:
    """Why a web alt is insufficient, or NULL."""
    clean = T.trim_ws(alt)

    def judge(row: Column) -> Column:
        text = row["text"]
        return (F.when(text == "", F.lit(None).cast("string"))
                .when(text.rlike(C.WEB_HASH), "hash")
                .when(text.rlike(C.WEB_FILE_NAME), "nome_de_arquivo")
                .when(~text.rlike(C.HAS_LETTER), "sem_letra")
                .when(row["norm"].isin(*C.SOLO_TERMS), "termo_generico_solto")
                .when(F.length(text) < 6, "curto_demais"))
    return T.let(F.struct(clean.alias("text"), T.normalize_alt(clean).alias("norm")), judge)


def slice_of(source: Column, data_origin: Column, file: Column) -> Column:
    """Which slice a dataset row came from, by what it declares."""
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    return (F.when(is_(data_origin, "sintetico_fallback") | is_(source, "sintetico"),
                   "sintetico_fallback")
            .when(is_(source, "wikimedia-commons") | is_(data_origin, "wikimedia_commons"),
                  "wikimedia_commons")
            .when(is_(data_origin, "coletado"), "web_coletado")
            .when(source.isNull() & F.coalesce(file, F.lit("")).endswith(".docx"),
                  "governamental_docx")
            .otherwise("desconhecido"))


def served_confidence(used_heuristic: Column, confidence: Column) -> Column:
    """A rule has no probability: heuristic rows carry no confidence."""
    return F.when(~used_heuristic, confidence)
