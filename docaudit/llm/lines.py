"""Quality rules, line first: rules per line, removal of failing lines, then the document.

1. Every line with a word is held against three rules: *punctuation* (runs of symbols or of
   exclamation marks on a third of its words), *navigation* (four or more short pieces between
   separators) and *boilerplate* (fixed phrases of page furniture, a line that repeats an earlier one,
   a line that says the same few words over and over).
2. Failing lines are removed.
3. A document is rejected when its own counts fail (too few words, too many repeated windows) or
   when more than ``max_loss`` of its words went with the lines.

All of it is array functions inside one row: no shuffle, no Python, no group of any size.

Null texts count as empty; a text without a word has zero counts and fails. Repeated rows each
get their own result, an empty table gives an empty one, other columns stay as they are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import BLANK, BLANK_RUN, NOT_BLANK, fresh, once, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of the words that may go with removed lines.
MAX_LOSS = 0.5
#: Characters the contract counts as symbols.
SYMBOL = r"[#*$%&|<>]"
#: A run of symbols or exclamation marks that ends or stands for a word.
NOISE_RUN = r"[#*$%&<>~^]{2,}|!{2,}"
SEPARATOR = r" [|»•·>] "
#: Page furniture.
BOILERPLATE = (r"(?i)\b(all rights reserved|cookie(s)? (policy|settings|to improve)|we use cookies|enable javascript|"
               r"privacy policy|terms of (use|service)|click here|read more|sign up for|subscribe to our|"
               r"share (this|on)|back to top|skip to (main )?content|powered by)\b")


def words_of(text: Column) -> Column:
    """Words of a text that starts and ends with one; of an empty text one empty word."""
    return F.split(text, BLANK_RUN)


def _repeated_words(pairs: str) -> Column:
    """Words covered by windows whose hash occurs again; ``pairs`` are (hash, position), sorted."""
    at = F.col(pairs)
    again = F.filter(at, lambda p, i: p["k"].eqNullSafe(F.get(at, i - 1)["k"]) | p["k"].eqNullSafe(F.get(at, i + 1)["k"]))
    places = F.sort_array(F.transform(again, lambda p: p["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def _line_fails(line: Column) -> Column:
    """The reason why a line goes, null if it stays. Repeats of earlier lines are found outside."""
    words = F.split(line, BLANK_RUN)
    n = F.size(words)
    noise = F.regexp_count(line, F.lit(NOISE_RUN))
    pieces = F.size(F.split(line, SEPARATOR))
    return (F.when((noise >= 2) & (noise * 3 >= n), "punctuation")
            .when((pieces >= 4) & (n <= 4 * pieces), "navigation")
            .when(line.rlike(BOILERPLATE), "boilerplate")
            .when((n >= 10) & (F.size(F.array_distinct(words)) * 4 < n), "boilerplate"))


def line_first(docs: DataFrame, text: str = "text", out: str = "quality", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with one struct column more, named ``out`` (made unique if the table has it).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_lines_removed, words_removed, kept, cleaned (the text without its failing lines).
    """
    t, w, k, p, lines, judged = (fresh(docs, f"__{c}") for c in ("t", "w", "k", "p", "lines", "judged"))
    n = F.when(F.col(t) == "", 0).otherwise(F.size(w)).cast("long")
    step = docs.withColumn(t, F.btrim(text_of(text), F.lit(BLANK)))
    step = step.withColumn(w, words_of(F.col(t)))
    step = step.withColumn(k, F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(WINDOW)]))))
    step = step.withColumn(p, F.when(F.size(F.array_distinct(k)) < F.size(k), F.array_sort(
        F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))))
    # lines with a word, each with its place among all lines
    step = step.withColumn(lines, F.split(text_of(text), "\n"))
    step = step.withColumn(judged, F.transform(lines, lambda x, i: F.struct(
        x.alias("line"), x.rlike(NOT_BLANK).alias("has"), i.alias("i"))))
    full = F.filter(judged, lambda x: x["has"])
    # the first place of a line: array_position finds it; equal later lines are boilerplate
    step = step.withColumn(judged, F.transform(full, lambda x: F.struct(
        x["line"].alias("line"),
        F.coalesce(_line_fails(F.btrim(x["line"], F.lit(BLANK))), F.when(
            F.array_position(F.col(lines), x["line"]) <= x["i"], "boilerplate")).alias("why"),
        F.size(F.split(F.btrim(x["line"], F.lit(BLANK)), BLANK_RUN)).cast("long").alias("n"))))
    gone = F.filter(judged, lambda x: x["why"].isNotNull())
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    repeat = F.when(F.col(p).isNull(), F.lit(0).cast("long")).otherwise(_repeated_words(p))
    dup = (F.size(judged) - F.size(F.array_distinct(F.transform(judged, lambda x: x["line"])))).cast("long")
    counts = F.struct(
        n.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"), repeat.alias("n_repeat_words"), removed.alias("words_removed"),
        F.size(judged).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_lines_removed"))
    c = fresh(docs, "__counts")
    step = step.withColumn(c, counts)
    failed = (F.col(c)["n_words"] < MIN_WORDS) | (100 * F.col(c)["n_repeat_words"] > MAX_REPEAT_PERCENT * F.col(c)["n_words"])
    stay = F.filter(judged, lambda x: x["why"].isNull())
    result = F.struct(*[F.col(c)[f].alias(f) for f in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"),
        F.col(c)["n_lines"].alias("n_lines"), F.col(c)["n_lines_removed"].alias("n_lines_removed"),
        F.col(c)["words_removed"].alias("words_removed"),
        (~failed & (F.col(c)["words_removed"] <= max_loss * F.col(c)["n_words"])).alias("kept"),
        F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("cleaned"))
    return step.select(*[docs[x] for x in docs.columns], once(result).alias(fresh(docs, out)))
