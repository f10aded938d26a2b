"""Text functions on columns (string, hash, regex).

Built-in functions wherever they can say it. Spark has no function for Unicode decomposition
and entity decoding: texts that need them go to an Arrow batch, the others stay in the JVM.
"""
from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docaudit import constants as C

# Whitespace as Unicode text code strips it: White_Space plus the four separators.
_WS = r"\p{IsWhite_Space}\x1c-\x1f"
_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680,
                              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value that an expression reads several times, so it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Strip any Unicode whitespace at both ends (``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(_WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Each whitespace run becomes one space; no whitespace at the ends."""
    return F.trim(F.regexp_replace(c, f"[{_WS}]+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


# ------------------------------------------------------------------ accents
def _is_mark(char: str) -> bool:
    return unicodedata.category(char).startswith("M")


def _text_udf(fn):
    """A function on one text as an Arrow-batched column function."""
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")
    return F.pandas_udf(batch, StringType())


def _nfkd_fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text)
                   if not unicodedata.combining(c))


def _nfd_fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c))


def fold_accents(c: Column, form: str = "NFKD") -> Column:
    """Decompose and drop the marks. ASCII text never leaves the JVM."""
    exact = _text_udf({"NFKD": _nfkd_fold, "NFD": _nfd_fold}[form])
    return F.when(_is_ascii(c), c).otherwise(exact(F.when(~_is_ascii(c), c)))


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def normalize_alt(c: Column) -> Column:
    """Canonical form under which two alt texts are the same phrase."""
    return collapse_ws(F.lower(fold_accents(c)))


def group_key(alt: Column, document: Column, norm: Column | None = None) -> Column:
    """Same alt, same group; without alt the group is the document."""
    norm = normalize_alt(F.coalesce(alt, F.lit(""))) if norm is None else norm
    return F.when(norm != "", norm).otherwise(
        F.concat(F.lit(C.NO_ALT_PREFIX), document.cast("string")))


def bucket(key: Column) -> Column:
    """Stable 0-99 bucket from the last 8 hex digits of the key's sha256."""
    return (F.conv(F.right(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint") % 100).cast("int")


def split_of(key: Column) -> Column:
    b = bucket(key)
    return (F.when(b < C.TRAIN_BELOW, C.TRAIN)
            .when(b < C.VALIDATION_BELOW, C.VALIDATION).otherwise(C.TEST))


def normalize_link(c: Column) -> Column:
    """Link text without accents, case, end punctuation or repeated spaces."""
    bare = F.rtrim(F.lower(fold_accents(c, "NFD")), F.lit(_ASCII_PUNCTUATION))
    return trim_ws(F.regexp_replace(bare, r"\s+", " "))


@lru_cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Case folding of all code points: those that become one character, what they become, and the longer ones."""
    folded = {a: a.casefold() for a in map(chr, range(sys.maxunicode + 1)) if a != a.casefold()}
    single = {a: b for a, b in folded.items() if len(b) == 1}
    return "".join(single), "".join(single.values()), {a: b for a, b in folded.items() if len(b) > 1}


# Blocks in which case folding is lower case, one character for one, whatever the neighbours and the version of Unicode.
_LOWER_FOLDS = (r"^[\x00-\x{B4}\x{B6}-\x{DE}\x{E0}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{400}-\x{481}\x{2010}-\x{2027}"
                r"\x{202F}-\x{205E}\x{3000}-\x{9FFF}\x{AC00}-\x{D7A3}]*$")


def case_folded(c: Column) -> Column:
    """Full case folding. Most texts only need lower case; only those with a character that becomes several are taken apart."""
    ones, into, longer = _foldings()
    single = F.translate(c, ones, into)
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    # A surrogate pair is one match, so no character is cut.
    whole = F.array_join(F.transform(F.regexp_extract_all(single, F.lit("(?s)."), 0), lambda x: F.coalesce(
        F.try_element_at(table, x), x)), "")
    return (F.when(_is_ascii(c) | c.rlike(_LOWER_FOLDS), F.lower(c)).when(c.rlike(f"[{''.join(longer)}]"), whole).otherwise(single))


def normalize_audit(c: Column) -> Column:
    """Whitespace collapsed and case folded; accents stay."""
    return let(collapse_ws(c), case_folded)


def is_url(c: Column) -> Column:
    return F.lower(c).rlike(C.URL_START)


def ellipsis(c: Column, limit: int = 60) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.left(c, F.lit(limit - 3)), F.lit("...")))


def heading_summary(c: Column) -> Column:
    return let(trim_ws(F.coalesce(c, F.lit(""))), lambda clean: F.when(
        clean == "", "(sem texto)").otherwise(ellipsis(clean)))


# ------------------------------------------------------- cleaning of collected texts
def _clean(text: str, rounds: int, tag: str, control: str) -> str:
    """Entities decoded and tags cut, ``rounds`` times; composed; every gap one space.

    A gap is any run of control characters and white space, no-break spaces among it.
    """
    for _ in range(rounds):
        text = " ".join(re.split(tag, html.unescape(text)))
    return re.sub(f"(?:{control}|\\s)+", " ", unicodedata.normalize("NFC", text)).strip(" ")


# A text below U+0300 without entity or tag marks needs no decoding and is composed already.
_PLAIN_TEXT = r"^[^&<>\x{300}-\x{10FFFF}]*$"


def _cleaned(c: Column, rounds: int) -> Column:
    exact = _text_udf(partial(_clean, rounds=rounds, tag=C.TAG, control=C.CONTROL))
    plain = c.rlike(_PLAIN_TEXT)
    native = collapse_ws(F.regexp_replace(c, C.CONTROL, " "))
    return F.when(plain, native).otherwise(exact(F.when(~plain, c)))


def clean_web_text(c: Column) -> Column:
    """Entities once, tags out, NFC, one-line; NULL when nothing is left."""
    return F.nullif(_cleaned(c, 1), F.lit(""))


def clean_archive_text(c: Column) -> Column:
    """Entities and tags twice; NULL for junk, file names, and texts without a letter."""
    text = _cleaned(c, 2)
    edge = f"[{C.EDGE_QUOTES}]"
    text = trim_ws(F.regexp_replace(text, f"^{edge}+|{edge}+$", ""))

    def kept(t: Column) -> Column:
        junk = ((t == "") | F.lower(t).isin(*C.JUNK_LITERALS) | t.rlike(C.ARCHIVE_FILE_NAME)
                | t.rlike(C.ORPHAN_EXTENSION) | ~t.rlike(C.HAS_LETTER))
        return F.when(~junk, t)
    return let(text, kept)


# ------------------------------------------------------------------------- tokens
def tokens(c: Column) -> Column:
    return F.filter(F.split(c, C.NON_WORD + "+"), lambda t: t != "")


def has_structure(c: Column) -> Column:
    return let(tokens(c), lambda found: (F.size(found) >= 4) & F.exists(
        found, lambda t: (F.length(t) >= 4) & t.rlike(C.HAS_LETTER)))


def repeats_word(c: Column) -> Column:
    long = F.transform(F.filter(tokens(c), lambda t: F.length(t) > 3), F.lower)
    return let(long, lambda w: (F.size(w) >= 2) & (F.size(F.array_distinct(w)) < F.size(w)))


# --------------------------------------------------------------- package attributes
def outline_level(c: Column) -> Column:
    value = F.trim(c).try_cast("int")
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$") & value.between(0, 8), value + 1)


def style_level(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.nullif(F.regexp_extract(bare, C.STYLE_HEADING, 1), F.lit("")).cast("int")


def ooxml_on(c: Column) -> Column:
    return F.coalesce(~((c == "0") | F.lower(c).isin("false", "off")), F.lit(True))


def is_content_part(part: Column) -> Column:
    """Parts with visible content, chosen by exclusion; evaluated before any parsing."""
    base = F.substring(part, 6, 1 << 20)
    keep = part.startswith("word/") & part.endswith(".xml") & ~base.contains("/")
    keep &= ~base.isin(*C.CONFIG_PARTS)
    for prefix in C.COMMENT_PARTS_WITHOUT_TEXT:
        keep &= ~base.startswith(prefix)
    return keep


# ------------------------------------------------------------------ criteria, guards
def principle_of(criterion: Column) -> Column:
    branch = None
    for digit, name, _ in C.PRINCIPLES:
        test = F.left(criterion, F.lit(1)) == digit
        branch = F.when(test, name) if branch is None else branch.when(test, name)
    return branch.otherwise(F.raise_error(F.concat(
        F.lit("criterio '"), F.coalesce(criterion, F.lit("null")),
        F.lit("' nao comeca com um principio WCAG (1 a 4)"))))


def cited_criteria(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(C.CRITERION), F.lit(1))


def sanitize(c: Column) -> Column:
    """Untrusted text as one bounded line without role markers."""
    text = F.regexp_replace(c, C.CONTROL_RUN, " ")
    for marker in C.ROLE_MARKERS:
        text = F.regexp_replace(text, marker, C.REMOVED)
    text = trim_ws(F.regexp_replace(text, r"\s{2,}", " "))
    kept = C.SANITIZE_LIMIT - len(C.SANITIZE_CUT)
    cut = let(text, lambda t: F.when(F.length(t) > C.SANITIZE_LIMIT, F.concat(
        F.left(t, F.lit(kept)), F.lit(C.SANITIZE_CUT))).otherwise(t))
    return F.when(is_blank(c), "").otherwise(cut)


def envelope(label: Column | str, text: Column, nonce: Column | None = None) -> Column:
    """Text between markers that its author cannot guess. ``nonce`` is fixed in tests."""
    label = F.lit(label) if isinstance(label, str) else label
    nonce = F.left(F.sha2(F.uuid(), 256), F.lit(16)) if nonce is None else nonce
    return F.concat(F.lit("<<"), label, F.lit(":"), nonce, F.lit(">>\n"), text,
                    F.lit("\n<</"), label, F.lit(":"), nonce, F.lit(">>"))


# ------------------------------------------------------------------------ small ones
def url_host(url: Column) -> Column:
    """Authority part of a URL."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def length_band(alt: Column) -> Column:
    n = F.length(alt)
    return F.when(n <= 10, "<=10").when(n <= 30, "11-30").otherwise(">30")


def kappa_band(kappa: Column) -> Column:
    return (F.when(kappa < 0.0, "pior que o acaso").when(kappa < 0.20, "insignificante")
            .when(kappa < 0.40, "fraca").when(kappa < 0.60, "moderada")
            .when(kappa < 0.80, "substancial").otherwise("quase perfeita"))


def truncate_error(c: Column, limit: int = 500) -> Column:
    return F.left(c, F.lit(limit))


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def synthetic_id(alt: Column) -> Column:
    return F.concat(F.lit("sintetico:"), F.left(F.sha2(alt, 256), F.lit(12)))


def instant_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
