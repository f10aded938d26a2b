"""Personal numbers and dates become pseudonyms of the same format.

Candidates are found by pattern and then validated: payment cards by length and Luhn digit, IBANs (of digits) by their
remainder modulo 97, social security numbers and phone numbers by their parts, IPv4 addresses and dates by
their ranges; e-mail addresses by form. Where digit groups stand side by side (a card and its code, a number and
a date), a candidate that fails is tried again in parts: from each group on the longest run of groups that is valid.
What fails stays as it is. A valid value is put through a keyed
Feistel network on exactly its own format: the halves of its digits are mixed in turn with a keyed hash of
the other half, and a check digit is computed anew, so a card number becomes another valid card number with
the same separators, a date another date of the same calendar and layout. The network is a permutation:
equal values get equal pseudonyms in all documents, different values different ones.

Everything is DataFrame functions within one row: texts are cut at the candidates, each candidate is
replaced, the pieces are joined again. Null texts stay null and count no finds. Repeated rows and null
ids each get their own result; other columns stay as they are; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, once, text_of

ROUNDS = 8
WALK = 64
#: Days from 1900-01-01 to 2099-12-31: dates are permuted among them.
FIRST_DAY, DAYS = "1900-01-01", 73049
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}"
#: Digit groups side by side, which may hold more than a card.
CARD = r"[0-9](?:[ -]?[0-9]){12,198}"
#: Digit groups and separators of the longest value that is looked for in parts of a candidate.
MAX_PARTS = 37
#: Kinds in the order in which they are tried at one place.
KINDS = (("email", EMAIL), ("iban", IBAN), ("date", DATE), ("ipv4", IPV4), ("ssn", SSN), ("phone", PHONE), ("card", CARD))
CANDIDATE = r"(?<![A-Za-z0-9])(?:" + "|".join(p for _, p in KINDS) + (
    r")(?:(?![A-Za-z0-9])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2})(?=T[0-9]{2}))")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _mask(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    """The keyed hash of one half in a round, 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string"), F.lit(key)), 256)


def _mask_number(mask: Column) -> Column:
    return F.conv(F.substring(mask, 1, 15), 16, 10).cast("bigint")


def permute(digits: Column, key: str, tweak: Column) -> Column:
    """Another string of as many digits (at most 36): a Feistel network on its two halves."""
    def network(value: Column) -> Column:
        left = F.floor(F.length(value) / 2).cast("int")
        right = F.length(value) - left
        power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
        part = lambda at, n: F.coalesce(F.substr(value, at, n).try_cast("bigint"), F.lit(0).cast("bigint"))
        start = F.struct(part(F.lit(1), left).alias("a"), part(left + 1, right).alias("b"))

        def turn(s: Column, i: Column) -> Column:
            """Even rounds change the left half, odd ones the right."""
            even = i % 2 == 0
            return F.struct(
                F.when(even, F.pmod(s["a"] + _mask_number(_mask(key, tweak, i, s["b"])), power(left))).otherwise(s["a"]).alias("a"),
                F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _mask_number(_mask(key, tweak, i, s["a"])), power(right))).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(
            F.when(left > 0, F.lpad(s["a"].cast("string"), left, "0")).otherwise(""), F.lpad(s["b"].cast("string"), right, "0")))
    return _let(digits, lambda v: F.when(F.length(v) == 0, "").otherwise(network(v)))


def permute_below(n: Column, size: int, key: str, tweak: str) -> Column:
    """Another number below ``size``: a network on the smallest square grid that holds it, walked until it
    is below again. Under one number in 180 of the grids used here is too large, so a walk of more than
    WALK turns does not occur in practice; it would end at the number itself."""
    side = int(size ** 0.5) + (int(size ** 0.5) ** 2 < size)

    def network(value: Column) -> Column:
        start = F.struct(F.floor(value / side).cast("bigint").alias("a"), (value % side).cast("bigint").alias("b"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start,
            lambda s, i: F.struct(s["b"].alias("a"), F.pmod(
                s["a"] + _mask_number(_mask(key, F.lit(tweak), i, s["b"])), F.lit(side)).cast("bigint").alias("b")),
            lambda s: s["a"] * side + s["b"])
    return _let(n.cast("bigint"), lambda v: F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), network(v), lambda x, _: F.when(x < size, x).otherwise(network(x)),
        lambda x: F.when(x < size, x).otherwise(v)))


def permute_letters(value: Column, key: str, tweak: Column) -> Column:
    """Another string with letters, capitals and digits at the same places; other characters stay.

    Each half in turn is shifted, character by character within its class, by the hash of the other."""
    def shift(half: Column, mask: Column) -> Column:
        def one(i: Column) -> Column:
            code = F.ascii(F.substr(half, i, F.lit(1)))
            step = F.conv(F.substr(mask, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
            moved = lambda low, n: F.char(low + (code - low + step) % n)
            return F.when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).when(
                code.between(48, 57), moved(48, 10)).otherwise(F.substr(half, i, F.lit(1)))
        return F.when(F.length(half) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    def network(v: Column) -> Column:
        left = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), left).alias("a"), F.substr(v, left + 1).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, i: F.when(
            i % 2 == 0, F.struct(_let(_mask(key, tweak, i, s["b"]), lambda m: shift(s["a"], m)).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), _let(_mask(key, tweak, i, s["a"]), lambda m: shift(s["b"], m)).alias("b"))),
            lambda s: F.concat(s["a"], s["b"]))
    return _let(value, network)


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits with every second one, from the right, doubled."""
    def total(v: Column) -> Column:
        digit = lambda i: F.substr(v, i, F.lit(1)).cast("int")
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), lambda n, i: n + F.when(
            (F.length(v) - i) % 2 == 0, digit(i)).otherwise(twice(digit(i))))
    return _let(digits, total)


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda r, d: F.when(d == "", r).otherwise((r * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97))


def _iban_number(body: Column, country: Column, check: Column) -> Column:
    """Body, country and check digits as the number whose remainder counts."""
    letter = lambda i: (F.ascii(F.substring(country, i, 1)) - 55).cast("string")
    return F.concat(body, letter(1), letter(2), check)


def _fill(shape: Column, digits: Column) -> Column:
    """The digits of a shape replaced in turn, everything else as it stands."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(shape, ""), start, lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
        F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _is(value: Column, pattern: str) -> Column:
    return value.rlike("^(?:" + pattern + ")$")


def _date_of(value: Column) -> Column:
    """The day, null if there is none or it is out of range."""
    iso = F.when(value.substr(5, 1) == "-", value).otherwise(
        F.concat(F.substring(value, 7, 4), F.lit("-"), F.when(value.substr(3, 1) == "/", F.substring(value, 1, 2)).otherwise(F.substring(value, 4, 2)),
                 F.lit("-"), F.when(value.substr(3, 1) == "/", F.substring(value, 4, 2)).otherwise(F.substring(value, 1, 2))))
    day = iso.try_cast("date")
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAYS), n)


def kind_of(value: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    digits = _digits(value)
    parts = F.split(value, r"\.")
    iban = F.regexp_replace(value, " ", "")
    valid = {
        "email": F.lit(True),
        "iban": _mod97(_iban_number(F.substr(iban, F.lit(5)), F.substring(iban, 1, 2), F.substring(iban, 3, 2))) == 1,
        "date": _date_of(value).isNotNull(),
        "ipv4": F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255),
        "ssn": ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$"),
        "phone": F.length(digits).between(8, 15),
        "card": F.length(digits).between(13, 19) & (_luhn(digits) % 10 == 0) & ~digits.rlike("^0+$"),
    }
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        out = F.when(_is(value, pattern), F.when(valid[kind], kind)).otherwise(out)
    return out


def parts_of(value: Column) -> Column:
    """(v, kind) of the parts of a candidate, whose texts together are the candidate: itself if it is valid, else
    from each group on the longest run that is. A card within more digits begins with 2 to 6, as payment cards do."""
    item = lambda v, kind: F.struct(v.alias("v"), kind.alias("kind"))
    none = F.lit(None).cast("string")

    def inner(v: Column) -> Column:
        return _let(kind_of(v), lambda k: F.when(~((k == "card") & ~v.rlike("^[2-6]")), k))

    def walk(parts: Column) -> Column:
        n = F.size(parts)
        text = lambda i, j: F.array_join(F.slice(parts, i, j - i + 1), "")

        def longest(i: Column) -> Column:
            """The longest valid run from here, else the part alone."""
            tried = F.transform(F.sequence(F.least(n, i + MAX_PARTS - 1), i, F.lit(-1)), lambda j: F.struct(
                j.alias("j"), item(text(i, j), inner(text(i, j))).alias("x")))
            return F.coalesce(F.get(F.filter(tried, lambda t: t["x"]["kind"].isNotNull()), 0),
                              F.struct(i.alias("j"), item(text(i, i), none).alias("x")))
        start = F.struct(F.array().cast("array<struct<v:string,kind:string>>").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, i: F.when(i < s["at"], s).otherwise(_let(
            longest(i), lambda t: F.struct(F.concat(s["out"], F.array(t["x"])).alias("out"), (t["j"] + 1).alias("at")))),
            lambda s: s["out"])
    grouped = value.rlike("^[A-Z0-9]+(?:[ -][A-Z0-9]+)+$")
    return _let(kind_of(value), lambda kind: F.when(kind.isNull() & grouped, _let(
        F.regexp_extract_all(value, F.lit("[A-Z0-9]+|[ -]"), F.lit(0)), walk)).otherwise(F.array(item(value, kind))))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of the kind."""
    digits = _digits(value)
    tweak = lambda name, *more: F.concat(F.lit(name), *more)
    check = lambda body: F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = _let(permute(F.substr(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card")),
                lambda body: _fill(value, F.concat(body, check(body))))
    # all digits of an IBAN but the two that check it: at most 30, whose halves fit a long
    flat = F.regexp_replace(value, " ", "")
    country = F.substring(flat, 1, 2)
    fixed = lambda new: F.lpad((98 - _mod97(_iban_number(new, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _let(permute(F.substr(flat, F.lit(5)), key, tweak("iban", country)),
                lambda new: _fill(value, F.concat(fixed(new), new)))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_below(_date_of(value), DAYS, key, "date").cast("int"))
    date = F.when(value.substr(5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).when(
        value.substr(3, 1) == "/", F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))
    ipv4 = _let(permute_below(number, 1 << 32, key, "ipv4"), lambda n: F.concat_ws(".", *[
        F.shiftrightunsigned(n, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)]))
    # country and area of a phone number stay; its last seven digits are permuted with them as tweak
    area = F.substr(digits, F.lit(1), F.length(digits) - 7)
    phone = _fill(value, F.concat(area, permute(F.substr(digits, F.length(digits) - 6), key, tweak("phone", area))))
    # area 001-665 and 667-899, group 01-99, serial 0001-9999, counted from zero
    block, group, serial = (F.substring(digits, a, n).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
    block = block - F.when(block > 666, 2).otherwise(1)
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    ssn = _let(permute_below((block * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn"), lambda n: F.concat_ws(
        "-", _let(F.floor(n / (99 * 9999)), lambda b: pad(b + F.when(b >= 665, 2).otherwise(1), 3)),
        pad(F.floor(n / 9999) % 99 + 1, 2), pad(n % 9999 + 1, 4)))
    domain = F.substring_index(value, "@", -1)
    email = F.concat(permute_letters(F.substring_index(value, "@", 1), key, tweak("email", F.lower(domain))), F.lit("@"), domain)
    return (F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "date", date).when(kind == "email", email)
            .when(kind == "ipv4", ipv4).when(kind == "phone", phone).when(kind == "ssn", ssn))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with one struct column more, named ``out`` (made unique if the table has it): the text
    with pseudonyms, and how many values of each kind it had."""
    found, judged, new = fresh(docs, "__found"), fresh(docs, "__judged"), fresh(docs, "__new")
    step = docs.withColumn(found, F.regexp_extract_all(text_of(text), F.lit(CANDIDATE), F.lit(0)))
    step = step.withColumn(judged, F.transform(found, parts_of))
    step = step.withColumn(new, F.transform(judged, lambda parts: F.array_join(F.transform(parts, lambda x: F.when(
        x["kind"].isNull(), x["v"]).otherwise(pseudonym(x["v"], x["kind"], key))), "")))
    gaps = F.split(F.col(text), CANDIDATE, -1)
    whole = F.when(F.size(found) == 0, F.col(text)).otherwise(F.array_join(F.zip_with(
        gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), ""))
    count = lambda kind: F.size(F.filter(F.flatten(judged), lambda x: x["kind"] == kind)).cast("long").alias("n_" + kind)
    result = F.struct(whole.alias("text"), *[count(kind) for kind, _ in KINDS])
    return step.select(*[docs[c] for c in docs.columns], once(result).alias(fresh(docs, out)))
