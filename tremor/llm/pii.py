"""Personal data replaced by format-preserving pseudonyms, in DataFrame expressions only.

One pattern finds candidates; a candidate that its format's rules accept (Luhn digits, IBAN remainder,
calendar, number ranges) is replaced, others stay as they are. Numbers and dates go through a keyed
alternating Feistel network over Z_M x Z_N: ten rounds a += F(b) mod M, b += F(a) mod N with F taken
from SHA-256 of key, kind, round and half, a permutation of the format's own values, whose results are
valid again (check digits are set anew; values outside the range are permuted once more). Equal values
get equal pseudonyms in all documents and whatever their punctuation. Mail addresses, which have no
fixed-size format, and credentials get keyed digests in their own alphabet.

Defined results. A null text stays null, an empty one empty. A text without candidates is unchanged
to the byte. All other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms that are looked for, the more special first.
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
SECRET = r"\b(?i:password|passwd|pwd|token|secret|api_key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,128}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)"
FORMS = {"email": EMAIL, "iban": IBAN, "access_key": ACCESS_KEY, "secret": SECRET, "ip": IP, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
#: The first and last day that dates are permuted within.
FIRST_DAY, DAYS = "1900-01-01", 73049
ROUNDS = 10


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint"))


def feistel(a: Column, b: Column, m: Column, n: Column, kind: str, key: str) -> Column:
    """struct(a, b): a permutation of Z_m x Z_n chosen by key and kind."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, acc["b"]).otherwise(acc["a"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m.cast("string"), n.cast("string"), i.cast("string"), other.cast("string")).cast("binary"), 256)
        f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, (acc["a"] + f % m) % m).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + f % n) % n).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """Another digit string of the same length, 2 to 36 digits."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    m, n = (F.pow(F.lit(10.0), h).cast("bigint") for h in (half, size - half))
    mixed = feistel(_number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1)), m, n, kind, key)
    return _let(mixed, lambda x: F.concat(F.lpad(x["a"].cast("string"), half, F.lit("0")), F.lpad(x["b"].cast("string"), size - half, F.lit("0"))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one, by those of digits."""
    places = F.sequence(F.lit(1), F.length(form))
    char = lambda i: F.substr(form, i, F.lit(1))
    return F.array_join(F.transform(places, lambda i: F.when(char(i).between("0", "9"), F.substr(digits, _count(F.substr(form, F.lit(1), i), r"[^0-9]"), F.lit(1))).otherwise(char(i))), "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The sum of Luhn's rule; double_last: the last digit is doubled, as before a missing check digit."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    turn = lambda i: (F.length(digits) - i) % 2 == (0 if double_last else 1)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(turn(i), (value(i) * 2) % 10 + F.floor(value(i) / 5).cast("int")).otherwise(value(i)))


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), "card", key))
        full = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))
        valid = (luhn_sum(d, False) % 10 == 0) & (d != F.repeat(F.substr(d, F.lit(1), F.lit(1)), F.length(d)))
        return F.when(valid, _refill(m, full)).otherwise(m)

    return _let(_digits(m), of)


def remainder_97(text: Column) -> Column:
    """The number that an IBAN's letters and digits spell, modulo 97."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        valid = (remainder_97(F.concat(rest, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1) & (_count(rest, r"[^0-9]") >= 4) & (F.length(plain) >= 15)
        changed = _let(_refill(rest, permuted_digits(_digits(rest), "iban", key)), lambda r: F.concat(F.lpad((98 - remainder_97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0"), _digits(r)))
        return F.when(valid, _refill(m, changed)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), of)


def _ip(m: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        number = F.transform(parts, lambda p: p.cast("bigint"))
        mixed = feistel(number[0] * 256 + number[1], number[2] * 256 + number[3], F.lit(65536), F.lit(65536), "ip", key)
        shown = _let(mixed, lambda x: F.concat_ws(".", *((F.floor(x[h] / 256).cast("string"), (x[h] % 256).cast("string"))[k] for h in ("a", "b") for k in (0, 1))))
        return F.when(F.forall(number, lambda x: x <= 255), shown).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _day(date: Column, key: str) -> Column:
    """A permuted day of the range; null outside it."""
    first = F.lit(FIRST_DAY).cast("date")
    index = F.datediff(date, first).cast("bigint")
    once = lambda i: _let(feistel(F.floor(i / 270), i % 270, F.lit(271), F.lit(270), "date", key), lambda x: x["a"] * 270 + x["b"])
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), once(index), lambda acc, _: F.when(acc < DAYS, acc).otherwise(once(acc)))
    return F.when((index >= 0) & (index < DAYS), F.date_add(first, walked.cast("int")))


def _iso_date(m: Column, key: str) -> Column:
    return F.coalesce(F.date_format(_day(F.try_to_date(m, "yyyy-MM-dd"), key), "yyyy-MM-dd"), m)


def _day_date(m: Column, key: str) -> Column:
    """Day first where that is a date, else month first; single digits come back as two where needed."""
    sign = F.when(F.contains(m, F.lit("/")), "/").otherwise(".")
    plain = F.regexp_replace(m, r"\.", "/")
    day, month = F.try_to_date(plain, "d/M/yyyy"), F.try_to_date(plain, "M/d/yyyy")
    wide = F.length(m) == 10
    pattern = lambda own, long, short: F.when(wide, F.date_format(own, long)).otherwise(F.date_format(own, short))
    shown = F.coalesce(pattern(_day(day, key), "dd/MM/yyyy", "d/M/yyyy"), pattern(_day(month, key), "MM/dd/yyyy", "M/d/yyyy"))
    return F.coalesce(F.replace(shown, F.lit("/"), sign), m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > 666).cast("int")  # 666 is never given
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)

    def shown(x: Column) -> Column:
        at = F.floor(x["a"] / 99)
        number = at + 1 + (at >= 665).cast("int")
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in ((number, 3), (x["a"] % 99 + 1, 2), (x["b"] + 1, 4))))

    return F.when(valid, _let(feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key), shown)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The digits behind the country code. Ten digits of the North American plan stay within it; so the same
    number has the same pseudonym with and without +1."""
    code = F.regexp_extract(m, r"^\+(\d{1,3}?)(?=[ .(-])", 1)
    prefix = F.when(F.startswith(m, F.lit("+")), F.length(code) + 1).otherwise(F.lit(0))
    rest = F.substr(m, prefix + 1)

    def of(d: Column) -> Column:
        area, exchange = (F.substring(d, a, 3).cast("bigint") - 200 for a in (1, 4))
        american = (F.length(d) == 10) & code.isin("", "1") & (area >= 0) & (exchange >= 0)
        mixed = _let(feistel(area * 800 + exchange, F.substring(d, 7, 4).cast("bigint"), F.lit(640_000), F.lit(10_000), "phone", key), lambda x: F.concat((F.floor(x["a"] / 800) + 200).cast("string"), (x["a"] % 800 + 200).cast("string"), F.lpad(x["b"].cast("string"), 4, "0")))
        changed = F.when(american, mixed).otherwise(permuted_digits(d, "phone", key))
        return F.when(F.length(d) >= 6, F.concat(F.substr(m, F.lit(1), prefix), _refill(rest, changed))).otherwise(m)

    return _let(_digits(rest), of)


def _keyed(value: Column, kind: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value).cast("binary"), 256)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_keyed(F.lower(m), "email", key), 1, 16), F.lit("@mail.invalid"))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(_keyed(m, "access_key", key), 1, 16)))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\w+\s?[=:]\s?[\"']?)", 1)
    value = F.substr(m, F.length(head) + 1)
    return F.concat(head, F.substr(F.concat(_keyed(value, "secret", key), _keyed(value, "secret more", key)), F.lit(1), F.length(value)))


_RULES = {"email": _email, "iban": _iban, "access_key": _access_key, "secret": _secret, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "ssn": _ssn, "phone": _phone, "card": _card}


def pattern() -> str:
    """All forms in one pattern; the group of the day date is counted within it."""
    return "|".join(f"(?:{p})" for p in FORMS.values())


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself."""
    out = match
    for kind, form in reversed(FORMS.items()):
        bare = form.replace(r"\b", "")
        out = F.when(F.rlike(match, F.lit(f"^(?:{bare})$")), _RULES[kind](match, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: str) -> Column:
    """The text with all personal data replaced."""
    found = F.regexp_extract_all(text, F.lit(pattern()), F.lit(0))
    changed = F.transform(found, lambda m: pseudonym(m, key))
    between = F.split(text, pattern(), -1)
    joined = F.array_join(F.zip_with(between, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.rlike(text, F.lit(r"[0-9@]|(?i:password|passwd|pwd|token|secret|api_key)\s?[=:]")), joined).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text column pseudonymised; who knows the key can undo the permutations, so it is to be kept secret."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return docs.withColumn(text_col, pseudonymised(F.col(f"`{text_col}`").cast("string"), key))
