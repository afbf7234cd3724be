"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates, a check validates each (Luhn digit, calendar, ranges), and a
keyed Feistel network permutes it within its own format, so that a value gets the same
pseudonym in every document and the pseudonym is again valid of its kind:

* card numbers keep their length, separators and first digit; the Luhn digit is made anew;
* North American phone numbers keep their layout, prefix and the first digits of area and
  exchange, and get one pseudonym in every layout, with or without ``+1``; other ``+`` numbers, with
  or without separators, keep their layout and first two digits;
* social security numbers run over the valid areas, groups and serials;
* dates (2024-01-31, 2024/01/31, 31.01.2024, 01/31/2024) run over the 270 * 270 days from
  1900-03-01 to 2099-10-05, each in its layout; other dates stay;
* IPv4 addresses run over all addresses;
* local parts of mail addresses and keys, tokens and passwords, of any length, keep what is a digit,
  a lower and an upper letter and all else; mail domains and the words that announce a secret stay.

Halves of a number are added to modulo their own ranges in turn, so ranges need not be powers
of two and nothing is walked in cycles. The round function is SHA-256 over key, kind, round and
the other half. The default key is for tests: pass a secret one.

Defined results: null text stays null, with zero counts; rows that repeat a doc_id are documents of
their own; candidates that fail their check stay as they are; other columns, of any name, are passed on
by ``pseudonymise``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import fresh

ROUNDS = 8
KINDS = ("email", "secret", "ip", "date", "ssn", "phone", "card")

# fixed values: layouts of the values looked for
_PARTS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api_key|apikey) ?[=:] ?\"?[A-Za-z0-9_+/-]{8,}+",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+])\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z]|[.-][0-9])",
}
PATTERN = "|".join(_PARTS[k] for k in KINDS)


def let(x: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _round(key: Column, kind: Column, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, kind, r.cast("string"), half, key), 256)


def _numbers(key: Column, kind: Column, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (n_left, n_right)."""

    def f(r: Column, x: Column, n: Column) -> Column:
        return F.pmod(F.conv(F.substring(_round(key, kind, r, x.cast("string")), 1, 15), 16, 10).cast("long"), n)

    def turn(a: Column, r: Column) -> Column:
        odd = r % 2 == 1
        low = F.when(odd, F.pmod(a["l"] + f(r, a["r"], n_left), n_left)).otherwise(a["l"])
        high = F.when(odd, a["r"]).otherwise(F.pmod(a["r"] + f(r, a["l"], n_right), n_right))
        return F.struct(low.alias("l"), high.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _digits(key: Column, kind: Column, digits: Column) -> Column:
    """A keyed permutation of the strings of 2 to 18 digits, each length for itself."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    pad = lambda x, k: F.lpad(x.cast("string"), 9, "0").substr(10 - k, k)
    out = _numbers(key, kind, digits.substr(F.lit(1), a), digits.substr(a + 1, n - a), _power(a), _power(n - a))
    return let(out, lambda o: F.concat(pad(o["l"], a), pad(o["r"], n - a)))


def _letters(key: Column, kind: Column, text: Column) -> Column:
    """A keyed permutation of strings that keeps each character's class, place by place: one alphabet for all texts."""
    n = F.length(text)
    a = F.floor(n / 2).cast("int")

    def shift(half: Column, r: Column, other: Column) -> Column:
        """Every character moved within its class by two hexadecimal digits; a digest serves 32 characters."""
        digests = F.transform(F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 32).cast("int")), lambda j: F.sha2(F.concat_ws("|", key, kind, r.cast("string"), other, key, j.cast("string")), 256))

        def one(c: Column, i: Column, x: Column) -> Column:
            by = F.conv(x.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            low, high, digit = c.rlike("[a-z]"), c.rlike("[A-Z]"), c.rlike("[0-9]")
            base = F.when(low, 97).when(high, 65).otherwise(48)
            return F.when(low | high | digit, F.char(base + (F.ascii(c) - base + by) % F.when(digit, 10).otherwise(26))).otherwise(c)

        made = let(F.array_join(digests, ""), lambda x: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, x)), ""))
        return F.when(F.length(half) == 0, half).otherwise(made)

    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        left = F.when(odd, shift(s["l"], r, s["r"])).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(shift(s["r"], r, s["l"]))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(text.substr(F.lit(1), a).alias("l"), text.substr(a + 1, n - a).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return let(out, lambda o: F.concat(o["l"], o["r"]))


def luhn_digit(body: Column) -> Column:
    """The check digit behind ``body``."""

    def add(s: Column, x: Column) -> Column:
        d = body.substr(F.length(body) - x, F.lit(1)).cast("int")
        e = F.when(x % 2 == 0, d * 2).otherwise(d)
        return s + F.when(e > 9, e - 9).otherwise(e)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _put(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order."""

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(a["s"], F.when(digit, digits.substr(a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def _full(kind: str) -> str:
    return "^(?:" + _PARTS[kind] + ")$"


def _octet(m: Column, k: int) -> Column:
    return F.split(m, r"\.")[k].cast("int")


#: layouts of dates, each with a pattern of its own
_DATES = {"yyyy-MM-dd": r"^[0-9]{4}-", "yyyy/MM/dd": r"^[0-9]{4}/", "dd.MM.yyyy": r"^[0-9]{2}\.", "MM/dd/yyyy": r"^[0-9]{2}/"}


def _day(m: Column) -> Column:
    """Days since 1900-03-01 of a valid date in the window, else null."""
    when = reduce(lambda w, x: w.when(m.rlike(x[1]), F.try_to_timestamp(m, F.lit(x[0])).cast("date")), _DATES.items(), F.when(F.lit(False), F.lit(None).cast("date")))
    day = F.date_diff(when, F.lit("1900-03-01").cast("date"))
    return F.when(day.between(0, 270 * 270 - 1), day)


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes its check, else null."""
    digits = _only_digits(m)
    ssn = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    phone = let(digits, lambda d: _north(m, d) | (m.startswith("+") & ~d.rlike("^1[0-9]{10}$")))
    check = let(digits, lambda d: let(d.substr(F.lit(1), F.length(d) - 1), luhn_digit) == d.substr(F.length(d), F.lit(1)))
    card = F.length(digits).between(13, 19) & check & ~digits.rlike("^0+$")
    return (
        F.when(m.contains("@") & m.rlike(_full("email")), "email")
        .when(m.rlike("^(?:AKIA|(?i:password|passwd|token|secret|api))"), "secret")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.greatest(*[_octet(m, k) for k in range(4)]) <= 255, "ip"))
        .when(m.rlike(_full("date")), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(ssn, "ssn"))
        .when(m.rlike(_full("phone")), F.when(phone, "phone"))
        .when(card, "card")
    )


def _ssn(m: Column, digits: Column, kind: Column, key: Column) -> Column:
    """898 areas (001-899 without 666), each with 99 groups of 9999 serials."""
    area = digits.substr(1, 3).cast("int")
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (digits.substr(4, 2).cast("int") - 1) * 9999 + digits.substr(6, 4).cast("int") - 1
    made = _numbers(key, kind, area, rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))
    new = lambda x: F.when(x["l"] >= 665, x["l"] + 2).otherwise(x["l"] + 1)
    return let(made, lambda x: F.format_string("%03d-%02d-%04d", new(x), F.floor(x["r"] / 9999) + 1, x["r"] % 9999 + 1))


def _north(m: Column, digits: Column) -> Column:
    """A number of the North American plan: ten digits, or eleven behind the country code."""
    return digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") & (~m.startswith("+") | (F.length(digits) == 11))


def _phone(m: Column, digits: Column, kind: Column, key: Column) -> Column:
    n = F.length(digits)
    ten = digits.substr(n - 9, F.lit(10))
    eight = _digits(key, kind, F.concat(ten.substr(2, 2), ten.substr(5, 6)))
    north = let(eight, lambda e: F.concat(digits.substr(F.lit(1), n - 10), ten.substr(1, 1), e.substr(1, 2), ten.substr(4, 1), e.substr(3, 6)))
    world = F.concat(digits.substr(1, 2), _digits(key, kind, digits.substr(F.lit(3), n - 2)))
    return let(F.when(_north(m, digits), north).otherwise(world), lambda d: _put(m, d))


def _card(m: Column, digits: Column, kind: Column, key: Column) -> Column:
    n = F.length(digits)
    body = F.concat(digits.substr(1, 1), _digits(key, kind, digits.substr(F.lit(2), n - 2)))
    return let(let(body, lambda b: F.concat(b, luhn_digit(b))), lambda d: _put(m, d))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a validated value."""
    email = F.concat(_letters(key, kind, F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))
    head = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(m, r'^([A-Za-z_]+ ?[=:] ?"?)', 1))
    secret = let(head, lambda h: F.concat(h, _letters(key, kind, m.substr(F.length(h) + 1, F.length(m)))))
    two = F.lit(65536).cast("long")
    ip = _numbers(key, kind, _octet(m, 0) * 256 + _octet(m, 1), _octet(m, 2) * 256 + _octet(m, 3), two, two)
    ip = let(ip, lambda x: F.concat_ws(".", *[y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))
    side = F.lit(270).cast("long")
    day = let(_day(m), lambda x: _numbers(key, kind, F.floor(x / 270), x % 270, side, side))
    day = let(day, lambda x: F.date_add(F.lit("1900-03-01").cast("date"), (x["l"] * 270 + x["r"]).cast("int")))
    date = let(day, lambda x: reduce(lambda w, y: w.when(m.rlike(y[1]), F.date_format(x, y[0])), _DATES.items(), F.when(F.lit(False), m)))
    digits = _only_digits(m)
    of = lambda f: let(digits, lambda d: f(m, d, kind, key))
    ssn, phone, card = of(_ssn), of(_phone), of(_card)
    made = {"email": email, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    return reduce(lambda w, k: w.when(kind == k, made[k]), KINDS, F.when(F.lit(False), m)).otherwise(m)


def pseudonymise(docs: DataFrame, key: str = "test key") -> DataFrame:
    """The documents with pseudonyms in ``text`` and, behind their columns, the counts n_<kind> (with ``_`` behind a name that a column has)."""
    some = F.col("text").rlike("[0-9@]|AKIA|(?i:password|passwd|token|secret|api_?key)")
    none = F.array().cast("array<string>")
    secret, values, known = F.lit(key), fresh(docs, "values"), fresh(docs, "kinds")
    found = F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(none)
    kinds = F.transform(values, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = docs.withColumn(values, F.coalesce(found, none)).withColumn(known, kinds)
    made = F.transform(known, lambda x: pseudonym(x["m"], x["kind"], secret))
    pieces = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    text = F.when(F.size(values) > 0, joined).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter(known, lambda x: F.coalesce(x["kind"] == k, F.lit(False)))).cast("long")
    own = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return rows.select(*own, *[count(k).alias(fresh(docs, f"n_{k}")) for k in KINDS])


def private_digest(docs: DataFrame, key: str = "test key") -> DataFrame:
    """doc_id, n_<kind> for every kind, n_private and text."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [f"n_{k}" for k in KINDS]
    return out.select("doc_id", *counts, reduce(lambda a, b: a + b, map(F.col, counts)).alias("n_private"), "text")
