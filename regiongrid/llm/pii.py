"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass validation (Luhn for cards, area rules for
social-security numbers, grouping for phone numbers, octets for IPv4 addresses, the
calendar for dates) are permuted within their format by a keyed Feistel network, so
one value gets one pseudonym in all documents, two values never share one, and the
pseudonym is again a valid value written in the same way. The valid values of each
format are numbered from 0 without gaps, and each count is the product of the two
sizes of the network's halves, so the network is a permutation of the format itself
and no value is walked back into it. The network's key function is HMAC-SHA-256.

E-mail addresses and long secrets have no numeric format; they get a keyed digest
(HMAC-SHA-256, 96 bits and more) in their shape.

A date with slashes is read as month/day/year if that is a date, else as
day/month/year; the two kinds are permuted apart, so strings stay different. Dates
run from 1900-01-01 to 2100-05-02 (day/month/year ones to early 2100). An address that
follows "v" or "version" is a version number and stays.

All of it is one map over the rows in DataFrame functions.

Defined results: null text stays null; a value that fails validation is left as
it is; everything outside matches is kept to the byte; other columns pass
through, whatever their names; an empty table gives an empty table; repeated rows
give equal rows. A very long text is one regular-expression search, and its pieces
are held beside it, some three times its bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# The shapes that are looked for, in the order of preference.
EMAIL = r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:sk|pk|ghp|gho|xoxb)[_\-][A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?<![vV])(?<![vV] )(?<!ersion )[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./\-][0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
SHAPES = {"email": EMAIL, "secret": SECRET, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
FIRST_DAY, DAYS = "1900-01-01", (271, 270)  # 73170 days, to 2100-05-02
LATE_DAYS = (211, 210)  # 44310 days after the 12th of their month, from 1900-01-13
ROUNDS = 8
#: Of the registered queries and the pipeline over the synthetic tables. It is public: pass your own.
DEMO_KEY = "regiongrid-demo-key"


def _mac(text: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal digits."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def feistel(value: Column, a: int, b: int, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a*b-1.

    The value is split in value div b and value mod b; each round adds a keyed
    function of one half to the other, modulo its size. ``kind`` parts formats.
    """

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, acc["r"]).otherwise(acc["l"])
        made = _mac(F.concat_ws("|", F.lit(kind), i.cast("string"), other.cast("string")), key)
        f = F.conv(F.substring(made, 1, 15), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, F.pmod(acc["l"] + f, _long(a))).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + f, _long(b))).alias("r"),
        )

    start = F.struct(F.floor(value / _long(b)).cast("bigint").alias("l"), F.pmod(value, _long(b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda acc: acc["l"] * b + acc["r"])


def _let(value: Column, made) -> Column:
    """``made`` of a value that is computed once."""
    return F.transform(F.array(value), made)[0]


def luhn_sum(digits: Column, doubled_at: int) -> Column:
    """Luhn sum of a digit string; places from the right that are ``doubled_at`` mod 2 double."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            F.pmod(n - i, F.lit(2)) == doubled_at,
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int")),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(shape)),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("j")),
        lambda acc, i: F.when(
            F.substr(shape, i, F.lit(1)).between("0", "9"),
            F.struct(F.concat(acc["s"], F.substr(digits, acc["j"], F.lit(1))).alias("s"), (acc["j"] + 1).alias("j")),
        ).otherwise(F.struct(F.concat(acc["s"], F.substr(shape, i, F.lit(1))).alias("s"), acc["j"].alias("j"))),
        lambda acc: acc["s"],
    )


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _card(m: Column, digits: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the new check digit."""

    def of(size: int) -> Column:
        right = size // 2
        fresh = feistel(F.substring(digits, 1, size).cast("bigint"), 10 ** (size - right), 10**right, f"card{size}", key)
        return F.lpad(fresh.cast("string"), size, "0")

    fresh = F.coalesce(*[F.when(F.length(digits) == size + 1, of(size)) for size in range(12, 19)])
    return _let(fresh, lambda x: _refill(m, F.concat(x, F.pmod(10 - luhn_sum(x, 0) % 10, F.lit(10)).cast("string"))))


def _phone(m: Column, digits: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code stays.

    Numbers with a possible area and exchange (200 to 999) map to such numbers,
    others to others.
    """
    ten = F.substr(digits, F.length(digits) - 9, F.lit(10)).cast("bigint")
    head = F.substr(digits, F.lit(1), F.length(digits) - 10)
    area, exchange, line = F.floor(ten / 10**7), F.pmod(F.floor(ten / 10**4), _long(1000)), F.pmod(ten, _long(10**4))
    # 800 areas of 800 exchanges of 10^4 lines
    possible = _let(
        feistel(((area - 200) * 800 + exchange - 200) * 10**4 + line, 80_000, 80_000, "phone", key),
        lambda v: (F.floor(v / (800 * 10**4)) + 200) * 10**7 + (F.pmod(F.floor(v / 10**4), _long(800)) + 200) * 10**4 + F.pmod(v, _long(10**4)),
    )
    # areas under 200 first, then 800 areas of 200 exchanges
    low, some = 200 * 10**7, 200 * 10**4
    other = _let(
        feistel(F.when(area < 200, ten).otherwise(low + (area - 200) * some + F.pmod(ten, _long(10**7))), 60_000, 60_000, "no phone", key),
        lambda v: F.when(v < low, v).otherwise((F.floor((v - low) / some) + 200) * 10**7 + F.pmod(v - low, _long(some))),
    )
    fresh = F.when((area >= 200) & (exchange >= 200), possible).otherwise(other).cast("bigint")
    return _refill(m, F.concat(head, F.lpad(fresh.cast("string"), 10, "0")))


def _ssn_valid(v: Column) -> Column:
    area = F.floor(v / 1_000_000)
    return (area >= 1) & (area != 666) & (area < 900) & (F.pmod(F.floor(v / 10_000), _long(100)) > 0) & (F.pmod(v, _long(10_000)) > 0)


def _ssn(m: Column, digits: Column, key: str) -> Column:
    """Of 898 areas, 99 groups and 9999 serial numbers."""
    v = digits.cast("bigint")
    area = F.floor(v / 10**6)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + F.pmod(F.floor(v / 10**4), _long(100)) - 1) * 9999 + F.pmod(v, _long(10**4)) - 1
    made = _let(
        _let(feistel(number, 898 * 99, 9999, "ssn", key), lambda x: F.struct(F.floor(x / (99 * 9999)).alias("a"), F.pmod(F.floor(x / 9999), _long(99)).alias("g"), F.pmod(x, _long(9999)).alias("s"))),
        lambda x: (x["a"] + F.when(x["a"] >= 665, 2).otherwise(1)) * 10**6 + (x["g"] + 1) * 10**4 + x["s"] + 1,
    )
    return F.when(_ssn_valid(v), _refill(m, F.lpad(made.cast("bigint").cast("string"), 9, "0")))


def _date(m: Column, form: str, key: str) -> Column:
    """The pseudonym of a date written as ``form``; null if it is none or out of range."""
    first = F.lit(FIRST_DAY).cast("date")
    index = F.datediff(F.try_to_date(m, form), first).cast("bigint")
    made = F.date_format(F.date_add(first, feistel(index, *DAYS, "date", key).cast("int")), form)
    return F.when((index >= 0) & (index < DAYS[0] * DAYS[1]), made)


def _late_date(m: Column, key: str) -> Column:
    """The same for dd/MM/yyyy with a day after the 12th, which cannot be MM/dd/yyyy.

    Such days are numbered by leaving out twelve a month.
    """
    first = F.lit(FIRST_DAY).cast("date")
    day = F.try_to_date(m, "dd/MM/yyyy")
    month = F.year(day) * 12 + F.month(day) - 1900 * 12 - 1
    index = (F.datediff(day, first) - 12 * (month + 1)).cast("bigint")

    def start(i: Column) -> Column:
        """Number of the 13th of a month."""
        return F.datediff(F.add_months(first, i), first) - 12 * i

    def written(v: Column) -> Column:
        guess = F.floor(v / F.lit(18.43685)).cast("int")  # a month has so many on average
        near = F.filter(F.sequence(guess - 2, guess + 2), lambda i: (start(i) <= v) & (v < start(i + 1)))
        return F.date_format(F.date_add(first, (v + 12 * (near[0] + 1)).cast("int")), "dd/MM/yyyy")

    return F.when((F.dayofmonth(day) > 12) & (index >= 0) & (index < LATE_DAYS[0] * LATE_DAYS[1]), _let(feistel(index, *LATE_DAYS, "late date", key), written))


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    number = F.aggregate(parts, _long(0), lambda acc, x: acc * 256 + x)
    text = _let(
        feistel(number, 65536, 65536, "ipv4", key),
        lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / _long(256**k)), _long(256)).cast("string") for k in (3, 2, 1, 0)]),
    )
    return F.when(F.forall(parts, lambda x: x <= 255), text)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or null if it is of no valid format."""
    digits = F.regexp_replace(m, "[^0-9]", "")

    def is_a(kind: str) -> Column:
        return m.rlike(f"^(?:{SHAPES[kind]})$")

    def digest(kind: str) -> Column:
        return _mac(F.concat(F.lit(f"{kind}|"), m), key)

    email = F.concat(F.lit("user."), F.substring(digest("email"), 1, 32), F.lit("@mail.invalid"))
    hexed = F.when(m.rlike("[a-z]"), digest("secret")).otherwise(F.upper(digest("secret")))
    hexed = F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.substr(hexed, F.lit(1), F.length(m))).otherwise(
        F.concat(F.substring(m, 1, 4), F.substr(hexed, F.lit(1), F.least(F.length(m) - 4, F.lit(64))))
    )
    return (
        F.when(m.contains("@"), email)
        .when(is_a("ipv4"), _ipv4(m, key))
        .when(is_a("date") & m.contains("/"), F.coalesce(_date(m, "MM/dd/yyyy", key), _late_date(m, key)))
        .when(is_a("date"), F.coalesce(*[F.when(m.contains(x), _date(m, f, key)) for x, f in (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"))]))
        .when(is_a("ssn"), _ssn(m, digits, key))
        .when(is_a("phone"), _phone(m, digits, key))
        .when(is_a("card") & (F.length(digits).between(13, 19)), F.when(luhn_sum(digits, 1) % 10 == 0, _card(m, digits, key)))
        .when(is_a("secret"), hexed)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """``docs`` with the text column rewritten, and ``counted`` (if named) the number of replaced values.

    Who holds ``key`` can link pseudonyms to values: keep it secret.
    """
    t = F.col(text)
    found, made = free_name(docs, "_found"), free_name(docs, "_made")
    work = docs.withColumn(found, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    fresh = F.when(F.size(found) > 0, F.transform(found, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))
    work = work.withColumn(made, fresh)
    parts = F.zip_with(F.split(t, ANY, -1), F.col(made), lambda p, r: F.concat(p, F.coalesce(r["p"], r["m"], F.lit(""))))
    some = F.size(made) > 0
    out = work.withColumn(text, F.when(some, F.array_join(parts, "")).otherwise(t))
    if counted:
        number = F.size(F.filter(made, lambda r: r["p"].isNotNull()))
        out = out.withColumn(counted, F.when(some, number).otherwise(F.lit(0)))
    return out.drop(found, made)
