"""Format-preserving pseudonyms for personal data (operator 4), with DataFrame functions only.

One pattern finds candidates; each is validated (calendar dates, IPv4 octets, Luhn and IBAN check
digits, telephone shapes) and then permuted by a keyed Feistel network within its format, after
Luby & Rackoff and NIST SP 800-38G in outline.  Equal values map to equal pseudonyms in every
document, different ones to different ones, and the key's holder can invert the permutation.

* Numbers: two halves of digits; each round adds a keyed digest of one half to the other.  Card
  numbers permute all but the check digit, which is then set again; so they stay valid.  Digit runs
  that fail the check stay as they are.  Telephone numbers keep their country code.
* Social security numbers are permuted until the result is one that may exist (a cycle walk, which
  is again a permutation).
* Dates: the day number within a range of 270 x 270 days from 1900-01-01; the result is a date in
  the same notation, and dates beyond it stay.  A date with slashes is read day first; one that is no
  date that way is read month first and permuted, by a cycle walk, among those.  So no two dates of
  the range share a pseudonym.
* Addresses: the 32 bits of an IPv4 address.
* E-mail addresses, IBANs and credentials: characters move within their class (digit, lower, upper),
  with everything else in place.  An IBAN keeps its country and gets new check digits.

Digests are SHA-256 of the key, the kind and length, the round and the half.  The key is a scalar
subquery, so no plan, event log or user interface shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import documents

ROUNDS = 8
DAYS_SIDE = 270  # dates from 1900-01-01 to 2099-08-03
EPOCH = "1900-01-01"
#: Steps of a cycle walk, of which each ends it with probability 0.6 or more: none is left after so many but once in 10^25.
WALK = 64
#: Texts without any of these hold nothing that the long pattern finds.
HINT = "[0-9@]|password=|token"

# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"

# One pattern, its branches in order of precedence.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",  # e-mail
        r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",  # IPv4
        r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",  # date, year first
        r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])",  # date, year last
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",  # social security number
        r"(?<![0-9A-Za-z+])\+?[0-9]{0,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])",  # telephone, with parentheses
        r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",  # telephone, international
        r"(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])",  # telephone, national
        r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])",  # card number
        r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",  # IBAN
        r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",  # access key
        r"(?<=password=|token=|token = \")[0-9a-zA-Z]{12,}",  # credential
    ]
)


def _digest(key: Column, *parts: Column) -> Column:
    """A keyed, non-negative number below 2^56."""
    text = F.concat_ws("|", key, *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: Column, inverse: bool = False) -> Column:
    """The permuted pair (l, r) of numbers below ``a`` and ``b``; rounds change the two in turn."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        base = F.when(even, a).otherwise(b).cast("long")
        other, own = F.when(even, s["r"]).otherwise(s["l"]), F.when(even, s["l"]).otherwise(s["r"])
        shift = _digest(key, kind, i, other) % base
        new = F.pmod(own - shift if inverse else own + shift, base)
        return F.struct(F.when(even, new).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new).alias("r"))

    return F.aggregate(rounds, start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: Column, kind: Column, inverse: bool = False) -> Column:
    """Digits permuted among strings of digits of their length (two digits or more)."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), h), F.substring(digits, h + 1, n)
    out = feistel(left, right, _power(h), _power(n - h), key, F.concat(kind, n.cast("string")), inverse)
    both = F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), h, "0"), F.lpad(s["r"].cast("string"), (n - h).cast("int"), "0")))
    return both[0]


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum, where digits at odd (1) or even (0) places from the right, counted from 0, are doubled."""
    n = F.length(digits)
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == doubled_from_right
        return s + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def permute_card(digits: Column, key: Column, inverse: bool = False) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    out = F.transform(F.array(permute_digits(body, key, F.lit("card"), inverse)), lambda x: F.concat(x, F.pmod(-luhn_sum(x, 0), F.lit(10)).cast("string")))
    return out[0]


def _walk(start: Column, step, ends) -> Column:
    """``step`` applied to ``start`` until ``ends`` holds, once at least."""
    first = F.transform(F.array(start), step)[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(ends(s), s).otherwise(step(s)))


def permute_ssn(digits: Column, key: Column, inverse: bool = False) -> Column:
    """Nine digits permuted among the social security numbers that may exist."""
    return _walk(digits, lambda d: permute_digits(d, key, F.lit("ssn"), inverse), lambda d: ~d.rlike("^(?:000|666|9|...00|.....0000)"))


def permute_date(day: Column, key: Column, inverse: bool = False) -> Column:
    """A date permuted among the dates of the range."""
    n = F.datediff(day, F.to_date(F.lit(EPOCH)))
    side = F.lit(DAYS_SIDE)
    out = feistel(F.floor(n / DAYS_SIDE), n % DAYS_SIDE, side, side, key, F.lit("date"), inverse)
    moved = F.transform(F.array(out), lambda s: F.date_add(F.to_date(F.lit(EPOCH)), (s["l"] * DAYS_SIDE + s["r"]).cast("int")))
    return moved[0]


def permute_late_date(day: Column, key: Column, inverse: bool = False) -> Column:
    """A date after the twelfth of its month permuted among those."""
    return _walk(day, lambda d: permute_date(d, key, inverse), lambda d: F.dayofmonth(d) > 12)


def _in_range(day: Column) -> Column:
    n = F.datediff(day, F.to_date(F.lit(EPOCH)))
    return (n >= 0) & (n < DAYS_SIDE * DAYS_SIDE)


def permute_ip(text: Column, key: Column, inverse: bool = False) -> Column:
    part = lambda k: F.element_at(F.split(text, r"\."), k + 1).cast("long")
    side = F.lit(65536)
    out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), side, side, key, F.lit("ip"), inverse)
    spell = lambda s: F.concat_ws(".", *(F.floor(s[c] / d) % 256 if d > 1 else s[c] % 256 for c in "lr" for d in (256, 1)))
    return F.transform(F.array(out), lambda s: spell(s).cast("string"))[0]


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_text(text: Column, key: Column, kind: Column, inverse: bool = False) -> Column:
    """Characters of the three classes permuted within them: a Feistel network over the two halves of the text."""
    n = F.length(text)
    h = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), h).alias("l"), F.substring(text, h + 1, n).alias("r"))

    def move(own: Column, seed: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substring(own, i, F.lit(1))
            # Sixteen digits of the digest of a block of characters serve eight characters, two each.
            block = F.sha2(F.concat_ws("|", seed, F.floor((i - 1) / 32).cast("string")), 256)
            shift = F.conv(F.substring(block, (F.pmod(i - 1, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in _CLASSES:
                at = F.instr(F.lit(letters), c)
                to = F.pmod(at - 1 - shift if inverse else at - 1 + shift, F.lit(len(letters))) + 1
                out = F.when(at > 0, F.substring(F.lit(letters), to.cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(own) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), one), "")).otherwise(own)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        seed = lambda other: F.concat_ws("|", key, kind, n.cast("string"), i.cast("string"), other)
        return F.struct(F.when(even, move(s["l"], seed(s["r"]))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(move(s["r"], seed(s["l"]))).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    out = F.aggregate(rounds, start, step)
    return F.transform(F.array(out), lambda s: F.concat(s["l"], s["r"]))[0]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _respell(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced, in order."""
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    out = F.aggregate(
        chars, F.struct(F.lit("").alias("t"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.substring(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k"))),
    )
    return F.transform(F.array(out), lambda s: s["t"])[0]


def _mod97(plain: Column) -> Column:
    """The remainder by 97 of digits and capitals, where A to Z count as 10 to 35."""
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _iban_ok(match: Column) -> Column:
    plain = F.regexp_replace(match, " ", "")
    return (F.length(plain) >= 15) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def permute_iban(match: Column, key: Column, inverse: bool = False) -> Column:
    country = F.substring(match, 1, 2)
    body = permute_text(F.substring(match, F.lit(5), F.length(match)), key, F.concat(F.lit("iban"), country), inverse)

    def checked(new: Column) -> Column:
        rest = _mod97(F.concat(F.regexp_replace(new, " ", ""), country, F.lit("00")))
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), new)

    return F.transform(F.array(body), checked)[0]


def permute_phone(match: Column, key: Column, inverse: bool = False) -> Column:
    """The digits after the country code permuted among as many; the code is told by its digits, however the number is spelled."""
    d = _digits(match)
    size = F.when(~match.startswith("+"), 0).when(d.rlike("^[17]"), 1).when(d.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3)
    code = F.substring(d, F.lit(1), size)
    return _respell(match, F.concat(code, permute_digits(F.substring(d, size + 1, F.length(d)), key, F.concat(F.lit("phone"), code), inverse)))


def kind_of(m: Column) -> Column:
    """The validated kind of a match; null if it is nothing of the sort."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    year_first, year_last = F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy")
    american = F.try_to_date(m, "MM/dd/yyyy")
    n = F.length(_digits(m))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(_in_range(year_first), "date_ymd"))
        .when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.when(_in_range(year_last), "date_dmy").when(year_last.isNull() & _in_range(american), "date_mdy"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$") | m.rlike(r"[+(]"), F.when((n >= 8) & (n <= 16), "phone"))
        .when(m.rlike("^[0-9][0-9 -]*$") & (n >= 13), F.when(F.pmod(luhn_sum(_digits(m), 1), F.lit(10)) == 0, "card"))
        .when(m.rlike("^AKIA[0-9A-Z]{16}$"), "secret")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$") & m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_iban_ok(m), "iban"))
        .when(m.rlike("^[0-9a-zA-Z]{12,}$"), "secret")
    )


def pseudonym(m: Column, kind: Column, key: Column, inverse: bool = False) -> Column:
    """The match permuted within its format."""
    d = _digits(m)
    user, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    moved = lambda pattern, permute=permute_date: F.date_format(permute(F.try_to_date(m, pattern), key, inverse), pattern)
    return (
        F.when(kind == "email", F.concat(permute_text(user, key, F.lit("email"), inverse), F.lit("@"), host))
        .when(kind == "ip", permute_ip(m, key, inverse))
        .when(kind == "date_ymd", moved("yyyy-MM-dd"))
        .when(kind == "date_dmy", moved("dd/MM/yyyy"))
        .when(kind == "date_mdy", moved("MM/dd/yyyy", permute_late_date))
        .when(kind == "card", _respell(m, permute_card(d, key, inverse)))
        .when(kind == "ssn", _respell(m, permute_ssn(d, key, inverse)))
        .when(kind == "phone", permute_phone(m, key, inverse))
        .when(kind == "iban", permute_iban(m, key, inverse))
        .when(kind == "secret", permute_text(m, key, F.lit("secret"), inverse))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``(doc_id, text, kinds, n_found)`` for every row: the text with each validated value replaced.

    Null text stays null, with nothing found.  No row depends on another, so repeated rows, empty
    tables and texts of any length need nothing special; there is no shuffle.  E-mail addresses have
    a local part of 64 characters and 127 host labels at most; what is longer is left alone or cut there.
    """
    # Without rows in the plan: a table of one row, whose value is read when the query runs.
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    secret = F.col("secret")
    own = documents(docs).withColumn("secret", held).withColumn("found", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    own = own.withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    pieces = F.when(F.col("found").isNotNull(), F.split("text", PATTERN, -1))
    own = own.withColumn("marked", F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    own = own.withColumn("new", F.transform("marked", lambda x: F.when(x["kind"].isNotNull(), pseudonym(x["m"], x["kind"], secret)).otherwise(x["m"])))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat("new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    kinds = F.sort_array(F.filter(F.transform(F.coalesce("marked", F.array().cast("array<struct<m:string,kind:string>>")), lambda x: x["kind"]), lambda k: k.isNotNull()))
    return own.select("doc_id", F.when(F.col("found").isNotNull(), joined).otherwise(F.col("text")).alias("text"), kinds.alias("kinds"), F.size(kinds).cast("long").alias("n_found"))
