"""Format-preserving pseudonyms for personal data (DataFrame operations only).

Values are found by pattern and validated (Luhn for cards, mod 97 for IBANs, ranges for addresses and
numbers, the calendar for dates). A validated value is replaced by a keyed permutation of itself within
its own format, a Feistel network over SHA-256: the same value gives the same pseudonym in every
document and run under one key, different values of a kind give different ones, and a pseudonym is as
valid as the value was. What isn't valid is left alone.

* card: all digits but the last are permuted and the check digit is computed anew; separators stay. In a run of
  groups of digits that isn't a number as a whole, the longest valid numbers made of whole groups are.
* phone: the ten national digits, area and exchange codes within those that begin with 2 to 9 if the number's do;
  a country code +1, brackets and separators stay. Other international numbers: the digits after the
  country code, taken as one digit for 1 and 7, else as two.
* ssn: area and the rest are permuted among the valid ones (898 x 989901).
* iban: letters and digits after the check digits, each within its class; check digits anew. Groups behind that
  make the whole invalid are left off.
* ip: IPv4 addresses, as two halves of 16 bits.
* email: the local part, each letter and digit within its class; the domain stays.
* date: days from 1900-01-01 to 2099-12-31, 73049 = 17 x 4297 of them, in the date's own notation:
  2001-12-31, 31.12.2001, 12/31/2001; 31/12/2001 only if the first number is over 12. The permutation walks its
  cycle until the day is on the same side of 12, so a day has one pseudonym in all notations, and
  pseudonyms with slashes are read the way they were written.

Not found, and left in clear: IPv6 addresses; dates as 2001/12/31 or with the month's name; cards whose groups are parted by dots;
ten-digit phones parted by blanks only, without brackets or a country code; addresses at domains with letters beyond ASCII, or whose local
part is longer than 64 characters, the most that mail allows. Secrets are another operator's (``secret_scan``).

The key comes from the caller; ``configured_key`` reads it from the session (``KEY_CONF``). Without one the
published ``TEST_KEY`` is used, with a warning: whoever knows the key can undo numbers, so it does for tests only.

Scale: column expressions only, one scan and no shuffle; documents without a digit or @ are passed by.
Patterns repeat groups a bounded number of times, so hostile texts cost time in proportion to their length.

Defined cases: null text stays null, empty text stays empty; repeated rows and other columns stay. The count of
replaced values takes the place of an input column of its name; without a name there is none. Ties: of
values that begin at one place the first kind of ``PATTERNS`` wins.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.llm.common import table, unused

KEY_CONF, TEST_KEY = "spark.foliomatch.pii.key", "published key of the synthetic test tables"
ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_OTHER_KINDS = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z-])"
PATTERNS = {
    # a domain has at most 127 labels
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}@{_LABEL}(?:\.{_LABEL}){{0,125}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-]|\.[0-9])",
    "ip": rf"(?<![0-9A-Za-z.-]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": (
        r"(?<![0-9A-Za-z+(-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
        r"|(?<![0-9A-Za-z+])\+1(?:[ .-]?[0-9]){10}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+])\+[2-9](?:[ -]?[0-9]){7,14}(?![0-9A-Za-z-])"
    ),
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    # groups of four first, so that a number isn't cut by the groups before it
    "card": (
        r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -][0-9]{4}){3,15}(?:[ -][0-9]{1,3})?(?![0-9A-Za-z-]|\.[0-9])"
        rf"|(?<![0-9A-Za-z.-])(?!(?:[0-9]{{1,8}}[ -]){{1,3}}{_OTHER_KINDS})[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9A-Za-z-]|\.[0-9])"
    ),
}
ANY = "|".join(PATTERNS.values())
MAYBE = r"[0-9@]"
EPOCH, DAYS = "1900-01-01", 73049
WALKS = 64
#: Marks ends of parts of a found value; no value holds it.
CUT = "\x1f"


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _hex(key: str, kind: str, i: Column, x: Column, bits: int = 256) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), bits)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _rounds() -> Column:
    return F.sequence(F.lit(1), F.lit(ROUNDS))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str) -> Column:
    """A permutation of the pairs (a, b), a below size_a and b below size_b."""
    step = lambda s, i: F.when(
        i % 2 == 1, F.struct(((s["a"] + _number(_hex(key, kind, i, s["b"]))) % size_a).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + _number(_hex(key, kind, i, s["a"]))) % size_b).alias("b")))
    return F.aggregate(_rounds(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


#: Stand for the digits 2 to 9 where 0 and 1 can't be.
EIGHT = "".join(map(chr, range(0x10, 0x18)))


def _shifted(c: Column, by: Column) -> Column:
    """A digit or letter moved within its class; anything else as it is. EIGHT is a class of eight for callers."""
    out = c
    for low, high in (("a", "z"), ("A", "Z"), ("0", "9"), (EIGHT[0], EIGHT[-1])):
        n = ord(high) - ord(low) + 1
        out = F.when(c.between(low, high), F.chr((F.ascii(c) - ord(low) + by) % n + ord(low))).otherwise(out)
    return out


def permute_string(s: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of one length and pattern of classes: the halves take turns, each
    character of one moved within its class by a digest of the other. Up to 64 characters."""
    h = F.floor(F.length(s) / 2).cast("int")
    shift = lambda part, digest: F.array_join(
        F.transform(_chars(part), lambda c, j: _shifted(c, F.conv(F.substring(digest, (j * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int"))), ""
    )
    start = F.struct(F.substring(s, F.lit(1), h).alias("l"), F.substring(s, h + 1, F.length(s)).alias("r"))
    step = lambda x, i: F.struct(x["r"].alias("l"), shift(x["l"], _hex(key, kind, i, x["r"], 512)).alias("r"))
    return F.aggregate(_rounds(), start, step, lambda x: F.concat(x["l"], x["r"]))


def _put(shape: Column, body: Column) -> Column:
    """body's characters in the places that hold a letter or digit in shape."""
    return F.aggregate(
        _chars(shape), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], F.substring(body, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _digit_sum(s: Column) -> Column:
    """Sum of the digits: the length of the text in which every digit is written as that many marks."""
    for d in range(10):
        s = F.replace(s, F.lit(str(d)), F.lit("#" * d))
    return F.length(s)


def _plain_luhn(digits: Column) -> Column:
    """Whether a number has the right check digit, without a lambda (nested ones are slow to plan); every second digit
    counts as its double's digit sum."""
    back = F.reverse(digits)
    doubled = F.translate(F.regexp_replace(back, "(.)(.?)", "$2"), "0123456789", "0246813579")
    return (_digit_sum(doubled) + _digit_sum(F.regexp_replace(back, "(.)(.?)", "$1"))) % 10 == 0


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number of which the check digit is cut off."""
    return F.aggregate(
        F.transform(_chars(F.reverse(digits)), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
        F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d),
    )


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _mod97(s: Column) -> Column:
    return F.aggregate(
        _chars(s), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _valid_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & ~d.rlike("^0+$") & _plain_luhn(d)


def _card_parts(v: Column) -> Column:
    """A run of groups of digits cut into the longest valid numbers of whole groups, from the left, and what is between."""
    groups, seps = F.split(v, "[ -]"), F.regexp_extract_all(v, F.lit("[ -]"), F.lit(0))
    n = F.size(groups)
    # longest first; a number of 19 digits has at most 19 groups
    sizes = lambda i: F.filter(F.reverse(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(19)))), lambda size: _valid_card(F.array_join(F.slice(groups, i, size), "")))
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.coalesce(F.try_element_at(sizes(i), F.lit(1)), F.lit(0)).alias("size")))
    after = lambda i: F.coalesce(F.try_element_at(seps, i), F.lit(""))

    def step(s: Column, x: Column) -> Column:
        i, size, out = x["i"], x["size"], s["out"]
        # a number begins where the one before is over; its parts are put together group by group
        begins = (i >= s["next"]) & (size > 0)
        inside = i < s["next"]
        part = F.get(groups, i - 1)
        own = F.struct(part.alias("text"), (begins | inside).alias("number"), (begins | ~inside).alias("first"))
        gap = F.struct(after(i).alias("text"), (begins & (size > 1) | inside & (i < s["next"] - 1)).alias("number"), F.lit(False).alias("first"))
        return F.struct(F.concat(out, F.array(own, gap)).alias("out"), F.when(begins, i + size).otherwise(s["next"]).alias("next"))

    empty = F.array().cast("array<struct<text:string,number:boolean,first:boolean>>")
    marked = F.aggregate(starts, F.struct(empty.alias("out"), F.lit(1).alias("next")), step, lambda s: s["out"])
    # CUT ends every part: before a number's first group, and where text outside numbers begins
    text = F.array_join(F.transform(marked, lambda m: F.concat(F.when(m["first"] | ~m["number"], CUT).otherwise(""), m["text"])), "")
    return F.filter(F.split(text, CUT), lambda x: x != "")


def _card(v: Column, key: str) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    own = permute_string(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.when(_valid_card(d), _put(v, F.concat(own, _check_digit(own)))).otherwise(v)


def _national(d: Column, key: str) -> Column:
    """Ten national digits; area and exchange codes keep to 2 to 9 at their first digit."""
    coded = lambda i: F.translate(F.substring(d, i, 1), "23456789", EIGHT)
    made = permute_string(F.concat(coded(1), F.substring(d, 2, 2), coded(4), F.substring(d, 5, 6)), key, "phone")
    return F.translate(made, EIGHT, "23456789")


def _phone(v: Column, key: str) -> Column:
    d = F.regexp_replace(v, "[^0-9]", "")
    home = ~v.startswith("+") | d.rlike("^1[0-9]{10}$")
    keep = F.when(home, F.greatest(F.length(d) - 10, F.lit(0))).when(d.startswith("7"), 1).otherwise(2)
    rest = F.substring(d, keep + 1, F.length(d))
    return _put(v, F.concat(F.substring(d, F.lit(1), keep), F.when(home, _national(rest, key)).otherwise(permute_string(rest, key, "phone"))))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(v, "-"), i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    p = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    out = F.concat(
        F.lpad((p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, out).otherwise(v)


def _valid_iban(s: Column) -> Column:
    return (F.length(s) >= 15) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _iban_parts(v: Column) -> Column:
    """The longest valid beginning of whole groups, and the rest."""
    groups = F.split(v, " ")
    fits = F.filter(F.reverse(F.sequence(F.lit(1), F.size(groups))), lambda size: _valid_iban(F.array_join(F.slice(groups, 1, size), "")))
    head = F.array_join(F.slice(groups, 1, F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))), " ")
    return F.filter(F.array(head, F.substring(v, F.length(head) + 1, F.length(v))), lambda x: x != "")


def _iban(v: Column, key: str) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    country = F.substring(s, 1, 2)
    own = permute_string(F.substring(s, F.lit(5), F.length(s)), key, "iban")
    check = F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_valid_iban(s), _put(v, F.concat(country, check, own))).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    o = [F.element_at(F.split(v, r"\."), i).cast("long") for i in (1, 2, 3, 4)]
    p = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string"))


def _email(v: Column, key: str) -> Column:
    return F.concat(permute_string(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _as_date(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))


def _walked(n: Column, key: str) -> Column:
    """A permutation of days that keeps the side of 12 of the day of the month: the Feistel network's rounds go on along
    the cycle, ROUNDS at a time, until it does. WALKS leave 1 in 10^13."""
    late = lambda m: F.dayofmonth(_as_date(m)) > 12
    f = lambda i, x: _number(_hex(key, "date", i, x))
    state = lambda a, b, side, done: F.struct(a.alias("a"), b.alias("b"), side.alias("side"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        i = x % ROUNDS + 1
        odd = state((s["a"] + f(i, s["b"])) % 17, s["b"], s["side"], F.lit(False))
        # the last round is an even one
        b = (s["b"] + f(i, s["a"])) % 4297
        even = state(s["a"], b, s["side"], F.lit(False))
        ends = (i == ROUNDS) & (late(s["a"] * 4297 + b) == s["side"])
        return F.when(s["done"], s).when(i % 2 == 1, odd).when(ends, state(s["a"], b, s["side"], F.lit(True))).otherwise(even)

    start = state(F.floor(n / 4297).cast("long"), (n % 4297).cast("long"), late(n), F.lit(False))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS * ROUNDS - 1)), start, step, lambda s: s["a"] * 4297 + s["b"])


def _date(v: Column, key: str) -> Column:
    p = F.split(v, r"[-./]")
    x, y, z = (F.element_at(p, i) for i in (1, 2, 3))
    slash, dash = F.contains(v, F.lit("/")), F.contains(v, F.lit("-"))
    month_first = slash & (x.cast("int") <= 12)
    iso = F.when(dash, v).when(month_first, F.concat_ws("-", z, x, y)).otherwise(F.concat_ws("-", z, y, x))
    n = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(EPOCH).cast("date")).cast("long")
    shape = F.when(dash, "$1-$2-$3").when(month_first, "$2/$3/$1").when(slash, "$3/$2/$1").otherwise("$3.$2.$1")
    return F.when(n.isNotNull(), F.regexp_replace(_as_date(_walked(n, key)).cast("string"), F.lit("(.{4})-(..)-(..)"), shape)).otherwise(v)


MAKERS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def configured_key(spark: SparkSession) -> str:
    """The session's key."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is unset: pseudonyms are made with a published key, for tests only", stacklevel=2)
    return key or TEST_KEY


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value, or the value itself if it isn't valid; its kind is told by its form."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = value.rlike(rf"^(?:{pattern})\z")
        out = F.when(fits, MAKERS[kind](value, key)) if out is None else out.when(fits, MAKERS[kind](value, key))
    return out.otherwise(value)


def found(text: Column) -> Column:
    """All values in a text that have the form of one of the kinds, valid or not."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def parts(v: Column) -> Column:
    """A found value as the values in it: itself, or what is valid in a longer run and what is around it."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    run = v.rlike("^[0-9][0-9 -]*$") & v.rlike("[ -]") & (F.length(digits) >= 13) & ~_valid_card(digits)
    account = v.rlike("^[A-Z]{2}[0-9]{2}.* ") & ~_valid_iban(F.replace(v, F.lit(" "), F.lit("")))
    return F.when(run, _card_parts(v)).when(account, _iban_parts(v)).otherwise(F.array(v))


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with text replaced and, in a column named by count, how many values were replaced.

    A value whose pseudonym happens to be itself counts as left alone."""
    was, whole, made = unused(docs, "pii_values", "pii_parts", "pii_new")
    out = docs.withColumn(was, F.transform(found(F.col("text")), parts))
    # the text as what is outside values and what is inside, in turns; lambdas aren't nested deeply, as planning would be slow
    outside = F.split("text", ANY, -1)
    values = F.concat(F.col(was), F.array(F.array().cast("array<string>")))
    piece = lambda x, value: F.struct(x.alias("x"), F.lit(value).alias("value"))
    pieces = F.flatten(F.zip_with(outside, values, lambda o, v: F.concat(F.array(piece(o, False)), F.transform(v, lambda x: piece(x, True)))))
    out = out.withColumn(whole, F.when(F.size(was) > 0, pieces))
    out = out.withColumn(made, F.transform(whole, lambda p: F.when(p["value"], pseudonym(p["x"], key)).otherwise(p["x"])))
    if count:
        changed = F.size(F.filter(F.zip_with(whole, made, lambda a, b: a["x"] != b), lambda x: x))
        out = out.withColumn(count, F.when(F.size(was) > 0, changed).otherwise(0).cast("long"))
    return out.withColumn("text", F.when(F.size(was) > 0, F.array_join(made, "")).otherwise(F.col("text"))).drop(was, whole, made)


def op10_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, configured_key(spark), "n_values").select("doc_id", "n_values", "text")
