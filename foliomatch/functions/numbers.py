"""Numbers in text as column expressions. Integers stay digit strings of any length."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomatch import config as C
from foliomatch.functions import patterns as P


def ascii_digits(s: Column) -> Column:
    return F.translate(s, C.THAI_DIGITS, "0123456789")


def bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[,\s\p{Z}]", "")


def _no_leading_zeros(s: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(s, "^0+", ""), F.lit("")), F.lit("0"))


def shortest(x: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent below -4 and from 6 on."""
    sci = F.format_string("%.5e", x)
    exponent = F.regexp_extract(sci, "e([+-][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, "^([^e]*)e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(F.regexp_replace(sci.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((exponent < -4) | (exponent >= 6), F.concat(mantissa, F.regexp_extract(sci, "(e.*)$", 1))).otherwise(plain)


def smart_number(s: Column) -> Column:
    """Numbers in one spelling: 007 and 7, 5.0 and 5; other text without its leading zeros. A number
    beyond the range of doubles gives null."""
    n = bare(s)
    digits = ascii_digits(n)
    x = digits.cast("double")
    sign = F.when(n.startswith("-"), "-").otherwise("")
    whole = _no_leading_zeros(F.regexp_replace(F.regexp_replace(digits, "_", ""), "^[+-]", ""))
    integer = F.when(whole == "0", "0").otherwise(F.concat(sign, whole))
    decimal = F.when(F.abs(x) > 1e37, None).when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(shortest(x))
    return F.when(s.isNull(), None).when(n.rlike(P.DECIMAL), decimal).when(n.rlike(P.INTEGER), integer).otherwise(_no_leading_zeros(n))


def is_number(s: Column) -> Column:
    return bare(s).rlike(P.NUMBER)


def number_value(s: Column) -> Column:
    return F.when(is_number(s), ascii_digits(bare(s)).cast("double"))


def decimal_value(s: Column) -> Column:
    return F.when(is_number(s), ascii_digits(bare(s)).try_cast("decimal(38,10)"))


def numbers_equal(a: Column, b: Column) -> Column:
    """Whole numbers must agree; others within a millionth of the second. Numbers of over 28 whole digits equal none."""
    x, y = decimal_value(a), decimal_value(b)
    close = F.when(x.isNull() | y.isNull(), False).when((x == F.floor(x)) & (y == F.floor(y)), x == y).when(y != 0, F.abs((x.cast("double") - y.cast("double")) / y.cast("double")) < 1e-6).otherwise(x == 0)
    return close


def thai_number(s: Column) -> Column:
    has = lambda words: s.rlike(P.any_of(words))
    return has(C.NUMBER_WORDS) & (has(C.NUMBER_UNITS) | has(C.MONEY_WORDS))
