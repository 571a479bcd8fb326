"""Dates and times in text as column expressions. Both stay text: nothing checks the calendar."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomatch import config as C
from foliomatch.functions import patterns as P
from foliomatch.functions.numbers import ascii_digits


def _two(s: Column) -> Column:
    return F.lpad(ascii_digits(s), 2, "0")


def _month_dates(s: Column, pattern: str, month: str) -> Column:
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    return F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda m: F.concat(_two(part(m, 1)), F.lit(f"-{month}-"), part(m, 2)))


def extract_dates(s: Column) -> Column:
    """DD-MM-YYYY of all dates, each month's name scanned by itself, so matches may overlap; then numeric
    dates. Texts without any month's name skip the 36 scans."""
    part = lambda m, i: F.regexp_extract(m, P.NUMERIC_DATE, i)
    named = F.concat(*[_month_dates(s, p, m) for p, m in P.MONTH_DATES])
    none = F.array().cast("array<string>")
    numeric = F.transform(
        F.regexp_extract_all(s, F.lit(P.NUMERIC_DATE), F.lit(0)), lambda m: F.concat(_two(part(m, 1)), F.lit("-"), _two(part(m, 2)), F.lit("-"), part(m, 3))
    )
    return F.concat(F.when(s.rlike(P.any_of(C.MONTHS)), named).otherwise(none), numeric)


def extract_times(s: Column) -> Column:
    """HH:MM of all hours up to 24."""
    h, m = (F.regexp_extract_all(s, F.lit(P.TIME), F.lit(i)) for i in (1, 2))
    both = F.zip_with(h, m, lambda a, b: F.struct(ascii_digits(a).cast("int").alias("h"), b.alias("m")))
    return F.transform(F.filter(both, lambda t: t["h"] <= 24), lambda t: F.concat(F.lpad(t["h"].cast("string"), 2, "0"), F.lit(":"), t["m"]))


def is_day(s: Column) -> Column:
    return s.rlike(P.DAY)


def is_be_year(s: Column) -> Column:
    return s.rlike(P.BE_YEAR)


def date_word(s: Column) -> Column:
    return s.isin(*C.MONTHS) | is_be_year(s) | is_day(s) | (s.rlike(P.any_of(C.MONTHS)) & s.rlike(r"\p{Nd}")) | s.rlike(f"^{P.NUMERIC_DATE}$")


def date_context(s: Column) -> Column:
    words = P.any_of(C.DATE_KEYWORDS)
    return F.lower(s).rlike(words) | s.rlike(words)


def lists_match(a: Column, b: Column) -> Column:
    """Null if both are empty, true if equal as multisets, false otherwise."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), None).when((F.size(a) > 0) & (F.size(b) > 0), F.sort_array(a) == F.sort_array(b)).otherwise(False)


def lists_same(a: Column, b: Column) -> Column:
    """The comparison's gate: false only if both have some and they differ."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.sort_array(a) == F.sort_array(b)).otherwise(True)
