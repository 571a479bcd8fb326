"""Text normalisation as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomatch import config as C
from foliomatch.functions import patterns as P


def clean(s: Column) -> Column:
    """Letters, numbers, underscore and the Thai block only, in lower case."""
    return F.lower(F.regexp_replace(s, P.NOT_WORD, ""))


def without_tones(s: Column) -> Column:
    return F.translate(s, C.TONES, "")


def pad_zeros(s: Column) -> Column:
    """A single digit before, after or within Thai text gets a leading zero."""
    first, second, third = (p for p, _ in P.PAD_ZERO)
    s = F.regexp_replace(s, first, "0$1$2")
    s = F.regexp_replace(s, second, "$10$2")
    return F.regexp_replace(s, third, "$10$2$3")


def normal(s: Column) -> Column:
    return pad_zeros(clean(s))


def date_text(s: Column) -> Column:
    return F.regexp_replace(s, r"[\s\p{Z}/\-]+", "")


def number_text(s: Column) -> Column:
    return F.regexp_replace(s, r"[,.\s\p{Z}]", "")


def blank(s: Column) -> Column:
    return F.coalesce(~s.rlike(r"[^\s\p{Z}]"), F.lit(True))
