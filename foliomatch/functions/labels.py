"""Which words count: significance and form labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomatch import config as C
from foliomatch.functions import patterns as P
from foliomatch.functions.text import clean


def significant_clean(c: Column) -> Column:
    return (F.length(c) >= C.CONFIG.min_word_length) & ~c.isin(*C.STOPWORDS)


def significant(s: Column) -> Column:
    return significant_clean(clean(s))


def form_label(s: Column) -> Column:
    c, raw = clean(s), F.regexp_replace(F.lower(s), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    found = c.isin(*C.LABELS_EXACT, *C.LABELS_PARTIAL) | c.rlike(P.LABEL_INSIDE) | raw.rlike(P.LABEL_INSIDE) | c.rlike(P.LABEL_START) | raw.rlike(P.LABEL_START)
    return (c != "") & found
