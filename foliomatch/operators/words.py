"""Documents to positioned words, and words to vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.functions import patterns as P
from foliomatch.functions.labels import significant_clean
from foliomatch.functions.text import clean, pad_zeros, without_tones


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page_num, pos, x0, y0, x1, y1, text of every word: a line is a page, a token a word, whose box is
    its place in the line and the line's number."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("page_num", "line"))
    words = lines.select("doc_id", "page_num", F.posexplode(F.regexp_extract_all("line", F.lit(P.TOKEN), F.lit(0))).alias("pos", "text"))
    x, y = F.col("pos").cast("double"), F.col("page_num").cast("double")
    return words.select("doc_id", "page_num", "pos", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"), "text")


def cut_line(line: Column) -> Column:
    """A line's words in order, each with text and clean. The line is cleaned at once, white space kept, and then cut at the same places
    as the line itself, which costs a tenth of cleaning each word."""
    cut = lambda s: F.split(s, P.BLANK, -1)
    both = F.arrays_zip(cut(line).alias("text"), cut(F.lower(F.regexp_replace(line, P.NOT_WORD_NOR_BLANK, ""))).alias("clean"))
    return F.filter(both, lambda w: w["text"] != "")


def cleaned_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``occurrences`` with each word's clean form."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("page_num", "line"))
    words = lines.select("doc_id", "page_num", F.posexplode(cut_line(F.col("line"))).alias("pos", "w"))
    x, y = F.col("pos").cast("double"), F.col("page_num").cast("double")
    return words.select("doc_id", "page_num", "pos", x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"), "w.text", "w.clean")


def normalised(words: DataFrame) -> DataFrame:
    """Significant words with clean, which is made here if words don't have it."""
    words = words if "clean" in words.columns else words.withColumn("clean", clean(F.col("text")))
    return words.filter(significant_clean(F.col("clean")))


def vocabulary(words: DataFrame) -> DataFrame:
    """doc_id, clean, n_occ, first_page, first_pos, first_text, norm, norm_nt, len: one row per document and
    significant word. First is by page, then place; partial aggregation runs before the shuffle."""
    at = F.struct("page_num", "pos", "text")
    v = normalised(words).groupBy("doc_id", "clean").agg(F.count(F.lit(1)).alias("n_occ"), F.min(at).alias("first"))
    v = v.select("doc_id", "clean", "n_occ", F.col("first.page_num").alias("first_page"), F.col("first.pos").alias("first_pos"), F.col("first.text").alias("first_text"))
    return with_forms(v)


def with_forms(v: DataFrame) -> DataFrame:
    """v with norm, norm_nt and len, which follow from clean."""
    v = v.withColumn("norm", pad_zeros(F.col("clean")))
    return v.withColumn("norm_nt", without_tones(F.col("norm"))).withColumn("len", F.length("clean"))


def locations(words: DataFrame) -> DataFrame:
    """The index with all places of a word, in order: doc_id, clean, n_occ, locations."""
    at = F.struct("page_num", "pos", "x0", "y0", "x1", "y1", "text")
    return normalised(words).groupBy("doc_id", "clean").agg(F.count(F.lit(1)).alias("n_occ"), F.sort_array(F.collect_list(at)).alias("locations"))


def full_text(words: DataFrame) -> DataFrame:
    """doc_id, full_text: all words in order of page and place, joined by blanks."""
    at = F.struct("page_num", "pos", "text")
    return words.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(at)), lambda w: w["text"]), " ").alias("full_text"))


def totals(words: DataFrame) -> DataFrame:
    """doc_id, pages, total_words, unique_words."""
    c = F.col("clean") if "clean" in words.columns else clean(F.col("text"))
    return words.groupBy("doc_id").agg(
        F.count_distinct("page_num").alias("pages"), F.count(F.lit(1)).alias("total_words"), F.count_distinct(F.when(significant_clean(c), c)).alias("unique_words")
    )
