"""Comparison of pairs of documents: what only one has (diff), what both have (same), counts and marks.

Every table is keyed by ``pair``, which names a pair of documents and a side, so one job compares any number
of pairs and both sides at once. pairs: pair_id, doc1, doc2. With ``catalog=True`` the second document is
a stored one: only the first is marked, and the shorter ladder is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.config import CONFIG, STYLES
from foliomatch.functions import dates, labels, numbers
from foliomatch.functions import patterns as P
from foliomatch.operators import similar, words
from foliomatch.sources.intermediate import NARROW_ROWS, bounded, kept_large, written


def of_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that take part in pairs, each once; texts are shuffled only if there are more of them than can be sent to
    all executors."""
    ids = pairs.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    return docs.join(bounded(written(ids, "pair-documents"), NARROW_ROWS), "doc_id", "left_semi")


def sides(pairs: DataFrame, catalog: bool = False) -> DataFrame:
    """pair, pair_id, side, doc_id, other: a pair seen from each of its documents (catalog: the first only)."""
    seen = [F.struct(F.lit(1).alias("side"), F.col("doc1").alias("doc_id"), F.col("doc2").alias("other"))]
    if not catalog:
        seen.append(F.struct(F.lit(2).alias("side"), F.col("doc2").alias("doc_id"), F.col("doc1").alias("other")))
    out = pairs.select("pair_id", F.explode(F.array(*seen)).alias("s")).select("pair_id", "s.*")
    return out.withColumn("pair", F.col("pair_id") * 2 + F.col("side") - 1)


def counted(small: DataFrame, pairs: DataFrame) -> DataFrame:
    """A table with at most two rows a pair, to be broadcast if there are few enough pairs: words then needn't be shuffled to meet it."""
    return F.broadcast(small) if 2 * pairs.count() <= NARROW_ROWS else small


def _own(seen: DataFrame, vocab: DataFrame, *cols: str) -> DataFrame:
    return seen.select("pair", "doc_id", *cols).join(vocab, "doc_id")


def _others(seen: DataFrame, vocab: DataFrame) -> DataFrame:
    return seen.select("pair", F.col("other").alias("doc_id")).join(vocab, "doc_id")


def alone(pairs: DataFrame, vocab: DataFrame, catalog: bool = False) -> DataFrame:
    """pair and the vocabulary's columns of the words that the other document of a pair doesn't have itself (catalog: of the first
    document only). Words of both sides are shuffled once, without the forms that follow from them, and counted."""
    both = counted(sides(pairs), pairs).select("pair", "pair_id", "side", "doc_id")
    found = both.join(vocab.drop("norm", "norm_nt", "len"), "doc_id").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("pair_id", "clean"))).filter("_n = 1")
    found = found.filter("side = 1") if catalog else found
    return words.with_forms(found.drop("_n", "pair_id", "side"))


def gates(seen: DataFrame, all_words: DataFrame) -> DataFrame:
    """pair, dates, dates_same, times_same; the words of documents in seen only are put together."""
    ids = written(seen.select(F.explode(F.array("doc_id", "other")).alias("doc_id")).distinct(), "dates-documents")
    t = words.full_text(all_words.join(bounded(ids, NARROW_ROWS), "doc_id", "left_semi")).select("doc_id", dates.extract_dates(F.col("full_text")).alias("dates"), dates.extract_times(F.col("full_text")).alias("times"))
    t = kept_large(t, "dates")
    other = t.select(F.col("doc_id").alias("other"), F.col("dates").alias("dates2"), F.col("times").alias("times2"))
    met = seen.join(t, "doc_id", "left").join(other, "other", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return met.select(
        "pair", empty("dates").alias("dates"), dates.lists_same(empty("dates"), empty("dates2")).alias("dates_same"), dates.lists_same(empty("times"), empty("times2")).alias("times_same")
    )


def diff_words(pairs: DataFrame, all_words: DataFrame, vocab: DataFrame, catalog: bool = False) -> DataFrame:
    """pair, pair_id, side, doc_id, clean, first_text, first_page, first_pos of the words only this document has.

    The suppressing conditions are independent of each other; the cheap ones and the equi-joins come
    first, the ladder sees the remaining words without a number only."""
    seen = sides(pairs, catalog)
    near = counted(seen, pairs)
    left = written(alone(pairs, vocab, catalog), "diff-alone")
    other = _others(near, vocab)
    left = left.join(bounded(similar.held(other, left, "norm"), NARROW_ROWS), ["pair", "norm"], "left_anti")
    # few are left: written, or the patterns below would be tried on every word, as Spark filters before it joins
    left = written(left, "diff-rest")
    left = left.filter(~labels.form_label(F.col("first_text")) & ~labels.form_label(F.col("clean")))
    left = left.join(gates(similar.of_pairs_in(seen, left), all_words), "pair")
    left = left.filter(~(F.col("dates_same") & dates.date_word(F.col("first_text"))))
    left = left.filter(~(F.col("times_same") & (F.size(dates.extract_times(F.col("first_text"))) > 0)))
    left = left.withColumn("numeric", F.col("clean").rlike(r"\p{Nd}") | numbers.thai_number(F.col("first_text")))
    day = dates.is_day(F.col("clean"))
    if not catalog:
        day &= F.exists("dates", lambda d: F.contains(d, F.col("clean")))
    left = left.filter(~(F.col("numeric") & F.col("dates_same") & (dates.is_be_year(F.col("clean")) | day)))
    left = written(left.drop("dates", "dates_same", "times_same"), "diff-left")
    of_numbers = left.filter("numeric").withColumn("value", numbers.smart_number(F.col("clean")))
    values = similar.of_pairs_in(other, of_numbers).filter(numbers.is_number(F.col("clean"))).select("pair", numbers.smart_number(F.col("clean")).alias("value"))
    of_numbers = of_numbers.join(bounded(similar.held(values, of_numbers, "value"), NARROW_ROWS), ["pair", "value"], "left_anti").drop("value")
    of_words = left.filter("not numeric")
    met = similar.ladder(of_words, other, CONFIG.fuzzy_strict, not catalog)
    of_words = of_words.join(met.select("pair", F.col("a").alias("clean")).distinct(), ["pair", "clean"], "left_anti")
    out = of_numbers.unionByName(of_words)
    return out.join(seen.select("pair", "pair_id", "side"), "pair").select("pair", "pair_id", "side", "doc_id", "clean", "first_text", "first_page", "first_pos", "n_occ")


def same_words(pairs: DataFrame, vocab: DataFrame, catalog: bool = False, lone: DataFrame | None = None) -> DataFrame:
    """pair_id, a, b, stage: matches of the first document's words. Equal words and equal normal forms have one
    partner (the least), the ladder has all its partners. In the catalog's case b is null. lone: ``alone`` of the same tables,
    both sides, if it is there already."""
    seen = sides(pairs, True)
    near = counted(seen, pairs)
    own, other = _own(near, vocab), _others(near, vocab)
    ids = seen.select("pair", "pair_id")
    rest = written(alone(pairs, vocab, True), "same-alone") if lone is None else lone.join(near.select("pair"), "pair", "left_semi")
    # few words are alone: all others are equal, which is told without a second shuffle of all words
    equal = own.select("pair", "clean").join(bounded(rest.select("pair", "clean"), NARROW_ROWS), ["pair", "clean"], "left_anti")
    exact = equal.select("pair", F.col("clean").alias("a"), F.col("clean").alias("b"), F.lit("exact").alias("stage"))
    if catalog:
        fuzzy = similar.ladder(rest, other, CONFIG.fuzzy_loose, False).select("pair", "a").distinct()
        out = exact.select("pair", "a", "stage").unionByName(fuzzy.withColumn("stage", F.lit("fuzzy"))).withColumn("b", F.lit(None).cast("string"))
        return out.join(ids, "pair").select("pair_id", "a", "b", "stage")
    partner = other.join(bounded(rest.select("pair", "norm"), NARROW_ROWS), ["pair", "norm"], "left_semi").groupBy("pair", "norm").agg(F.min("clean").alias("b"))
    partner = bounded(written(partner, "same-partner"), NARROW_ROWS)
    normal = rest.join(partner, ["pair", "norm"]).select("pair", F.col("clean").alias("a"), "b", F.lit("norm").alias("stage"))
    rest = rest.join(partner, ["pair", "norm"], "left_anti")
    fuzzy = similar.ladder(rest, other, CONFIG.fuzzy_loose).select("pair", "a", "b", F.lit("fuzzy").alias("stage"))
    return exact.unionByName(normal).unionByName(fuzzy).join(ids, "pair").select("pair_id", "a", "b", "stage")


_BASE = ("pair_id", "doc1", "doc2", *[f"doc{n}_{c}" for n in (1, 2) for c in ("pages", "total_words", "unique_words")])


def _base(pairs: DataFrame, all_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """pair_id, doc1, doc2 and each document's pages, words and unique words, as ``words.totals`` counts them: the
    vocabulary has a row for each unique word."""
    t = all_words.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"), F.count(F.lit(1)).alias("total_words"))
    t = kept_large(t.join(vocab.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_words")), "doc_id", "left"), "totals")
    for n in (1, 2):
        pairs = pairs.join(t.select(F.col("doc_id").alias(f"doc{n}"), *[F.col(c).alias(f"doc{n}_{c}") for c in ("pages", "total_words", "unique_words")]), f"doc{n}", "left")
    return pairs.na.fill(0)


def _samples(found: DataFrame, by: list[str], n: int = CONFIG.samples) -> DataFrame:
    """by, sample: the first n words by place of each group, joined. Of rows that are shuffled none are behind the first n of their
    task, and no more than n are collected."""
    order = ("first_page", "first_pos", "clean")
    first = found.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n)
    items = F.sort_array(F.collect_list(F.struct(*order)))
    return first.groupBy(*by).agg(F.array_join(F.transform(items, lambda s: s["clean"]), ", ").alias("sample"))


def diff_summary(pairs: DataFrame, all_words: DataFrame, vocab: DataFrame, catalog: bool = False, found: DataFrame | None = None) -> DataFrame:
    """One row a pair: counts, differing words and places of each side, samples and the rate of difference. found:
    ``diff_words`` of the same tables, if it is there already."""
    found = written(diff_words(pairs, all_words, vocab, catalog), "diff-found") if found is None else found
    of = lambda n, x: F.when(F.col("side") == n, x)
    counts = [x for n in (1, 2) for x in (F.count(of(n, 1)).alias(f"diff_doc{n}"), F.sum(of(n, F.col("n_occ"))).alias(f"highlighted_doc{n}"))]
    samples = _samples(found, ["pair_id", "side"]).groupBy("pair_id").agg(*[F.max(of(n, F.col("sample"))).alias(f"sample_doc{n}") for n in (1, 2)])
    out = _base(pairs, all_words, vocab).join(found.groupBy("pair_id").agg(*counts), "pair_id", "left").join(samples, "pair_id", "left")
    out = out.select(*_BASE, *[f"{c}_doc{n}" for n in (1, 2) for c in ("diff", "highlighted", "sample")])
    out = out.na.fill(0).na.fill("")
    unique = F.col("doc1_unique_words") + F.col("doc2_unique_words")
    return out.withColumn("diff_rate", F.when(unique > 0, F.round((F.col("diff_doc1") + F.col("diff_doc2")) * 100.0 / unique, 4)).otherwise(0.0))


def same_summary(pairs: DataFrame, all_words: DataFrame, vocab: DataFrame, catalog: bool = False, met: DataFrame | None = None) -> DataFrame:
    """One row a pair: matched places of each side (distinct by page, corner and text), matched words, a sample and the
    match rate. The rate is places over unique words, so it can exceed 100. met: ``same_words`` of the same tables, if
    it is there already."""
    lone = written(alone(pairs, vocab, catalog), "same-alone")
    met = written(same_words(pairs, vocab, catalog, lone), "same-found") if met is None else met
    seen = sides(pairs, catalog)
    # few words are left unmatched: what is matched is counted by them, so that neither words nor matches are shuffled to meet
    of = lambda c, side: met.filter((F.col("stage") != "exact") & F.col(c).isNotNull()).select((F.col("pair_id") * 2 + side - 1).alias("pair"), F.col(c).alias("clean"))
    gone = lone.select("pair", "doc_id", "clean").join(of("a", 1).union(of("b", 2)).distinct(), ["pair", "clean"], "left_anti")
    gone = bounded(written(gone, "same-unmatched"), NARROW_ROWS)
    place = words.normalised(all_words).select("doc_id", "clean", "page_num", "x0", "y0", "text")
    places = F.count_distinct("page_num", "x0", "y0", "text")
    every, less = place.groupBy("doc_id").agg(places.alias("every")), place.join(gone, ["doc_id", "clean"]).groupBy("pair").agg(places.alias("less"))
    matched = kept_large(seen.join(every, "doc_id").join(less, "pair", "left").select("pair_id", "side", (F.col("every") - F.coalesce("less", F.lit(0))).alias("matched")), "same-places")
    number = lambda n: matched.filter(F.col("side") == n).select("pair_id", F.col("matched").alias(f"matched_doc{n}"))
    own = _own(counted(seen.filter("side = 1").select("pair", "pair_id", "doc_id"), pairs), vocab, "pair_id").join(gone.select("pair", "clean"), ["pair", "clean"], "left_anti")
    one = own.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matched_unique_words"))
    one = one.join(_samples(own, ["pair_id"]).withColumnRenamed("sample", "sample_matched"), "pair_id")
    out = _base(pairs, all_words, vocab).join(one, "pair_id", "left").join(number(1), "pair_id", "left").join(number(2), "pair_id", "left").na.fill(0).na.fill("")
    rate = F.when(F.col("doc1_unique_words") > 0, F.round(F.col("matched_doc1") * 100.0 / F.col("doc1_unique_words"), 4)).otherwise(0.0)
    return out.withColumn("match_rate", rate)


def highlights(found: DataFrame, all_words: DataFrame, mode: str) -> DataFrame:
    """Boxes and colours of all places of the words in found (pair_id, side, doc_id, clean)."""
    style = F.create_map(*[x for (m, side), v in STYLES.items() if m == mode for x in (F.lit(side), F.array(*map(F.lit, v)))])
    places = words.normalised(all_words)
    out = found.select("pair_id", "side", "doc_id", "clean").join(places, ["doc_id", "clean"]).withColumn("style", style[F.col("side")])
    colours = [F.col("style")[i].alias(n) for i, n in enumerate(("r", "g", "b", "opacity"))]
    return out.select("pair_id", "side", "page_num", "pos", "x0", "y0", "x1", "y1", "text", "clean", *colours)


def same_marks(matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, side, doc_id, clean of the words matched on either side, for highlights."""
    of = lambda c, n: matched.filter(F.col(c).isNotNull()).select("pair_id", F.lit(n).alias("side"), F.col(c).alias("clean")).distinct().join(pairs.select("pair_id", F.col(f"doc{n}").alias("doc_id")), "pair_id")
    return of("a", 1).unionByName(of("b", 2))


def page_zip(pairs: DataFrame, all_words: DataFrame) -> DataFrame:
    """pair_id, page_num, has1, has2: the pages of both documents side by side."""
    pages = all_words.select("doc_id", "page_num").distinct()
    of = lambda n: pairs.select("pair_id", F.col(f"doc{n}").alias("doc_id")).join(pages, "doc_id").select("pair_id", "page_num", F.lit(True).alias(f"has{n}"))
    out = of(1).join(of(2), ["pair_id", "page_num"], "full_outer")
    return out.select("pair_id", "page_num", F.coalesce("has1", F.lit(False)).alias("has1"), F.coalesce("has2", F.lit(False)).alias("has2"))


def report_lines(summary: DataFrame, mode: str = "diff") -> DataFrame:
    """pair_id, line_no, line: a summary of either mode as text lines, for the text sink."""
    s = lambda c: F.col(c).cast("string")
    doc = lambda n: F.concat(F.lit(f"Document {n}: "), s(f"doc{n}"), F.lit(", pages "), s(f"doc{n}_pages"), F.lit(", words "), s(f"doc{n}_total_words"), F.lit(", unique "), s(f"doc{n}_unique_words"))
    first = lambda c: F.array_join(F.slice(F.split(c, ", ", -1), 1, 5), ", ")
    rate = lambda what, c: F.concat(F.lit(f"{what} in 1/10000: "), F.round(F.col(c) * 100).cast("long").cast("string"))
    if mode == "same":
        own = [F.concat(F.lit(f"Matching places in document {n}: "), s(f"matched_doc{n}")) for n in (1, 2)]
        own += [F.concat(F.lit("Sample: "), first("sample_matched")), rate("Match rate", "match_rate")]
    else:
        own = [F.concat(F.lit(f"Only in document {n}: "), s(f"diff_doc{n}")) for n in (1, 2)]
        own += [F.concat(F.lit(f"Sample {n}: "), first(f"sample_doc{n}")) for n in (1, 2)] + [rate("Difference rate", "diff_rate")]
    lines = F.array(F.lit("Mode: matches" if mode == "same" else "Mode: differences"), doc(1), doc(2), *own)
    return summary.select("pair_id", F.posexplode(lines).alias("line_no", "line")).select("pair_id", "line_no", F.substring("line", 1, 100).alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    """The text sink: a folder for each pair with its lines in order."""
    one = lines.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    one.write.mode("overwrite").partitionBy("pair_id").text(path)


def legend() -> list[tuple]:
    """What the colours mean: mode, side, r, g, b, opacity, label."""
    said = {"same": "in both documents", "diff": "only in this document"}
    return [(m, side, *v, said[m]) for (m, side), v in STYLES.items()]
