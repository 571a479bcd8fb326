"""Registered queries over the driver's tables and their SQL.

Scalar functions run over every distinct word of the documents and the sample texts; Thai cases come
from the samples, as the tables have no Thai. Pairs are documents with the one most like them by their whole
texts, and a few inline documents with Thai words, dates, times and numbers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.config import CONFIG
from foliomatch.functions import dates, labels, numbers, text
from foliomatch.functions import patterns as P
from foliomatch.operators import compare, similar, similarity_join, words
from foliomatch.plans import jobs, prompts
from foliomatch.plans import oracles as O
from foliomatch.sources import catalog, documents, index
from foliomatch.sources.intermediate import dealt, kept_large, shared_dir, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SAMPLES = (
    "", "Policy No. 123", "E-Mail_x", "1,234.50", "พ.ศ.", "1มกราคม2567", "มกราคม5", "ก1ข2ค", "๑๒", "ก่ข้ค๊ง๋", "007", "000", "bm007", "00bm", "1_000", "-007", "+7", "-0",
    "1234567.5", "5.0", "0.5", "0.0000123", "-2.50", "12.", ".5", "1 มกราคม 2567 กุมภาพันธ์ 2568 5/6/2567", "12.30 น. 99.10 24:99 1,234.50", "๕ ม.ค. ๒๕๖๗", "31-12-2567", "31/12/2567",
    "15", "32", "2567", "25๖๗", "มกราคม", "5มค", "วันที่ทำสัญญา", "Period of Insurance", "sometimes", "classic", "รวม", "รวมกัน", "numbering", "number", " Amount ", "the", "the!", "นาย", "aa", "a",
    "หนึ่งร้อยบาท", "สิบ", "ห้าบาท", "ร้อยบาท", "/a/P6100283.1.pdf", "dir/.hidden", "noext", "a.b/c", "x y", "premium", "TIME:", "10.45", "9:05 u.", "7:5",
)
NUMBER_SAMPLES = ("7", "007", "7.0", "7.000001", "7.1", "0", "0.0", "-3", "1,000", "1000.0001", "1000", "x", "", "๗")
DATED = ("", "1 มกราคม 2567", "01/01/2567", "5/6/2567 และ 1 มกราคม 2567", "1 มกราคม 2567 5-6-2567", "12.30", "12:30 น.", "9:15 12.30", "no dates", "99:10")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(P.TOKEN), F.lit(0))).alias("s"))
    return docs.union(spark.createDataFrame([(s,) for s in SAMPLES], "s string")).distinct()


def scalar(name: str, expression: Callable[[Column], Column], sql: str, kind: str) -> None:
    QUERIES[name] = lambda spark, d: tokens(spark, d).select("s", expression(F.col("s")).cast(kind).alias("result"))
    ORACLES[name] = f"SELECT s, ({sql})::{kind} AS result FROM ({O.token_table(SAMPLES)})"


def pairwise(name: str, samples: tuple[str, ...], expression: Callable[[Column, Column], Column], sql: str, numbers_only: bool = False) -> None:
    """Over the samples, each with each, and over pairs of documents: their texts, or the numbers at the same places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = spark.createDataFrame([(a, b) for a in samples for b in samples], "a string, b string")
        p = Pairs(spark, sf_dir)
        one = one.union(_same_places(p) if numbers_only else _texts_of_pairs(p))
        return one.select("a", "b", expression(F.col("a"), F.col("b")).alias("result"))

    QUERIES[name] = run
    if numbers_only:
        two = f"{O.BASE}, two AS (SELECT DISTINCT v.text AS a, w.text AS b FROM pairs p JOIN words v ON v.doc_id = p.doc1 JOIN words w ON w.doc_id = p.doc2 AND w.page_num = v.page_num AND w.pos = v.pos WHERE {O.is_number('v.text')} AND {O.is_number('w.text')})"
    else:
        two = f"WITH {O.PAIRS}, two AS (SELECT x.text AS a, y.text AS b FROM pairs p JOIN docs x ON x.doc_id = p.doc1 JOIN docs y ON y.doc_id = p.doc2)"
    listed = f"unnest([{', '.join(map(O.q, samples))}])"
    ORACLES[name] = f"{two} SELECT a, b, ({sql}) AS result FROM (SELECT a, b FROM two UNION ALL SELECT a, b FROM (SELECT {listed} AS a), (SELECT {listed} AS b))"


def _texts_of_pairs(p: Pairs) -> DataFrame:
    of = lambda n, c: p.docs.select(F.col("doc_id").alias(f"doc{n}"), F.col("text").alias(c))
    return p.pairs.join(of(1, "a"), "doc1").join(of(2, "b"), "doc2").select("a", "b")


def _same_places(p: Pairs) -> DataFrame:
    of = lambda n, c: p.words.filter(numbers.is_number(F.col("text"))).select(F.col("doc_id").alias(f"doc{n}"), "page_num", "pos", F.col("text").alias(c))
    return p.pairs.join(of(1, "a"), "doc1").join(of(2, "b"), ["doc2", "page_num", "pos"]).select("a", "b").distinct()


joined = lambda f: lambda s: F.array_join(f(s), "|")
scalar("clean_tokens", text.clean, O.clean("s"), "string")
scalar("norm_tokens", text.normal, O.pad_zeros(O.clean("s")), "string")
scalar("thai_tones", text.without_tones, O.tones("s"), "string")
scalar("date_text_norm", text.date_text, O.sub("s", r"[\s\p{Z}/\-]+", ""), "string")
scalar("number_text_norm", text.number_text, O.sub("s", r"[,.\s\p{Z}]", ""), "string")
scalar("smart_number", numbers.smart_number, O.smart_number("s"), "string")
scalar("number_value", numbers.number_value, f"CASE WHEN {O.is_number('s')} THEN ({O.ascii_digits(O.bare('s'))})::DOUBLE END", "double")
scalar("thai_number_words", numbers.thai_number, O.thai_number("s"), "boolean")
scalar("extract_dates", joined(dates.extract_dates), f"array_to_string({O.extract_dates('s')}, '|')", "string")
scalar("extract_times", joined(dates.extract_times), f"array_to_string({O.extract_times('s')}, '|')", "string")
scalar("date_words", dates.date_word, O.date_word("s"), "boolean")
scalar("date_context", dates.date_context, O.date_context("s"), "boolean")
scalar("significant_words", labels.significant, O.significant(O.clean("s")), "boolean")
scalar("form_labels", labels.form_label, O.form_label("s"), "boolean")
scalar("document_id_from_path", documents.document_id, r"CASE WHEN regexp_matches(regexp_extract(s, '([^/\\]*)$', 1), '^\.[^.]*$') THEN regexp_extract(s, '([^/\\]*)$', 1) ELSE regexp_replace(regexp_extract(s, '([^/\\]*)$', 1), '\.[^.]*$', '') END", "string")
_num = lambda x: f"CASE WHEN {O.is_number(x)} THEN try_cast({O.ascii_digits(O.bare(x))} AS DECIMAL(38,10)) END"
EQUAL_NUMBERS = (
    f"CASE WHEN ({_num('a')}) IS NULL OR ({_num('b')}) IS NULL THEN false WHEN ({_num('a')}) = floor({_num('a')}) AND ({_num('b')}) = floor({_num('b')}) THEN ({_num('a')}) = ({_num('b')}) "
    f"WHEN ({_num('b')}) <> 0 THEN abs((({_num('a')})::DOUBLE - ({_num('b')})::DOUBLE) / ({_num('b')})::DOUBLE) < 1e-6 ELSE ({_num('a')}) = 0 END"
)
pairwise("numbers_equal", NUMBER_SAMPLES, numbers.numbers_equal, EQUAL_NUMBERS, True)
pairwise("dates_match", DATED, lambda a, b: dates.lists_match(dates.extract_dates(a), dates.extract_dates(b)), O.match(O.extract_dates("a"), O.extract_dates("b")))
pairwise("times_match", DATED, lambda a, b: dates.lists_match(dates.extract_times(a), dates.extract_times(b)), O.match(O.extract_times("a"), O.extract_times("b")))
pairwise("date_time_gate", DATED, lambda a, b: dates.lists_same(dates.extract_dates(a), dates.extract_dates(b)) & dates.lists_same(dates.extract_times(a), dates.extract_times(b)),
         f"({O.same(O.extract_dates('a'), O.extract_dates('b'))}) AND ({O.same(O.extract_times('a'), O.extract_times('b'))})")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words with their clean forms, partitioned by document: texts are dealt out by doc_id, so that grouping words by document
    shuffles none."""
    return words.cleaned_occurrences(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def over_words(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(_words(spark, d))
    ORACLES[name] = f"WITH {O.words()}, {O.VOCABULARY} {sql}"


_at = "list((page_num, pos, text) ORDER BY page_num, pos)"
over_words("word_occurrence", lambda w: w.drop("clean"), "SELECT doc_id, page_num, pos, pos::DOUBLE AS x0, page_num::DOUBLE AS y0, (pos + 1)::DOUBLE AS x1, (page_num + 1)::DOUBLE AS y1, text FROM words")
over_words(
    "word_index",
    lambda w: words.locations(w).select("doc_id", "clean", "n_occ", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["page_num"], x["pos"], x["text"])), " ").alias("places")),
    "SELECT doc_id, clean, count(*)::BIGINT AS n_occ, string_agg(page_num || ':' || pos || ':' || text, ' ' ORDER BY page_num, pos) AS places FROM signif GROUP BY ALL",
)
over_words("full_text", words.full_text, "SELECT doc_id, string_agg(text, ' ' ORDER BY page_num, pos) AS full_text FROM words GROUP BY doc_id")
over_words("first_text", lambda w: words.vocabulary(w).select("doc_id", "clean", "first_text", "n_occ"), "SELECT doc_id, clean, first_text, n_occ FROM vocab")
over_words("norm_dictionary", lambda w: words.vocabulary(w).groupBy("doc_id", "norm").agg(F.min("clean").alias("clean")), "SELECT doc_id, norm, min(clean) AS clean FROM vocab GROUP BY ALL")
over_words(
    "number_set", lambda w: words.vocabulary(w).filter(numbers.is_number(F.col("clean"))).select("doc_id", numbers.smart_number(F.col("clean")).alias("value")).distinct(),
    f"SELECT DISTINCT doc_id, {O.smart_number('clean')} AS value FROM vocab WHERE {O.is_number('clean')}",
)
over_words("doc_word_counts", words.totals, f"SELECT doc_id, count(DISTINCT page_num)::BIGINT AS pages, count(*)::BIGINT AS total_words, count(DISTINCT clean) FILTER ({O.significant('clean')})::BIGINT AS unique_words FROM sig GROUP BY doc_id")


def _closest(docs: DataFrame) -> DataFrame:
    return similarity_join.closest_pairs(similarity_join.similar_documents(docs))


class Pairs:
    """Documents that are much alike, and the inline pairs, with their words and vocabularies. The words of documents
    outside pairs go early; what a query doesn't use isn't made."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        docs = _docs(spark, sf_dir).select("doc_id", "text")
        own = spark.createDataFrame([(a, a, b) for a, b in O.INLINE_PAIRS], "pair_id long, doc1 long, doc2 long")
        self.pairs = written(_closest(docs).union(own), "pairs")
        docs = docs.union(spark.createDataFrame(O.INLINE, "doc_id long, text string"))
        self.docs = kept_large(compare.of_pairs(self.pairs, docs), "pair-texts")
        self.seen = compare.sides(self.pairs, True)
        self.ids = self.seen.select("pair", "pair_id")

    @cached_property
    def words(self) -> DataFrame:
        return kept_large(words.cleaned_occurrences(self.docs), "words")

    @cached_property
    def vocab(self) -> DataFrame:
        return kept_large(words.vocabulary(self.words), "vocabulary")

    @cached_property
    def own(self) -> DataFrame:
        return self.seen.select("pair", "doc_id").join(self.vocab, "doc_id")

    @cached_property
    def other(self) -> DataFrame:
        return self.seen.select("pair", F.col("other").alias("doc_id")).join(self.vocab, "doc_id")

    @cached_property
    def rest(self) -> DataFrame:
        return written(compare.alone(self.pairs, self.vocab, True), "pairs-rest")

    def named(self, df: DataFrame, *cols: str) -> DataFrame:
        return df.join(self.ids, "pair").select("pair_id", *cols)


QUERIES["similar_documents"] = lambda spark, d: similarity_join.similar_documents(_docs(spark, d))
ORACLES["similar_documents"] = f"WITH {O.SIMILAR} SELECT doc_id, class_id, coalesce(links, 0)::BIGINT AS links, best[2] AS closest, -best[1] AS similarity FROM near_members LEFT JOIN near_best ON a = class_id"


def over_pairs(name: str, f: Callable[[Pairs], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: f(Pairs(spark, d))
    if sql:
        ORACLES[name] = sql


_own = f"{O.BASE}, {O.sides(True)}, own AS (SELECT s.pair_id, s.side, s.other, v.* FROM sides s JOIN vocab v USING (doc_id)), rest AS (SELECT * FROM own w WHERE NOT EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND o.clean = w.clean))"
_semi = lambda key, frm="own": f"{_own} SELECT pair_id, clean FROM {frm} w WHERE EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND o.{key} = w.{key})"
_eq = lambda key: lambda p: p.named((p.own if key == "clean" else p.rest).join(p.other.select("pair", key), ["pair", key], "left_semi"), "clean")
over_pairs("match_exact", _eq("clean"), _semi("clean"))
over_pairs("match_norm", _eq("norm"), _semi("norm", "rest"))
over_pairs("match_tone", _eq("norm_nt"), _semi("norm_nt", "rest"))
_inside = lambda form: f"{_own} SELECT DISTINCT l.pair_id, l.clean AS a, o.clean AS b FROM rest l JOIN vocab o ON o.doc_id = l.other WHERE length(l.{form}) >= 3 AND length(o.{form}) >= 3 AND (contains(l.{form}, o.{form}) OR contains(o.{form}, l.{form}))"
over_pairs("match_contains", lambda p: p.named(similar.contained(p.rest, p.other, "norm").distinct(), "a", "b"), _inside("norm"))
over_pairs("match_contains_tone", lambda p: p.named(similar.contained(p.rest, p.other, "norm_nt").distinct(), "a", "b"), _inside("norm_nt"))
_ratio = f"2 * ({O.lcs('l.clean', 'o.clean')}) / (l.len + o.len)::DOUBLE"
over_pairs(
    "match_ratio", lambda p: p.named(similar.alike(p.rest, p.other, CONFIG.fuzzy_strict), "a", "b", "score"),
    f"""{_own}, c AS (SELECT l.pair_id, l.clean AS a, o.clean AS b, {_ratio} AS score FROM rest l JOIN vocab o ON o.doc_id = l.other
    WHERE abs(o.len - l.len) <= greatest(l.len * 0.5, 3) AND 2 * least(l.len, o.len) >= 0.8 * (l.len + o.len)
    AND 2 * len(list_filter(string_split(l.clean, ''), lambda c: contains(o.clean, c))) >= 0.8 * (l.len + o.len)) SELECT * FROM c WHERE score >= 0.8""",
)
over_pairs("fuzzy_ladder", lambda p: p.named(similar.ladder(p.rest, p.other, CONFIG.fuzzy_default), "a", "b", "score"), f"{_own}, met AS ({O.matches('rest', CONFIG.fuzzy_default, True)}) SELECT pair_id, a, b, score FROM met")
over_pairs("fuzzy_ladder_index", lambda p: p.named(similar.ladder(p.rest, p.other, CONFIG.fuzzy_default, False), "a", "b"), f"{_own}, met AS ({O.matches('rest', CONFIG.fuzzy_default, False)}) SELECT pair_id, a, b FROM met")


def _equal_numbers(p: Pairs) -> DataFrame:
    """Numbers of both documents of a pair, wherever they stand, that are equal within a millionth."""
    of = lambda n, c: p.pairs.select("pair_id", F.col(f"doc{n}").alias("doc_id")).join(p.words.filter(numbers.is_number(F.col("text"))), "doc_id").select("pair_id", F.col("text").alias(c)).distinct()
    return similar.equal_numbers(of(1, "a"), of(2, "b"), ["pair_id"])


over_pairs(
    "equal_numbers", _equal_numbers,
    f"{O.BASE}, n1 AS (SELECT DISTINCT pair_id, text AS a FROM pairs JOIN words ON doc_id = doc1 WHERE {O.is_number('text')}), n2 AS (SELECT DISTINCT pair_id, text AS b FROM pairs JOIN words ON doc_id = doc2 WHERE {O.is_number('text')}) SELECT pair_id, a, b FROM n1 JOIN n2 USING (pair_id) WHERE {EQUAL_NUMBERS}",
)


DIFF = ("pair_id", "side", "doc_id", "clean", "first_text", "n_occ")
_number = lambda c: F.substring_index(c, ":", -1).cast("long").alias(c)


def _numbered(summary: DataFrame) -> DataFrame:
    return summary.select(*[_number(c) if c in ("doc1", "doc2") else c for c in summary.columns])


def _from_catalog(p: Pairs, mode: str) -> jobs.Compared:
    """The pairs with their second documents put into a catalog, whose stored word indexes are compared."""
    second = p.docs.join(p.pairs.select(F.col("doc2").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = second.select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("filename"), F.col("text").alias("extracted_text"), F.size(F.split("text", "\n", -1)).alias("page_count"))
    store = _store(p.docs.sparkSession)
    catalog.put(store, texts, index.indexed(words.cleaned_occurrences(dealt(second))))
    first = p.docs.join(p.pairs.select(F.col("doc1").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = p.pairs.select("pair_id", F.col("doc1").alias("doc_id"), F.col("doc2").cast("string").alias("document_id"))
    return jobs.compare_with_catalog(pairs, words.occurrences(first), store.table(), mode)


def _number_anti(p: Pairs) -> DataFrame:
    value = numbers.smart_number(F.col("clean")).alias("value")
    own = p.own.filter(F.col("clean").rlike(r"\p{Nd}")).select("pair", "clean", value)
    return p.named(own.join(p.other.filter(numbers.is_number(F.col("clean"))).select("pair", value), ["pair", "value"], "left_anti"), "clean")


over_pairs("number_anti", _number_anti, f"{_own} SELECT pair_id, clean FROM own w WHERE {O.rx('clean', chr(92) + 'p{Nd}')} AND NOT EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND {O.is_number('o.clean')} AND {O.smart_number('o.clean')} = {O.smart_number('w.clean')})")
over_pairs(
    "word_locations",
    lambda p: p.named(p.own.join(p.other.select("pair", "clean"), ["pair", "clean"], "left_semi").select("pair", "doc_id", "clean").join(words.normalised(p.words), ["doc_id", "clean"]), "clean", "page_num", "pos", "text"),
    f"{_own} SELECT w.pair_id, w.clean, s.page_num, s.pos, s.text FROM own w JOIN signif s USING (doc_id, clean) WHERE EXISTS (SELECT 1 FROM vocab o WHERE o.doc_id = w.other AND o.clean = w.clean)",
)
over_pairs("diff_words", lambda p: compare.diff_words(p.pairs, p.words, p.vocab).select(*DIFF), f"{O.diff(False)} SELECT pair_id, side::INT AS side, doc_id, clean, first_text, n_occ FROM diff")
over_pairs("same_words", lambda p: compare.same_words(p.pairs, p.vocab), f"{O.same_ctes(False)} SELECT pair_id, a, b, stage FROM same")
over_pairs("diff_summary", lambda p: compare.diff_summary(p.pairs, p.words, p.vocab), f"{O.diff_summary(False)} SELECT * FROM summary")
over_pairs("same_summary", lambda p: compare.same_summary(p.pairs, p.words, p.vocab), O.same_summary(False))
over_pairs("diff_words_catalog", lambda p: _from_catalog(p, "diff").found.select(*[_number(c) if c == "doc_id" else c for c in DIFF]), f"{O.diff(True)} SELECT pair_id, side::INT AS side, doc_id, clean, first_text, n_occ FROM diff")
over_pairs("same_words_catalog", lambda p: _from_catalog(p, "same").found, f"{O.same_ctes(True)} SELECT pair_id, a, b, stage FROM same")
over_pairs("diff_summary_catalog", lambda p: _numbered(_from_catalog(p, "diff").summary), f"{O.diff_summary(True)} SELECT * FROM summary")
over_pairs("same_summary_catalog", lambda p: _numbered(_from_catalog(p, "same").summary), O.same_summary(True))
over_pairs("diff_samples", lambda p: compare.diff_summary(p.pairs, p.words, p.vocab).select("pair_id", "sample_doc1", "sample_doc2"), f"{O.diff_summary(False)} SELECT pair_id, sample_doc1, sample_doc2 FROM summary")
over_pairs(
    "highlights", lambda p: compare.highlights(compare.diff_words(p.pairs, p.words, p.vocab), p.words, "diff"),
    f"""{O.diff(False)} SELECT d.pair_id, d.side::INT AS side, s.page_num, s.pos, s.pos::DOUBLE AS x0, s.page_num::DOUBLE AS y0, (s.pos + 1)::DOUBLE AS x1, (s.page_num + 1)::DOUBLE AS y1, s.text, d.clean,
    CASE d.side WHEN 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS r, CASE d.side WHEN 1 THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS g, 0.3::DOUBLE AS b, 0.4::DOUBLE AS opacity FROM diff d JOIN signif s USING (doc_id, clean)""",
)
over_pairs(
    "page_zip", lambda p: compare.page_zip(p.pairs, p.words),
    f"""{O.BASE}, pg AS (SELECT DISTINCT doc_id, page_num FROM words), p1 AS (SELECT pair_id, page_num FROM pairs JOIN pg ON doc_id = doc1), p2 AS (SELECT pair_id, page_num FROM pairs JOIN pg ON doc_id = doc2)
    SELECT coalesce(p1.pair_id, p2.pair_id) AS pair_id, coalesce(p1.page_num, p2.page_num) AS page_num, p1.pair_id IS NOT NULL AS has1, p2.pair_id IS NOT NULL AS has2 FROM p1 FULL JOIN p2 ON p1.pair_id = p2.pair_id AND p1.page_num = p2.page_num""",
)
over_pairs(
    "highlights_same", lambda p: compare.highlights(compare.same_marks(compare.same_words(p.pairs, p.vocab), p.pairs), p.words, "same"),
    f"""{O.same_ctes(False)}, marks AS (SELECT DISTINCT pair_id, 1 AS side, doc1 AS doc_id, a AS clean FROM same JOIN pairs USING (pair_id) UNION ALL SELECT DISTINCT pair_id, 2, doc2, b FROM same JOIN pairs USING (pair_id))
    SELECT d.pair_id, d.side::INT AS side, s.page_num, s.pos, s.pos::DOUBLE AS x0, s.page_num::DOUBLE AS y0, (s.pos + 1)::DOUBLE AS x1, (s.page_num + 1)::DOUBLE AS y1, s.text, d.clean,
    0.0::DOUBLE AS r, 0.8::DOUBLE AS g, 0.0::DOUBLE AS b, 0.35::DOUBLE AS opacity FROM marks d JOIN signif s USING (doc_id, clean)""",
)
_line = lambda n: f"'Document {n}: ' || doc{n} || ', pages ' || doc{n}_pages || ', words ' || doc{n}_total_words || ', unique ' || doc{n}_unique_words"
over_pairs(
    "report_lines", lambda p: compare.report_lines(compare.diff_summary(p.pairs, p.words, p.vocab)),
    f"""{O.diff_summary(False)}, l AS (SELECT pair_id, ['Mode: differences', {_line(1)}, {_line(2)}, 'Only in document 1: ' || diff_doc1, 'Only in document 2: ' || diff_doc2,
    'Sample 1: ' || array_to_string(string_split(sample_doc1, ', ')[1:5], ', '), 'Sample 2: ' || array_to_string(string_split(sample_doc2, ', ')[1:5], ', '),
    'Difference rate in 1/10000: ' || round(diff_rate * 100)::BIGINT] AS l FROM summary)
    SELECT pair_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, left(unnest(l), 100) AS line FROM l""",
)


over_pairs(
    "report_lines_same", lambda p: compare.report_lines(compare.same_summary(p.pairs, p.words, p.vocab), "same"),
    f"""WITH summary AS ({O.same_summary(False)}), l AS (SELECT pair_id, ['Mode: matches', {_line(1)}, {_line(2)}, 'Matching places in document 1: ' || matched_doc1, 'Matching places in document 2: ' || matched_doc2,
    'Sample: ' || array_to_string(string_split(sample_matched, ', ')[1:5], ', '), 'Match rate in 1/10000: ' || round(match_rate * 100)::BIGINT] AS l FROM summary)
    SELECT pair_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, left(unnest(l), 100) AS line FROM l""",
)


def _two_texts(p: Pairs) -> DataFrame:
    of = lambda n: p.docs.select(F.col("doc_id").alias(f"doc{n}"), F.col("text").alias(f"text{n}"))
    both = p.pairs.join(of(1), "doc1").join(of(2), "doc2")
    return both.filter(~text.blank(F.col("text1")) & ~text.blank(F.col("text2")))


_texts = f"two AS (SELECT p.*, a.text AS text1, b.text AS text2 FROM pairs p JOIN docs a ON a.doc_id = p.doc1 JOIN docs b ON b.doc_id = p.doc2 WHERE NOT {O.blank('a.text')} AND NOT {O.blank('b.text')})"
over_pairs(
    "prompt_compare", lambda p: _two_texts(p).select("pair_id", *[prompts.compare(language=lang, mode=mode).alias(f"{lang}_{mode}") for lang, mode in prompts.COMPARE]),
    f"WITH {O.PAIRS}, {_texts} SELECT pair_id, " + ", ".join(
        f"{O.q(said)} || chr(10) || chr(10) || '<document_1>' || chr(10) || left(text1, 20000) || chr(10) || '</document_1>' || chr(10) || chr(10) || '<document_2>' || chr(10) || left(text2, 20000) || chr(10) || '</document_2>' AS {lang}_{mode}"
        for (lang, mode), said in prompts.COMPARE.items()) + " FROM two",
)
over_pairs(
    "prompt_summary", lambda p: _two_texts(p).join(compare.diff_summary(p.pairs, p.words, p.vocab).drop("doc1", "doc2"), "pair_id").select("pair_id", prompts.summary().alias("prompt")),
    f"""{O.diff_summary(False)}, {_texts} SELECT pair_id, 'Explain this comparison: document type, key data, what agrees, what differs, what to verify.' || chr(10) || chr(10) || 'Words only in document 1: ' || diff_doc1 || chr(10) ||
    'Words only in document 2: ' || diff_doc2 || chr(10) || 'Sample 1: ' || sample_doc1 || chr(10) || 'Sample 2: ' || sample_doc2 || chr(10) || chr(10) || 'Document 1:' || chr(10) || left(text1, 3000) || chr(10) || chr(10) || 'Document 2:' || chr(10) || left(text2, 3000) AS prompt
    FROM two JOIN summary USING (pair_id)""",
)
QUERIES["prompt_classify"] = lambda spark, d: _docs(spark, d).filter(~text.blank(F.col("text"))).select("doc_id", prompts.classify().alias("en"), prompts.classify(language="th").alias("th"))
ORACLES["prompt_classify"] = f"SELECT doc_id, {O.q(prompts.CLASSIFY['en'])} || left(text, 10000) AS en, {O.q(prompts.CLASSIFY['th'])} || left(text, 10000) AS th FROM documents WHERE NOT {O.blank('text')}"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as a catalog."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    day = F.timestamp_seconds(F.col("item_id") * 3600)
    return b.select(F.concat(F.lit("old-"), F.col("item_id")).alias("id"), F.col("item_id").cast("string").alias("document_id"), F.concat(F.col("item_id"), F.lit(".pdf")).alias("filename"), F.col("text").alias("extracted_text"), F.lit(None).cast(index.BY_PAGE).alias("by_page"), F.lit(None).cast(index.BY_WORD).alias("by_word"), F.lit(1).alias("page_count"), day.alias("created_at"), day.alias("updated_at"))


_pages = "len(string_split(text, chr(10)))::INT"


def _catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("filename"), F.col("text").alias("extracted_text"), F.size(F.split("text", "\n", -1)).alias("page_count"))
    return catalog.merged(_stored(spark, sf_dir), new).select("document_id", "filename", F.md5("extracted_text").alias("digest"), "page_count", F.coalesce(F.col("id").startswith("old-"), F.lit(False)).alias("kept_id"))


QUERIES["catalog_upsert"] = _catalog_upsert
ORACLES["catalog_upsert"] = f"""SELECT doc_id::VARCHAR AS document_id, source || '.pdf' AS filename, md5(text) AS digest, {_pages} AS page_count, doc_id IN (SELECT item_id FROM benchmark) AS kept_id FROM documents
UNION ALL SELECT item_id::VARCHAR, item_id || '.pdf', md5(text), 1, true FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)"""


def _store(spark: SparkSession) -> catalog.Catalog:
    """A new catalog among the session's intermediates."""
    return catalog.Catalog(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/catalog-{uuid.uuid4().hex}")


def _filled(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    store = _store(spark)
    store.restore(_stored(spark, sf_dir))
    return store


def _catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete("3")
    return store.table().select("document_id", "filename")


QUERIES["catalog_get"] = lambda spark, d: _filled(spark, d).get("3").select("document_id", "filename", "extracted_text")
ORACLES["catalog_get"] = "SELECT item_id::VARCHAR AS document_id, item_id || '.pdf' AS filename, text AS extracted_text FROM benchmark WHERE item_id = 3 LIMIT 1"
QUERIES["catalog_list"] = lambda spark, d: _filled(spark, d).listing().select("document_id", "filename", F.format_string("%s (%s)", "document_id", "filename").alias("label"), "page_count")
ORACLES["catalog_list"] = "SELECT item_id::VARCHAR AS document_id, item_id || '.pdf' AS filename, item_id || ' (' || item_id || '.pdf)' AS label, 1::INT AS page_count FROM benchmark ORDER BY item_id DESC"
QUERIES["catalog_delete"] = _catalog_delete
ORACLES["catalog_delete"] = "SELECT item_id::VARCHAR AS document_id, item_id || '.pdf' AS filename FROM benchmark WHERE item_id <> 3"


def _index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of all documents to JSON and back, and what is in them then."""
    said = index.json_of_texts(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return index.contents(said.select("doc_id", index.from_json(F.col("word_index")).alias("index")))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files whose pages are turns, through the whole job: text, words, index, upsert, and back from the catalog."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pages = turns.select(F.format_string("/in/c%d.x.txt", "conv_id").alias("path"), F.col("turn").cast("int").alias("page_num"), F.col("text").alias("native_text"))
    store = _store(spark)
    jobs.ingest_pages(store, documents.sized(pages))
    total = F.aggregate("by_page", F.lit(0).cast("long"), lambda a, p: a + F.size(p["words"]))
    unique = F.when(F.col("by_word").isNotNull(), F.size("by_word").cast("long"))
    return store.table().select("document_id", "filename", "page_count", F.md5("extracted_text").alias("digest"), F.coalesce(total, F.lit(0).cast("long")).alias("total_words"), F.coalesce(unique, F.lit(0).cast("long")).alias("unique_words"))


QUERIES["ingest_pages"] = _ingested
ORACLES["ingest_pages"] = f"""WITH {O.words("(SELECT conv_id AS doc_id, text FROM conversations)")}, {O.SIGNIFICANT},
counted AS (SELECT doc_id, count(*)::BIGINT AS total_words, count(DISTINCT clean) FILTER ({O.significant('clean')})::BIGINT AS unique_words FROM sig GROUP BY doc_id),
files AS (SELECT conv_id AS doc_id, count(DISTINCT turn)::INT AS page_count, md5(coalesce(string_agg('--- Page ' || (turn + 1) || ' (Native) ---' || chr(10) || text || chr(10), '' ORDER BY turn) FILTER (NOT {O.blank('text')}), '')) AS digest FROM conversations GROUP BY conv_id)
SELECT 'c' || doc_id || '.x' AS document_id, 'c' || doc_id || '.x.txt' AS filename, page_count, digest, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words FROM files LEFT JOIN counted USING (doc_id)"""
QUERIES["index_json_roundtrip"] = _index_json
ORACLES["index_json_roundtrip"] = f"""WITH {O.words()}, {O.VOCABULARY},
placed AS (SELECT *, page_num || ':' || pos || ':' || pos || ':' || page_num || ':' || (pos + 1) || ':' || (page_num + 1) || ':' || text AS place FROM sig),
entries AS (SELECT doc_id, clean, clean || '=' || string_agg(place, ' ' ORDER BY page_num, pos) AS e FROM placed WHERE {O.significant('clean')} GROUP BY doc_id, clean),
digests AS (SELECT doc_id, md5(string_agg(e, chr(10) ORDER BY clean)) AS index_digest FROM entries GROUP BY doc_id)
SELECT doc_id, count(DISTINCT page_num)::BIGINT AS pages, count(DISTINCT clean) FILTER ({O.significant('clean')})::BIGINT AS unique_words, count(*)::BIGINT AS total_words, max(page_num)::INT AS last_page,
  md5(string_agg(place, ' ' ORDER BY page_num, pos)) AS words_digest, coalesce(any_value(index_digest), md5('')) AS index_digest FROM placed LEFT JOIN digests USING (doc_id) GROUP BY doc_id"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("page_num"), c("l_partkey").alias("det_no"), c("l_quantity").alias("tlx"), c("l_quantity").alias("tly"),
        (c("l_quantity") + 9).alias("trx"), (c("l_quantity") - 1).alias("try_"), (c("l_quantity") + 10).alias("brx"), (c("l_quantity") + 5).alias("bry"), (c("l_quantity") - 2).alias("blx"), (c("l_quantity") + 6).alias("bly"),
        F.when(c("l_returnflag") == "R", F.lit("  ")).otherwise(c("l_linestatus")).alias("text"), (c("l_discount") * 10).alias("prob"), F.lit(0.24).alias("scale_x"), F.lit(0.5).alias("scale_y"))


QUERIES["ocr_filter_bbox"] = lambda spark, d: documents.detection_words(_detections(spark, d))
ORACLES["ocr_filter_bbox"] = """SELECT l_orderkey AS doc_id, l_linenumber AS page_num, l_partkey AS det_no, (l_quantity - 2) * 0.24::DOUBLE AS x0, (l_quantity - 1) * 0.5::DOUBLE AS y0, (l_quantity + 10) * 0.24::DOUBLE AS x1, (l_quantity + 6) * 0.5::DOUBLE AS y1, l_linestatus AS text
FROM lineitem WHERE l_discount * 10 > 0.2::DOUBLE AND l_returnflag <> 'R'"""


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    box = [(c("l_quantity") - 5).alias("x0"), (c("l_quantity") * 2 - 3).alias("y0"), (c("l_quantity") - 5 + c("l_linenumber") - 2).alias("x1"), (c("l_quantity") * 2).alias("y1")]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("pos"), *box, F.lit(40.0).alias("page_w"), F.lit(80.0).alias("page_h"))


QUERIES["native_bbox_filter"] = lambda spark, d: documents.inside_page(_native(spark, d)).select("doc_id", "pos", "x0", "y0", "x1", "y1")
ORACLES["native_bbox_filter"] = """SELECT * FROM (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_quantity - 5 AS x0, l_quantity * 2 - 3 AS y0, l_quantity - 5 + l_linenumber - 2 AS x1, l_quantity * 2 AS y1 FROM lineitem)
WHERE x0 >= 0 AND x0 < 40 AND y0 >= 0 AND y0 < 80 AND x1 > x0 AND y1 > y0"""
QUERIES["page_source_switch"] = lambda spark, d: documents.page_source(_words(spark, d).groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("native_words")), False)
ORACLES["page_source_switch"] = f"WITH {O.words()} SELECT doc_id, page_num, CASE WHEN count(*) < 5 THEN 'ocr' ELSE 'native' END AS source FROM words GROUP BY ALL"


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.when(F.col("role") == "user", F.col("text")).otherwise("  ").alias("native_text"), F.when(F.col("role") != "system", F.col("text")).alias("ocr_text"))
    return documents.extracted_text(pages)


QUERIES["extracted_text"] = _extracted
ORACLES["extracted_text"] = f"""SELECT conv_id AS doc_id, coalesce(string_agg('--- Page ' || (turn + 1) || CASE WHEN role = 'user' AND NOT {O.blank('text')} THEN ' (Native) ---' ELSE ' (EasyOCR) ---' END || chr(10) || text || chr(10), '' ORDER BY turn)
FILTER (role <> 'system' AND text IS NOT NULL), '') AS extracted_text FROM conversations GROUP BY conv_id"""
