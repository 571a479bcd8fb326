import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomatch.functions import numbers
from foliomatch.functions.text import clean, pad_zeros, without_tones
from foliomatch.operators import compare, similar, words
from foliomatch.sources.intermediate import written

A = "Policy Insured John Smith Plate BM123 Amount 0500 Seats 17 Color red sometimes Bangkok"
B = "Policy Insured Jane Smyth Plate NM333 Amount 500 Seats 25 Colour blue never Pattaya"


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abกข1", max_size=80), st.text("abกข1", max_size=80))
def test_lcs(a, b):
    n = similar.lcs_length(a, b)
    assert n == naive_lcs(a, b) == similar.lcs_length(b, a) <= min(len(a), len(b))


def tables(spark, *texts):
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = words.occurrences(docs)
    return spark.createDataFrame([(1, 1, 2)], "pair_id long, doc1 long, doc2 long"), found, words.vocabulary(found)


def test_golden_pair(spark):
    pairs, found, vocab = tables(spark, A, B)
    only = compare.diff_words(pairs, found, vocab).collect()
    assert {r.clean for r in only if r.side == 1} == {"bangkok", "bm123", "john"}
    assert {r.clean for r in only if r.side == 2} == {"blue", "jane", "never", "nm333", "pattaya"}
    same = compare.same_words(pairs, vocab).collect()
    assert {r.a for r in same} == {"policy", "insured", "smith", "plate", "amount", "0500", "seats", "color", "red"}
    summary = compare.diff_summary(pairs, found, vocab).first()
    assert (summary.doc1_total_words, summary.doc1_unique_words, summary.doc2_unique_words) == (14, 14, 14)
    assert summary.diff_rate == pytest.approx(28.5714)
    marks = compare.highlights(compare.diff_words(pairs, found, vocab), found, "diff").collect()
    assert {(m.side, m.r) for m in marks} == {(1, 1.0), (2, 0.3)} and len(marks) == 8
    lines = [r.line for r in compare.report_lines(compare.diff_summary(pairs, found, vocab)).orderBy("line_no").collect()]
    assert lines[3] == "Only in document 1: 3" and len(lines) == 8


def test_gate_closed_by_differing_dates(spark):
    pairs, found, vocab = tables(spark, A + " 1 มกราคม 2567", B + " 2 มกราคม 2567")
    assert "17" in {r.clean for r in compare.diff_words(pairs, found, vocab).collect() if r.side == 1}


LADDER = [
    ("premium", "premium", 1.0, 1.0, True), ("5มกราคม", "05มกราคม", 0.95, 0.95, True), ("บ้าน", "บาน", 0.93, 0.93, True), ("insurance", "insurances", 0.85, 0.85, True),
    ("บ้านพัก", "บานพักอาศัย", 0.83, 0.83, False), ("premium", "premiun", 0.8571, 0.8571, True), ("abcd", "abdc", 0.75, None, True), ("kitten", "sitting", 0.6154, None, True),
]


@pytest.mark.parametrize("threshold, at", [(0.6, 2), (0.8, 3)])
def test_ladder(spark, threshold, at):
    side = lambda k: spark.createDataFrame([(i, row[k]) for i, row in enumerate(LADDER)], "pair long, clean string").withColumn("norm", pad_zeros(clean(F.col("clean")))).withColumn("norm_nt", without_tones(F.col("norm"))).withColumn("len", F.length("clean"))
    got = {r.pair: r.score for r in similar.ladder(side(0), side(1), threshold).collect()}
    assert got == {i: pytest.approx(row[at], abs=1e-4) for i, row in enumerate(LADDER) if row[at]}
    if threshold == 0.6:
        reduced = {r.pair for r in similar.ladder(side(0), side(1), threshold, False).collect()}
        assert {i for i, row in enumerate(LADDER) if row[4]} == reduced


def test_ladder_equals_plain_comparison(spark):
    import random

    rng = random.Random(3)
    left, right = ({"".join(rng.choice("abc1") for _ in range(rng.randint(2, 9))) for _ in range(60)} for _ in range(2))
    table = lambda ws: spark.createDataFrame([(1, w) for w in sorted(ws)], "pair long, clean string").withColumn("norm", F.col("clean")).withColumn("norm_nt", F.col("clean")).withColumn("len", F.length("clean"))
    want = {}
    for a in left:
        for b in [a] if a in right else right:
            if a == b:
                want[a, b] = 1.0
            elif min(len(a), len(b)) >= 3 and (a in b or b in a):
                want[a, b] = 0.85
            elif abs(len(a) - len(b)) <= max(0.5 * len(a), 3) and 2 * naive_lcs(a, b) / (len(a) + len(b)) >= 0.6:
                want[a, b] = 2 * naive_lcs(a, b) / (len(a) + len(b))
    got = {(r.a, r.b): r.score for r in similar.ladder(table(left), table(right), 0.6).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_candidates_of_the_ratio(spark):
    """Words meet once each, all that are alike enough do, and of words of like lengths only a part."""
    made = random.Random(8)
    letters = "etaoinshrdlucmfwypvbgk"
    words_ = sorted({"".join(made.choices(letters, range(len(letters), 0, -1), k=made.randint(1, 12))) for _ in range(900)} | {"aaaa", "aaaab", "กขค", "กขคง", "๑๒๓"})
    a, b = words_[::2], words_[1::2]
    table = lambda ws: spark.createDataFrame([(1, w, len(w)) for w in ws], "pair long, clean string, len int")
    for threshold, most in ((0.8, 0.25), (0.6, 0.8)):
        met = [(r.a, r.b) for r in similar.candidates(table(a), table(b), threshold).collect()]
        near = {(x, y) for x in a for y in b if abs(len(x) - len(y)) <= max(0.5 * len(x), 3) and 2 * min(len(x), len(y)) >= threshold * (len(x) + len(y))}
        alike = {(x, y) for x, y in near if 2 * naive_lcs(x, y) >= threshold * (len(x) + len(y)) - 1e-9}
        assert len(met) == len(set(met)) and alike <= set(met) <= near and alike
        plan = similar.candidates(table(a), table(b), threshold)
        joined = table(a).count() and plan.count()
        assert joined == len(met) < most * len(near)


def test_words_are_looked_up_by_their_rarest_trigram(spark):
    table = lambda ws: spark.createDataFrame([(w,) for w in ws], "form string")
    long = [f"{x}ing" for x in ("sing", "ring", "str", "wr", "br")] + ["zaring", "xyz"]
    got = {r.form: r.gram for r in similar.rarest_grams(table(["aring", "ing", "sting", "xyz"]), table(long)).collect()}
    assert got == {"aring": "ari", "ing": "ing", "xyz": "xyz"}  # no word there has "sti"


def test_equal_numbers_equal_plain_comparison(spark):
    made = random.Random(9)
    text = lambda: made.choice(["0", "-0", "0.0", "007", "1,000", "1000.0001", "999.9999", "x", "", "9" * 30, "0.00000000001", f"{made.uniform(-5, 5):.7f}", f"{10 ** made.randint(0, 12) + made.randint(0, 2)}.{made.randint(0, 9)}", str(made.randint(-20, 20))])
    own, other = ([(made.randint(1, 2), text()) for _ in range(300)] for _ in range(2))
    own += [(1, "1000000"), (1, "1000000.5"), (1, "-3"), (1, "2.5000001")]
    other += [(1, "1000000.0"), (1, "1000001.4"), (1, "-3.0"), (1, "2.5"), (1, "3")]
    x, y = spark.createDataFrame(sorted(set(own)), "pair long, a string"), spark.createDataFrame(sorted(set(other)), "pair long, b string")
    want = x.join(y, "pair").filter(numbers.numbers_equal(F.col("a"), F.col("b"))).select("pair", "a", "b").collect()
    got = similar.equal_numbers(x, y, ["pair"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 50
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())


def test_samples_are_cut_before_the_shuffle(spark):
    rows = [(p, i, 0, f"w{i:03d}") for p in (1, 2) for i in range(300)]
    found = spark.createDataFrame(rows, "pair_id long, first_page int, first_pos int, clean string")
    got = compare._samples(found, ["pair_id"])
    assert {r.pair_id: r.sample for r in got.collect()} == dict.fromkeys((1, 2), ", ".join(f"w{i:03d}" for i in range(10)))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops(spark):
    pairs, found, vocab = tables(spark, A, B)
    for df in (compare.diff_words(pairs, found, vocab), compare.same_words(pairs, vocab)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian", plan)


def test_edges(spark):
    pairs, found, vocab = tables(spark, "", "")
    assert compare.diff_words(pairs, found, vocab).count() == 0
    row = compare.same_summary(pairs, found, vocab).first()
    assert (row.matched_doc1, row.match_rate, row.sample_matched) == (0, 0.0, "")


def test_matched_places_are_distinct(spark):
    pairs, found, vocab = tables(spark, "same word same", "same word")
    again = found.union(found.filter("doc_id = 1 and pos = 0"))
    row = compare.same_summary(pairs, again, words.vocabulary(again)).first()
    assert (row.matched_doc1, row.matched_doc2, row.matched_unique_words) == (3, 2, 2)


def test_report_sink(spark, tmp_path):
    pairs, found, vocab = tables(spark, A, B)
    for mode, summary in (("same", compare.same_summary(pairs, found, vocab)), ("diff", compare.diff_summary(pairs, found, vocab))):
        compare.write_report(compare.report_lines(summary, mode), str(tmp_path / mode))
        (one,) = (tmp_path / mode / "pair_id=1").glob("*.txt")
        assert one.read_text().splitlines()[0] == ("Mode: matches" if mode == "same" else "Mode: differences")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9_ \n\t\r\x0b\f  -.กΣßİ"), max_size=25), min_size=1, max_size=4))
def test_lines_cleaned_at_once_give_clean_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = words.occurrences(docs).withColumn("clean", clean(F.col("text")))
    assert sorted(map(tuple, words.cleaned_occurrences(docs).collect())) == sorted(map(tuple, want.collect()))


def test_patterns_see_only_words_that_are_left(spark, monkeypatch):
    """Form labels are looked for in the words that the other document hasn't, not in all words."""
    seen = {}
    monkeypatch.setattr(compare, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    compare.diff_words(*tables(spark, A, B))
    assert 0 < seen["diff-rest"].count() < 28
    of = "RLIKE|rlike|RegExpReplace|regexp_replace"
    plan = seen["diff-rest"]._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(of, plan) and seen["diff-left"].count() <= seen["diff-rest"].count()


def test_words_of_both_sides_are_shuffled_once(spark):
    """The words that only one of two documents has, from one shuffle of all, without the forms that follow from them."""
    pairs, _, vocab = tables(spark, A, B)
    got = compare.alone(pairs, vocab)
    of = lambda t: {w for w in re.sub(r"[^\w ]", "", t).lower().split()}
    assert {(r.doc_id, r.clean) for r in got.collect()} == {(1, w) for w in of(A) - of(B)} | {(2, w) for w in of(B) - of(A)}
    assert {r.doc_id for r in compare.alone(pairs, vocab, True).collect()} == {1}
    assert set(got.columns) == {"pair", *vocab.columns} and {r.clean: r.norm for r in got.collect()}.items() <= {r.clean: r.norm for r in vocab.collect()}.items()
    plan = compare.alone(pairs, written(vocab, "test-vocabulary"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "norm" not in plan.split("Exchange hashpartitioning")[1]


def plan_without_automatic_broadcasts(spark, made):
    """The plan of made(), where Spark sends no table to all tasks of its own accord, as with large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return made()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


def test_few_words_are_looked_up_without_shuffling_the_others(spark):
    """The ladder sends the words looked up to those of the other side, and their trigrams and characters aren't shuffled."""
    _, _, vocab = tables(spark, A, B)
    side = lambda n, name: written(vocab.filter(F.col("doc_id") == n).select(F.lit(1).cast("long").alias("pair"), "clean", "norm", "norm_nt", "len"), name)
    own, other = side(1, "test-own"), side(2, "test-other")
    plan = plan_without_automatic_broadcasts(spark, lambda: similar.ladder(own, other, 0.6))
    assert set(re.findall(r"Exchange hashpartitioning\(pair#\d+L?, (\w+)", plan)) == {"a"} and not re.search("NestedLoop|Cartesian", plan)
    more = other.union(other.withColumn("pair", F.lit(2).cast("long")))
    assert {r.pair for r in similar.of_pairs_in(more, own).collect()} == {1}


def test_matches_are_counted_by_the_words_that_are_left(spark):
    """Neither words nor matches are shuffled to meet: what isn't matched is taken off."""
    pairs, found, vocab = tables(spark, A, B)
    found, vocab = written(found, "test-words"), written(vocab, "test-vocabulary")
    for catalog in (False, True):
        met = written(compare.same_words(pairs, vocab, catalog), "test-met")
        plan = plan_without_automatic_broadcasts(spark, lambda: compare.same_summary(pairs, found, vocab, catalog, met))  # noqa: B023
        assert not re.search(r"Exchange hashpartitioning\((doc_id|pair_id)#\d+L?, clean", plan)
        row = compare.same_summary(pairs, found, vocab, catalog, met).first()
        matched = {n: {r[c] for r in met.collect()} for n, c in ((1, "a"), (2, "b"))}
        want = {n: sum(r.doc_id == n and r.clean in matched[n] for r in words.normalised(found).collect()) for n in (1, 2)}
        assert (row.matched_doc1, row.matched_doc2, row.matched_unique_words) == (want[1], want[2], len(matched[1])) and want[1] >= 8
