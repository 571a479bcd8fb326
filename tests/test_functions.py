import pytest
from pyspark.sql import functions as F

from foliomatch.functions import dates, labels, numbers, text


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string").select("i", f(F.col("s")).alias("r"))
    return [r.r for r in sorted(rows.collect(), key=lambda r: r.i)]


GOLDEN = [
    (text.clean, ("Policy No. 123", "E-Mail_x", "1,234.50", "พ.ศ."), ["policyno123", "email_x", "123450", "พศ"]),
    (text.pad_zeros, ("1มกราคม2567", "มกราคม5", "ก1ข2ค", "๑๒"), ["01มกราคม2567", "มกราคม05", "ก01ข2ค", "0๑00๒"]),
    (text.without_tones, ("ก่ข้ค๊ง๋",), ["กขคง"]),
    (numbers.smart_number, ("007", "000", "bm007", "00bm", "๑๒", "1_000", "1234567.5", "5.0", "-0", "1" * 40), ["7", "0", "bm007", "bm", "12", "1000", "1.23457e+06", "5", "0", "1" * 40]),
    (numbers.smart_number, ("0.1", "0.00012345678", "0.00001", "123456.7", "2.50"), ["0.1", "0.000123457", "1e-05", "123457", "2.5"]),
    (dates.extract_dates, ("1 มกราคม 2567 กุมภาพันธ์ 2568 5/6/2567", ""), [["01-01-2567", "67-02-2568", "05-06-2567"], []]),
    (dates.extract_times, ("12.30 น. 99.10 24:99 1,234.50", "x"), [["12:30", "24:99"], []]),
    (labels.form_label, ("sometimes", "classic", "รวม", "รวมกัน", "numbering", ""), [True, True, True, False, True, False]),
    (labels.significant, ("The", "a", "ok", "นาย", "x"), [False, False, True, False, False]),
    (dates.date_word, ("มกราคม", "2567", "15", "32", "5มค", "31/12/2567", "word"), [True, True, True, False, True, True, False]),
]


@pytest.mark.parametrize("f, inputs, expected", GOLDEN)
def test_golden(spark, f, inputs, expected):
    assert values(spark, f, *inputs) == expected


def test_nulls_stay_null(spark):
    assert values(spark, text.clean, None) == [None]
    assert values(spark, numbers.smart_number, None) == [None]


def test_gate_and_match(spark):
    rows = [([], []), ([], ["01-01-2567"]), (["a", "b"], ["b", "a"]), (["a"], ["b"])]
    out = spark.createDataFrame(rows, "a array<string>, b array<string>").select(dates.lists_same(F.col("a"), F.col("b")).alias("same"), dates.lists_match(F.col("a"), F.col("b")).alias("match")).collect()
    assert [r.same for r in out] == [True, True, True, False]
    assert [r.match for r in out] == [None, False, True, False]
