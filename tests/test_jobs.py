import pytest
from pyspark.sql import functions as F

from foliomatch.__main__ import main
from foliomatch.operators import compare, words
from foliomatch.plans import jobs, prompts
from foliomatch.sources import documents
from foliomatch.sources.catalog import Catalog

ONE = "Policy alpha beta\nnumber 1,500 gamma\fsecond page delta epsilon zeta"
TWO = "Policy alpha beta\nnumber 1500 omega\fsecond page delta epsilon theta"


def said(prompt, most):
    """A model for the command line."""
    return f"asked {most}: {prompt}" + "\nmore" * 60 + "\ttail of the answer"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.txt").write_text(ONE)
    (tmp_path / "two.1.txt").write_text(TWO)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    return tmp_path


def files(spark, folder, *names):
    return spark.read.format("binaryFile").load([str(folder / n) for n in names])


def test_ingest_files(spark, folder):
    store = Catalog(spark, str(folder / "c"))
    assert jobs.ingest_files(store, files(spark, folder, "one.txt", "two.1.txt", "bad.txt"), jobs.text_pager, custom_id="x") == (2, 1)
    rows = {r.document_id: r for r in store.table().collect()}
    assert sorted(rows) == ["one", "two.1"] and rows["two.1"].filename == "two.1.txt" and rows["one"].page_count == 2
    assert rows["one"].extracted_text.startswith("--- Page 1 (Native) ---\nPolicy alpha")
    assert jobs.ingest_files(store, files(spark, folder, "one.txt"), jobs.text_pager, custom_id="x") == (1, 0)
    assert jobs.ingest_files(store, files(spark, folder, "bad.txt"), jobs.text_pager) == (0, 1)
    assert store.get("x").count() == 1 and store.table().count() == 3


def test_recognised_words_are_scaled_to_points(spark, folder):
    def recogniser(image):
        return [([0.0, 0.0, 300.0, 0.0, 300.0, 150.0, 0.0, 150.0], "seen", 0.9), ([0.0] * 8, "unsure", 0.1)]

    got = jobs.read_files(files(spark, folder, "one.txt"), jobs.text_pager, recogniser)
    assert [(r.page_num, r.x1, r.y1, r.text) for r in got.words.orderBy("page_num").collect()] == [(0, 72.0, 36.0, "seen"), (1, 72.0, 36.0, "seen")]


@pytest.mark.parametrize("mode", ["diff", "same"])
def test_stored_index_compares_as_the_document_itself(spark, folder, mode):
    """The stored word index gives what the same words give when they are at hand."""
    store = Catalog(spark, str(folder / "c"))
    jobs.ingest_files(store, files(spark, folder, "two.1.txt"), jobs.text_pager)
    got = jobs.read_files(files(spark, folder, "one.txt"), jobs.text_pager)
    pairs = spark.createDataFrame([(1, "one", "two.1"), (2, "one", "none")], "pair_id long, doc_id string, document_id string")
    stored = jobs.compare_with_catalog(pairs, got.words, store.table(), mode)
    here = got.words.unionByName(jobs.read_files(files(spark, folder, "two.1.txt"), jobs.text_pager).words)
    plain = jobs.compare_words(pairs.select("pair_id", F.col("doc_id").alias("doc1"), F.col("document_id").alias("doc2")), here, mode, True)
    for a, b in zip(stored, plain, strict=True):
        rows = [sorted(map(str, x.drop("doc_id", "doc1", "doc2").collect())) for x in (a, b)]
        assert rows[0] == rows[1] and rows[0]
    if mode == "diff":
        words_ = {(r.pair_id, r.clean) for r in stored.found.collect()}
        assert {w for p, w in words_ if p == 1} == {"gamma", "zeta"} and len(words_) > 10


def test_asking_about_pairs(spark):
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, " \n"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3), (9, 4, 2), (10, 1, 5)], "pair_id long, doc1 long, doc2 long")
    rows = jobs.asked(pairs, texts, lambda p, n: f"{n} {p}", "same", "en").collect()
    assert [r.pair_id for r in rows] == [7] and rows[0].answer.startswith(f"{prompts.COMPARE_TOKENS} {prompts.COMPARE['en', 'same']}") and "one" in rows[0].answer


def test_text_pages(spark, tmp_path):
    """Pages of text files read in blocks: numbers and rows equal those of the pager, and one file is many tasks."""
    texts = {"a.txt": "\f".join(f"page {i}\n{'x ' * (i % 90)}é" for i in range(3000)), "b.txt": "one", "c.txt": "\fone\f\ftwo\f", "d.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", (tmp_path / "a.txt").stat().st_size // 8 + 1)
    try:
        assert spark.read.option("lineSep", "\f").text(str(tmp_path / "a.txt")).rdd.getNumPartitions() >= 8
        got = sorted((r.path.rpartition("/")[2], r.page_num, r.native_text, r.width, r.height) for r in documents.text_pages(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    found = spark.read.format("binaryFile").load([str(tmp_path / n) for n in "a.txt b.txt c.txt".split()])
    want = sorted((r.path.rpartition("/")[2], r.page_num, r.native_text, r.width, r.height) for r in documents.pages(found, jobs.text_pager).collect())
    assert got == want and len(got) == 3005
    store = Catalog(spark, str(tmp_path / "cat"))
    assert jobs.ingest_texts(store, *[str(tmp_path / n) for n in texts]) == (3, 0)  # an empty file is nothing to Spark's readers
    other = Catalog(spark, str(tmp_path / "other"))
    assert jobs.ingest_files(other, found, jobs.text_pager) == (3, 0)
    key = lambda r: (r.document_id, r.filename, r.extracted_text, r.page_count, r.by_page, r.by_word)
    assert sorted(map(key, store.table().collect())) == sorted(map(key, other.table().collect()))


def test_modes_are_checked(spark):
    with pytest.raises(ValueError):
        jobs.compare_words(None, None, "all")


def test_command_line(spark, folder, capsys):
    at = ["--catalog", str(folder / "c")]
    assert main(["upload", str(folder / "one.txt"), str(folder / "bad.txt"), *at], spark) == 1
    assert main(["compare-stored", str(folder / "two.1.txt"), "one", *at], spark) == 0
    assert main(["compare", str(folder / "one.txt"), str(folder / "two.1.txt"), "--mode", "same", "--report", str(folder / "r")], spark) == 0
    assert main(["compare", str(folder / "one.txt"), str(folder / "bad.txt")], spark) == 1
    assert main(["compare-stored", str(folder / "two.1.txt"), "one", *at, "--model", "tests.test_jobs:said", "--language", "en"], spark) == 0
    assert main(["list", *at], spark) == 0
    assert main(["delete", "one", *at], spark) == 0 and main(["delete", "one", *at], spark) == 1
    out = capsys.readouterr().out
    assert "stored 1, failed 1" in out and "Mode: differences" in out and "Mode: matches" in out and "one.txt" in out and "not found" in out
    assert "asked 36000: Compare these two documents. Report what differs" in out and "\ttail of the answer" not in out
    assert "Mode: matches" in "".join(p.read_text() for p in (folder / "r").rglob("part-*"))


def test_summary_prompts(spark):
    docs = spark.createDataFrame([(1, ONE.replace("\f", "\n")), (2, TWO.replace("\f", "\n"))], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, doc1 long, doc2 long")
    w = words.occurrences(docs)
    for mode, rate in (("diff", "Difference rate: "), ("same", "Match rate: ")):
        s = jobs.compare_words(pairs, w, mode).summary.withColumn("name1", F.lit("one.txt")).withColumn("name2", F.lit("two.txt"))
        s = s.withColumn("text1", F.lit(ONE)).withColumn("text2", F.lit(None).cast("string"))
        en, th = s.select(prompts.explain(mode), prompts.explain(mode, "th")).first()
        assert "one.txt (3 pages, 11 words)" in en and rate in en and "%" in en and ONE in en and "Document 2:\n" not in en
        assert rate in th and "ภาษาไทย" in th and en != th
    assert isinstance(compare.legend(), list)
