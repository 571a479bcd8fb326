import json
import os
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliomatch.functions.labels import significant_clean
from foliomatch.functions.text import clean
from foliomatch.operators import words
from foliomatch.plans import prompts
from foliomatch.plans.queries import QUERIES
from foliomatch.sources import catalog, documents, index, intermediate, workers
from foliomatch.sources.intermediate import removed, shared_dir, written
from foliomatch.streaming import upsert_stream


def row(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, filename string, extracted_text string, word_index string, page_count int")


def test_catalog(spark, tmp_path):
    with pytest.raises(ValueError):
        catalog.Catalog(spark, "")
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    assert store.table().count() == 0
    store.upsert(row(spark, ("a", "a.pdf", "one", None, 1), ("b", "b.pdf", None, None, 2), ("b", "c.pdf", None, None, 3), (None, "n.pdf", "", None, 1)))
    first = {r.document_id: r for r in store.table().collect()}
    assert first.keys() == {"a", "b"} and first["b"].filename == "c.pdf"
    store.upsert(row(spark, ("a", "a2.pdf", "two", None, 1)))
    again = store.get("a").first()
    assert (again.filename, again.id, again.created_at) == ("a2.pdf", first["a"].id, first["a"].created_at)
    assert [r.document_id for r in store.listing().collect()].__len__() == 2
    assert store.extracted_text("a").first().extracted_text == "two" and store.word_index("zz").count() == 0
    assert store.delete("a") and not store.delete("a") and store.table().count() == 1


def test_ingest_and_json(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello world\nhello again", "x.pdf", 2), (2, "", "y.pdf", 1)], "doc_id long, text string, filename string, page_count int")
    w = words.occurrences(docs)
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    texts = docs.select("doc_id", "filename", F.col("text").alias("extracted_text"), "page_count")
    assert catalog.ingest(store, texts, w) == 2
    row = store.get("1").first()
    assert [p.page for p in row.by_page] == [0, 1] and {e.clean: [(x.page, x.pos, x.text) for x in e.places] for e in row.by_word}["hello"] == [(0, 0, "Hello"), (1, 0, "hello")]
    said = json.loads(store.word_index("1").first().word_index)
    assert said["by_page"].keys() == {"0", "1"} and said["by_word"]["hello"][1] == {"page": 1, "word": {"x0": 0.0, "y0": 1.0, "x1": 1.0, "y1": 2.0, "text": "hello", "block_no": 0, "line_no": 0, "word_no": 0}}
    assert store.get("2").first().by_page is None and store.word_index("2").first().word_index is None
    # an index that comes as JSON is stored as columns
    other = catalog.Catalog(spark, str(tmp_path / "d"))
    other.upsert(spark.createDataFrame([("1", json.dumps(said))], "document_id string, word_index string"))
    assert (other.get("1").first().by_page, other.get("1").first().by_word) == (row.by_page, row.by_word)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    row(spark, ("a", "a.pdf", "one", None, 1)).write.parquet(str(source))
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    schema = "document_id string, filename string, extracted_text string, word_index string, page_count int"

    def run():
        q = upsert_stream(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    run()
    assert store.get("a").first().extracted_text == "one" and store.versions() == [1]
    # a restart that has lost the mark of its last batch repeats it: nothing is written again
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    run()
    assert store.versions() == [1]
    row(spark, ("b", "b.pdf", "two", None, 1)).write.mode("append").parquet(str(source))
    run()
    assert store.versions() == [1, 2] and store.table().count() == 2
    assert not store.upsert(row(spark, ("c", "c.pdf", "x", None, 1)), batch=(str(tmp_path / "cp"), 0)) and store.upsert(row(spark, ("c", "c.pdf", "x", None, 1)), batch=("other", 0))


def test_a_change_writes_its_partition_only(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"), parts=8)
    store.upsert(spark.range(200).select(F.col("id").cast("string").alias("document_id"), F.lit("f").alias("filename")))
    files = lambda: {p for p in Path(tmp_path / "c").glob("data-*/*/part-*.parquet")}
    first, state = files(), store.state()
    assert len(state.folders) == 8
    store.upsert(row(spark, ("7", "new.pdf", "x", None, 1)))
    new = files() - first
    assert {p.parent.name for p in new} == {f"part={store._part('7', state)}"} and first <= files()
    assert sum(store.state().folders[p] != state.folders[p] for p in range(8)) == 1
    assert store.table().count() == 200 and store.get("7").first().filename == "new.pdf" and store.get("8").first().filename == "f"
    before = files()
    assert store.delete("8") and {p.parent.name for p in files() - before} == {f"part={store._part('8', state)}"} and store.table().count() == 199
    # a document is read from its partition only
    plan = store.get("9")._jdf.queryExecution().optimizedPlan().toString() + str(store.get("9").inputFiles())
    assert {re.search("part=[0-9]+", f)[0] for f in store.get("9").inputFiles()} == {f"part={store._part('9', state)}"} and "document_id" in plan
    store.clean(1)
    assert store.table().count() == 199 and len(files()) < len(before) + 1 and len({p.parent for p in files()}) == 8
    # the last row of a partition goes with it
    one = catalog.Catalog(spark, str(tmp_path / "d"), parts=4)
    one.upsert(row(spark, ("a", "a.pdf", "one", None, 1)))
    assert one.delete("a") and one.table().count() == 0 and one.state().folders == {}


def test_documents(spark, tmp_path):
    (tmp_path / "P6100283.1.pdf").write_bytes(b"one|two")
    (tmp_path / "bad.pdf").write_bytes(b"!")
    found = documents.files(spark, str(tmp_path))

    def pager(content):
        if content == b"!":
            raise ValueError
        return [{"page_num": i, "width": 10.0, "height": 20.0, "native_text": t.decode(), "image": t} for i, t in enumerate(content.split(b"|"))]

    pages = documents.pages(found, pager)
    assert sorted(r.native_text for r in pages.collect()) == ["one", "two"]
    assert {r.i for r in found.select(documents.document_id(F.col("path")).alias("i")).collect()} == {"P6100283.1", "bad"}
    seen = documents.recognised(pages, lambda image: [((0, 0, 4, 1, 4, 3, 1, 3), image.decode(), p) for p in (0.2, 0.21)])
    scaled = seen.withColumnRenamed("path", "doc_id").withColumn("scale_x", F.lit(2.0)).withColumn("scale_y", F.lit(1.0))
    kept = documents.detection_words(scaled).collect()
    assert len(kept) == 2 and {(k.x0, k.y0, k.x1, k.y1) for k in kept} == {(0.0, 0.0, 8.0, 3.0)}


def test_extracted_text(spark):
    rows = [("d", 1, None, "ocr"), ("d", 0, "native", None), ("d", 2, " \n", None), ("e", 0, None, None)]
    out = documents.extracted_text(spark.createDataFrame(rows, "doc_id string, page_num int, native_text string, ocr_text string"))
    got = {r.doc_id: r.extracted_text for r in out.collect()}
    assert got == {"d": "--- Page 1 (Native) ---\nnative\n--- Page 2 (EasyOCR) ---\nocr\n", "e": ""}


def test_model(spark):
    def model(prompt, n):
        if "bad" in prompt:
            raise RuntimeError("no")
        return f"{len(prompt)}/{n}"

    p = spark.createDataFrame([(1, "good"), (2, "bad")], "key long, prompt string")
    assert {r.key: r.answer for r in prompts.answered(p, model, 5, prompts.Limits(wait=0)).collect()} == {1: "4/5", 2: "Error: no"}


def test_answers_are_asked_for_once(spark, tmp_path):
    """A task that dies half-way, and a job that is begun again, ask only what isn't answered; a client is made once a worker."""
    calls, clients, answers = (str(tmp_path / n) for n in ("calls", "clients", "answers"))

    def client():
        with open(clients, "a") as f:
            f.write(f"{os.getpid()}\n")

        def ask(prompt, n):
            with open(calls, "a") as f:
                f.write(f"{prompt}\n")
            if prompt == "flaky" and open(calls).read().count("flaky") < 2:
                raise ValueError("busy")
            if prompt == "dies" and not os.path.exists(calls + "-died"):
                open(calls + "-died", "w").close()
                os._exit(1)  # the worker is lost, and with it the task
            return f"{prompt}/{n}"

        return ask

    said = [f"p{i % 40}" for i in range(60)] + ["flaky", "dies"]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(99, None)], "key long, prompt string").repartition(1)
    model = workers.Factory("test-client", (client,))
    ask = lambda: {r.key: r.answer for r in prompts.answered_once(p, model, 5, answers, prompts.Limits(2, 3, 0)).collect()}
    want = {i: f"{t}/5" for i, t in enumerate(said)} | {99: None}
    assert spark.sparkContext.master == "local[4]"
    try:
        first = ask()
    except Exception:  # a local session tries a task once; the job is begun again
        first = ask()
    assert first == want and ask() == want
    asked = Counter(open(calls).read().split())
    # what another thread asked as the worker died has no answer yet
    assert asked.pop("flaky") == 2 and asked.pop("dies") == 2 and sum(asked.values()) <= 41 and len(asked) == 40
    made = open(clients).read().split()
    assert len(made) == len(set(made))


def test_recognisers_are_made_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "made")

    def on_gpu():
        raise RuntimeError("no GPU")

    def on_cpu():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda image: [([0.0] * 8, image.decode(), 0.9)]

    images = spark.createDataFrame([("a", i, f"t{i}".encode()) for i in range(200)], "path string, page_num int, image binary").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        seen = documents.recognised(images, workers.Factory("test-reader", (on_gpu, on_cpu)))
        assert sorted(r.text for r in seen.collect()) == sorted(f"t{i}" for i in range(200))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = open(log).read().split()
    assert 1 <= len(made) <= 8 and len(made) == len(set(made))
    with pytest.raises(RuntimeError):
        workers.made(workers.Factory("test-none", (on_gpu,)))


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_catalog_survives_a_killed_write_and_two_writers(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    store.upsert(row(spark, ("a", "a.pdf", "one", None, 1)))
    # a writer that was killed before its folder was complete, and one killed before the rename
    (tmp_path / "c" / "v-00000002").mkdir()
    (tmp_path / "c" / "new-killed").mkdir()
    assert [r.document_id for r in store.table().collect()] == ["a"] and store.versions() == [1]
    with pytest.raises(catalog.Conflict):
        store.upsert(row(spark, ("b", "b.pdf", "two", None, 1)))
    (tmp_path / "c" / "v-00000002").rmdir()
    store.upsert(row(spark, ("b", "b.pdf", "two", None, 1)))
    # two writers that began with version 2: the second fails and nothing of the first is lost
    seen = store.state()
    store.upsert(row(spark, ("c", "c.pdf", "x", None, 1)), state=seen)
    with pytest.raises(catalog.Conflict):
        store.upsert(row(spark, ("d", "d.pdf", "x", None, 1)), state=seen)
    assert sorted(r.document_id for r in store.table().collect()) == ["a", "b", "c"]
    store.clean(1)
    assert store.versions() == [3] and store.table().count() == 3


def test_words_of_a_stored_index(spark):
    w = words.occurrences(spark.createDataFrame([(1, "Hello big world\nagain hello"), (2, "x")], "doc_id long, text string"))
    stored = index.indexed(w)
    assert sorted(map(tuple, index.words_of(stored).collect())) == sorted(map(tuple, w.collect()))
    assert sorted(map(str, index.vocabulary_of(stored).collect())) == sorted(map(str, words.vocabulary(w).collect()))


ODD = (
    (1, 'Hello "big" w\\orld\nagain\x01 hello the\n\n \t a\x0bb  c\r\nc \u00a0 \u2028x'), (2, "x"), (3, ""), (4, None), (5, "ΟΔΟΣ Straße ก่ข้ İstanbul 12.5% --- !!!  x \fzz"), (5, "ΟΔΟΣ more\nlines"),
    (6, "the"), (None, "one two"), (None, "two\nthree"), (7, " \n\t"),
)


def test_indexes_of_texts(spark):
    """Pages and entries by a plain loop over the words; as columns, and as JSON and back."""
    w = words.occurrences(spark.createDataFrame(ODD, "doc_id long, text string"))
    want = {}
    for r in w.withColumn("clean", clean(F.col("text"))).withColumn("counts", significant_clean(F.col("clean"))).orderBy("doc_id", "page_num", "pos", "text").collect():
        if r.doc_id is not None:
            pages, entries = want.setdefault(r.doc_id, ({}, {}))
            place = (r.pos, r.x0, r.y0, r.x1, r.y1, r.text)
            pages.setdefault(r.page_num, []).append(place)
            if r.counts:
                entries.setdefault(r.clean, []).append((r.page_num, *place))
    made = index.indexed(w)
    said = made.select("doc_id", index.to_json(F.col("by_page"), F.col("by_word")).alias("j"))
    back = written(said, "test-json").select("doc_id", index.from_json(F.col("j")).alias("i")).select("doc_id", "i.*")
    for df in (made, back):
        got = {r.doc_id: ({p.page: list(map(tuple, p.words)) for p in r.by_page}, {e.clean: list(map(tuple, e.places)) for e in r.by_word}) for r in df.collect()}
        assert got == want and len(got) == 4 and got[6][1] == {}
    assert all(list(p) == sorted(p) for r in made.collect() for p in ([x.page for x in r.by_page], [e.clean.encode() for e in r.by_word]))
    assert index.indexed(w.limit(0)).count() == 0


def test_json_of_texts(spark):
    """The same JSON as of the columns, letter by letter, without a row for each word."""
    docs = spark.createDataFrame([*ODD, (8, "word_no page word by_page 007 e\u0301 \U0001d54f \u0e33\u0e48 \\u0041 \"\""), (9, "b a b\n" * 300)], "doc_id long, text string")
    made = index.indexed(words.occurrences(docs))
    want = {r.doc_id: r.j for r in made.select("doc_id", index.to_json(F.col("by_page"), F.col("by_word")).alias("j")).collect()}
    said = index.json_of_texts(docs)
    assert {r.doc_id: r.word_index for r in said.collect()} == want and len(want) == 6 and said.count() == 6
    assert index.json_of_texts(docs.limit(0)).count() == 0


def test_index_query_has_no_row_for_each_word(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["index_json_roundtrip"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Generate|Join", plan) and plan.count("Aggregate [") == 1


def test_index_query_shuffles_texts_only(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["index_json_roundtrip"](spark, str(tmp_path))
    rows = out.collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == {1: (4, 4, 12, 4), 2: (1, 0, 1, 0), 5: (2, 8, 12, 1), 6: (1, 0, 1, 0)}
    assert len({r.words_digest for r in rows}) == 4 and all(len(r.index_digest) == 32 for r in rows)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plans = out._jdf.queryExecution()
    assert "from_json" in plans.optimizedPlan().toString() and "StructsToJson" in plans.optimizedPlan().toString()
    exchanges = re.findall("Exchange [a-z]+.*", plans.sparkPlan().toString() + plans.executedPlan().toString())
    assert exchanges and all("REPARTITION_BY_COL" in e for e in exchanges)


@pytest.mark.parametrize("name", ["index_json_roundtrip", "word_index"])
def test_parts_of_texts_are_bounded(spark, tmp_path, monkeypatch, name):
    """Words are grouped in as many parts as the texts' size asks for, not in as many as Spark makes of compressed texts."""
    spark.createDataFrame([(i, "some words and more " * 5) for i in range(100)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    few = QUERIES[name](spark, str(tmp_path))
    monkeypatch.setattr(intermediate, "PART_BYTES", 500)
    many = QUERIES[name](spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 20 and sorted(many.collect()) == sorted(few.collect())


def test_intermediates_are_removed(spark):
    kept = written(spark.range(3), "test-kept")
    folder = Path(re.sub("^file:", "", kept.inputFiles()[0])).parent
    other = folder.parent / "none"
    assert folder.exists() and shared_dir(spark) in str(folder) and not other.exists()
    held = folder.parent.rename(folder.parent.with_name("held"))  # other tests' tables
    try:
        written(spark.range(3), "test-removed")
        removed(spark)
        assert not folder.parent.exists()
    finally:
        held.rename(folder.parent)
    assert kept.count() == 3


def test_page_words(spark):
    native = [(1, 0, i, 1.0 * i, 1.0, i + 1.0, 2.0, f"n{i}", 6.0, 9.0) for i in range(8)] + [(1, 1, 0, 0.0, 0.0, 1.0, 1.0, "few", 6.0, 9.0)]
    native = spark.createDataFrame(native, "doc_id long, page_num int, pos int, x0 double, y0 double, x1 double, y1 double, text string, page_w double, page_h double")
    seen = [(1, p, 0, 0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0, f"o{p}", 0.9, 1.0, 1.0) for p in range(3)]
    seen = spark.createDataFrame(seen, "doc_id long, page_num int, det_no int, tlx double, tly double, trx double, try_ double, brx double, bry double, blx double, bly double, text string, prob double, scale_x double, scale_y double")
    got = sorted((r.page_num, r.text) for r in documents.page_words(native, seen, False).collect())
    assert got == [(0, f"n{i}") for i in range(6)] + [(1, "o1"), (2, "o2")]
    assert sorted(r.text for r in documents.page_words(native, seen, True).collect()) == ["o0", "o1", "o2"]


def test_errors_of_any_kind_cost_one_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a")
    (tmp_path / "b.pdf").write_bytes(b"b")

    def pager(content):
        if content == b"a":
            raise RuntimeError("broken")
        return [{"page_num": 0, "width": 1.0, "height": 1.0, "native_text": "b", "image": b""}]

    assert [r.native_text for r in documents.pages(documents.files(spark, str(tmp_path)), pager).collect()] == ["b"]


def test_texts_of_single_ids_are_not_ranked(spark, tmp_path, monkeypatch):
    """Texts and indexes are shuffled to find the last row of an id only if some id is there more than once."""
    seen, merged = [], catalog.merged
    monkeypatch.setattr(catalog, "merged", lambda *x: seen.append(merged(*x)) or seen[-1])
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    rows = lambda *x: spark.createDataFrame(list(x), "document_id string, filename string, extracted_text string")
    store.upsert(rows(("1", "a", "x"), ("2", "b", "y")))
    store.upsert(rows(("1", "a", "x"), ("1", "c", "z"), (None, "d", "w")))
    assert {(r.document_id, r.extracted_text) for r in store.table().collect()} == {("1", "z"), ("2", "y")}
    assert ["Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen] == [False, True]
