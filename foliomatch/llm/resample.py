"""Importance resampling towards a target distribution.

Documents are drawn from a corpus so that what is drawn resembles target texts. A text's features are its runs of one to
three words, hashed into buckets by CRC-32; a bucket's gain is the logarithm of its share in the target over its share
in the corpus, both smoothed by one, in thousandths and rounded down. A document's weight is the sum of the gains of its
features; Gumbel noise from a digest of its id is added, and the highest scores are drawn, which draws without
replacement in proportion to the weights' exponentials.

Features are found by an automaton over the bytes of whole Arrow columns (``bytewords``): a table says what belongs to
words, differences find their bounds, and the CRC registers of all words advance together: over the word, then from
there over a blank and the next word, then once more, which gives the runs of one, two and three words.

Scale: two scans and no shuffle of texts. The first gives a vector of counts a task, which are summed by bucket; the gains
(``BUCKETS`` numbers) go to all tasks of the second. Ranks come from ranges of the scores: rows are shuffled by range,
ranges that begin behind the last rank aren't sorted.

Defined cases: a null or empty text has no features, weight 0 and is too short to be drawn. Words are told apart by bytes,
of any length. Equal scores go by doc_id, null last, then by the number of features; repeated rows are drawn one by one.
A null doc_id has the noise of an empty id. Without a target all gains come from the corpus alone; an empty table gives no rows.
Further columns change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.llm import bytewords as B
from foliomatch.llm.common import table, text_slices, written

BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
SLICE = 1 << 20
#: Rows of a range of scores, about.
RANGE_ROWS = 100_000
#: Digits, small letters and everything beyond ASCII, after capitals have become small.
INSIDE = B.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of one to RUN words; the number of words of each text. texts: large strings, none null."""
    data, bounds = B.buffer(texts)
    found = B.words(INSIDE[data], bounds)
    data = B.LOWER[data]
    lengths = found.ends - found.starts
    state = np.full(len(lengths), B.START)
    at, of = [], []
    for n in range(RUN):
        if n:
            state = B.step(state[:-1], np.uint32(0x20))
        state = B.advance(state, data, found.starts[n:], lengths[n:])
        whole = found.text[n:] == found.text[: len(found.text) - n]
        at.append((~state % np.uint32(buckets))[whole])
        of.append(found.text[n:][whole])
    return np.concatenate(at), np.concatenate(of), np.bincount(found.text, minlength=len(texts))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a column of texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, part in text_slices(batches, SLICE):
            total += np.bincount(features(part, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.selectExpr("0 as turn", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target's share over corpus's, smoothed, rounded down."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in text_slices(batches, SLICE):
            bucket, of, n_words = features(part, buckets)
            n = len(part)
            weight = np.bincount(of, weights=gain[bucket].astype(float), minlength=n).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(np.bincount(of, minlength=n)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``weighed`` with score: the weight and the document's noise. target: a table with a column text."""
    rows = weighed(docs, gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select("text"), buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, n: int, score: str, ties: tuple[str, ...], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with rank: 1, 2, 3 ... for the n highest of `score`, ties by the least of `ties`, null last; null for the others.

    Ranges of the order are counted, and a row's rank is its place in its range behind those before. Only ranges that
    begin before rank n are sorted, and no task sorts more than one of them."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    total = rows.count()
    cut = rows.repartitionByRange(max(1, -(-total // range_rows)), *order).withColumn("_range", F.spark_partition_id())
    cut = written(cut, "ranges")
    size = {r["_range"]: r["count"] for r in cut.groupBy("_range").count().collect()}  # one row a range
    before, ahead = 0, {}
    for at in sorted(size):
        ahead[at] = before
        before += size[at]
    first = cut.sparkSession.createDataFrame(sorted(ahead.items()), "_range int, _before long")
    cut = cut.join(F.broadcast(first), "_range")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.col("_before")
    top = cut.filter(F.col("_before") < n).withColumn("rank", place.cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = cut.filter(F.col("_before") >= n).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it isn't drawn. Drawn are
    `percent` in a hundred, rounded down, of the documents with `least_words` words at least."""
    rows = written(scored(docs, target, seed, buckets), "resample-scores")
    long = rows.filter(F.col("n_words") >= least_words)
    drawn = ranked(long, long.count() * percent // 100, "score", ("doc_id", "n_features"))
    return drawn.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_resample(spark, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def crc_sql(text: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of a string's UTF-8, a byte at a time."""
    table_ = "[" + ", ".join(map(str, B.crc_table().tolist())) + "]"
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, ({table_}::BIGINT[])[xor(c & 255, b) + 1])), 4294967295)"


_low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""WITH texts AS (SELECT false AS goal, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT true, NULL, -row_number() OVER (), text FROM benchmark),
found AS (SELECT goal, r, regexp_extract_all({_low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
one AS (SELECT goal, r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM found),
runs AS (SELECT goal, r, w AS f1, w || ' ' || lead(w) OVER k AS f2, w || ' ' || lead(w) OVER k || ' ' || lead(w, 2) OVER k AS f3 FROM one WINDOW k AS (PARTITION BY r ORDER BY i)),
each AS (SELECT goal, r, f FROM (SELECT goal, r, unnest([f1, f2, f3]) AS f FROM runs) WHERE f IS NOT NULL),
sums AS (SELECT f, {crc_sql('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM each)),
placed AS (SELECT goal, r, b FROM each JOIN sums USING (f)),
counts AS (SELECT b, count(*) FILTER (goal)::DOUBLE AS t, count(*) FILTER (NOT goal)::DOUBLE AS s FROM placed GROUP BY b),
totals AS (SELECT count(*) FILTER (goal)::DOUBLE AS tt, count(*) FILTER (NOT goal)::DOUBLE AS ss FROM placed),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM counts, totals),
weights AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM placed JOIN gain USING (b) WHERE NOT goal GROUP BY r),
scores AS (SELECT doc_id, len(f.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts JOIN found f USING (r) LEFT JOIN weights USING (r) WHERE NOT texts.goal),
places AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM places"""
