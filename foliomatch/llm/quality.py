"""Quality classifier by pairwise ranking (Bradley and Terry).

Documents have a score, a linear function of features of their text. For a preferred and a rejected
document the probability of that preference is the logistic function of the difference of scores; the
weights maximise it over preference pairs (label 1 before label 0), with a small ridge. The threshold is
a quantile of the training scores: the one that splits the labels best. A reported score is the
logistic function of the distance to the threshold, shifted so that the threshold is reported as 0.7.

Features (``FEATURES``) describe the text only: shares of kinds of characters, word lengths, repeated
words and lines, sentence ends. Labels, language, source and ids never enter a score.

Scale: the classifier is fitted on at most ``MAX_LABELLED`` labelled documents, those with the smallest
hash of their id; the list of their ids has that bound and is broadcast, so documents aren't shuffled.
Every document is scored where it is read, from its whole text.

Defined cases: null or empty text has all features 0; null labels are passed over; a document with
several labels has their mean, rounded. Without labels of both kinds nothing can be learned: every score
is 0.7, which keeps all documents. Repeated rows are scored each; an empty table gives no rows. Ties: equal texts have
equal scores, and a score at the threshold is accepted. Other columns never enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomatch.llm.common import table

MAX_LABELLED = 20_000
PAIRS_PER_DOCUMENT = 8
CUT = 0.7
FEATURES = (
    "log_words", "letters", "upper", "digits", "blanks", "lines", "marks", "bangs", "bars", "symbols", "ends", "commas", "non_ascii",
    "word_length", "length_spread", "distinct_words", "top_word", "repeated_lines", "repeated_line_share", "line_words", "long_words", "marked_words", "upper_words",
)
_SYMBOLS = b"#$%&*@^~=<>{}[]\\/_+`"


def features(text: bytes) -> list[float]:
    """Numbers that describe a text, by FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = float(len(text))
    share = lambda chars: float(counts[np.frombuffer(chars, np.uint8)].sum()) / n
    words = text.split()
    lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
    if not words:
        return [0.0, 0.0, 0.0, 0.0, 1.0] + [0.0] * (len(FEATURES) - 5)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    line_seen = len(set(lines))
    upper = float(counts[65:91].sum())
    lower = float(counts[97:123].sum())
    m = float(len(words))
    return [
        float(np.log1p(m)), (upper + lower) / n, upper / max(1.0, upper + lower), float(counts[48:58].sum()) / n, share(b" \t"), share(b"\n"),
        share(b"!?\"':;()-"), share(b"!"), share(b"|"), share(_SYMBOLS), share(b".!?") * n / m, share(b",") * n / m, float(counts[128:].sum()) / n,
        float(lengths.mean()), float(lengths.std()), len(seen) / m**0.8, max(seen.values()) / m, 1 - line_seen / max(1, len(lines)),
        float(len(lines) - line_seen) / m, float(np.log1p(m / max(1, len(lines)))), float((lengths > 25).sum()) / m,
        sum(w[-1:] in b"#$%&*!" for w in words) / m, sum(w[:2].isupper() for w in words) / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    trained: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; CUT at the threshold."""
        raw = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -40, 40)))


def untrained() -> Model:
    n = len(FEATURES)
    return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0, False)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1, ridge: float = 1e-3) -> Model:
    """Weights by Newton steps over preference pairs, each document in PAIRS_PER_DOCUMENT of them at least."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return untrained()
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    pairs = np.concatenate([
        np.stack([np.repeat(good, PAIRS_PER_DOCUMENT), rng.choice(bad, len(good) * PAIRS_PER_DOCUMENT)], 1),
        np.stack([rng.choice(good, len(bad) * PAIRS_PER_DOCUMENT), np.repeat(bad, PAIRS_PER_DOCUMENT)], 1),
    ])
    d = z[pairs[:, 0]] - z[pairs[:, 1]]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the opposite preference
        grad = d.T @ p / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    # the quantile of the scores that parts the labels best: mean of both kinds' shares of right answers
    order = np.argsort(raw, kind="stable")
    below_bad = np.cumsum(y[order] == 0) / len(bad)
    below_good = np.cumsum(y[order] == 1) / len(good)
    best = int(np.argmax(below_bad - below_good))
    q = (best + 1) / len(raw)
    at = int(np.clip(round(q * len(raw)), 1, len(raw) - 1)) if len(raw) > 1 else 0
    ranked = raw[order]
    return Model(mean, scale, w, float((ranked[at - 1] + ranked[at]) / 2))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents of which crc32(doc_id as text) mod 4 isn't 2."""
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py() or b"") for t in texts], pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])

    labelled = _texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
    rows = labelled.mapInArrow(run, "doc_id long, x array<double>, y int").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    if not len(rows):
        return untrained()
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 256):
                x = np.array([features(t.as_py() or b"") for t in texts.slice(at, 256)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(model.scores(x))], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier accepts, with their columns; rejected texts don't leave the scan."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            for a in range(0, batch.num_rows, 256):
                x = np.array([features(t.as_py() or b"") for t in texts.slice(a, 256)])
                yield batch.slice(a, 256).filter(pa.array(model.scores(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def classifier(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    return train(table(spark, sf_dir, "documents") if docs is None else docs, table(spark, sf_dir, "labels"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, classifier(spark, sf_dir, docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
