"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Each word is predicted from the two words before it and the two after it. The network sums an embedding
per neighbour and place, applies tanh and predicts an id in two steps, its class, then the id among those
of the class. A frequent word has an id of its own; the others share ids, and a word's part of its id's
probability is its part of the id's count in the corpus. So every word has a probability of its own. A document's
score is the sum of the logarithms of these conditional probabilities over all its words.

Words are lower-cased runs of characters other than ASCII white space, known by a 32-bit hash. All are
counted over the whole corpus, in a written table. The number of ids grows with the number of distinct words
(``class_count``), and so does the table of the rarer words' counts (``Vocabulary.counts``): one byte a slot, exact
to 63 and within 5 % above, four slots or more a distinct word up to 2^26 slots (64 MB). Words that share a slot
count together, about one in eight up to that size. A word that was never counted takes half an occurrence.

Training runs in numpy in ``ROUNDS`` passes over all words. Documents are dealt by hash to copies of the network,
one for about ``COPY_WORDS`` words, which train on them in the order of their hashes from a common start, whose
biases are the corpus's frequencies; copies are averaged by their numbers of words, ``FAN`` at a time, and the
average is where the next pass starts. Neither the partitions of the input nor the cluster's size change the result.

Scale: texts are read once for a narrow table of hashes. A copy has a fixed size for a given number of ids, so no
task's memory grows with the corpus; the number of copies does, and the driver gets ``FAN`` of them at most.

Defined cases: null, empty and blank texts have no words, the sum 0 and a null mean. Texts shorter than
the window see boundary marks. Repeated rows count and are scored each; rows with the same id and text go to
one copy, over a hundred of them evenly to all. Ties in frequency go to the smaller hash. An empty table trains nothing and gives no rows. Columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.common import small, table, text_slices, written

CLASSES = 32
WINDOW = (-2, -1, 1, 2)
SIZE = 16
STEP_WORDS, RATE = 8_192, 0.05
COPY_WORDS, ROUNDS, FAN = 2_000_000, 2, 64
SLICE_BYTES, SLICE_WORDS = 1 << 22, 1 << 17
#: Slots of the rarer words' counts, at least and at most, and slots that one row of their table holds.
LEAST_SLOTS, MOST_SLOTS, ROW_SLOTS = 1 << 18, 1 << 26, 1 << 16
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 1 << 19
UNSEEN = 0.5


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts (uint32), one after the other, and each word's text."""
    texts = pc.ascii_lower(texts)
    for ws in ("\t", "\n", "\r", "\x0b", "\x0c"):
        texts = pc.replace_substring(texts, ws, " ")
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    of_word = np.fromiter((xxhash.xxh32_intdigest(w) if w else -1 for w in words), np.int64, len(words))
    found = of_word[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets).astype(np.int64)))
    return found[found >= 0].astype(np.uint32), text_of[found >= 0]


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of a flat array as binary values."""
    raw = flat.tobytes()
    at = (np.concatenate([[0], ends]) * flat.itemsize).tolist()
    return pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), words (hashes of all words) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE_BYTES):
            words, text_of = word_hashes(texts)
            ends = np.cumsum(np.bincount(text_of, minlength=len(texts)))
            h = [xxhash.xxh3_64_intdigest(t.as_buffer() or b"") - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(h, pa.int64()), _binaries(words, ends)], names=["doc_id", "h", "words"])

    return docs.mapInArrow(run, "doc_id long, h long, words binary")


def _word_slices(batches: Iterator[pa.RecordBatch], at: int, kind) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of about SLICE_WORDS words, their words one after the other and each word's row in the part."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(at))).astype(np.int64) // np.dtype(kind).itemsize
        n, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + SLICE_WORDS)))
            words = np.frombuffer(b"".join(batch.column(at).slice(a, b - a).to_pylist()), kind)
            yield batch.slice(a, b - a), words, np.repeat(np.arange(b - a), sizes[a:b])
            a = b


def count_words(rows: DataFrame) -> DataFrame:
    """word, n: counts of all words over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(words), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 15)].astype(np.int64)), pa.array(counts[a : a + (1 << 15)])], names=["word", "n"])

        for _, found, _ in _word_slices(batches, 0, np.uint32):
            some, n = np.unique(found, return_counts=True)
            words, which = np.unique(np.concatenate([words, some]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, n]), len(words)).astype(np.int64)
            if len(words) > HELD_WORDS:
                yield from out()
                words, counts = words[:0], counts[:0]
        yield from out()

    return rows.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_count(types: int) -> int:
    """Classes of ids, and ids of a class, for a number of distinct words: 1024 ids to 4 million words, then doubled
    with every 16 times as many words, to 65,536."""
    return min(256, CLASSES << max(0, math.ceil(math.log(max(types, 1) / (1 << 22), 16))))


def _as_byte(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact to 63, then eight steps for every doubling."""
    n = np.asarray(n, np.float64)
    return np.where(n < 64, n, np.minimum(64 + np.round(8 * np.log2(np.maximum(n, 64) / 64)), 255)).astype(np.uint8)


_LOG_OF_BYTE = np.log(np.concatenate([[UNSEEN], np.arange(1, 64), 64 * 2 ** (np.arange(192) / 8)]))


@dataclass
class Vocabulary:
    """Ids of words. own: the hashes, in order, of words with an id of their own, and their ids; shared: the ids that the
    others share; of_id: the count of every id, falling; counts: of the others' slots, as bytes."""

    classes: int
    own: np.ndarray
    own_id: np.ndarray
    shared: np.ndarray
    of_id: np.ndarray
    counts: np.ndarray

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and logarithms of their parts of their ids."""
        out = self.shared[_share(words, len(self.shared))]
        part = _LOG_OF_BYTE[self.counts[_slot(words, len(self.counts))]] - np.log(np.maximum(self.of_id, 1))[out]
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            mine = self.own[at] == words
            out, part = np.where(mine, self.own_id[at], out), np.where(mine, 0.0, part)
        return out, np.minimum(part, 0.0)


def _share(words: np.ndarray, n: int) -> np.ndarray:
    return ((words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def _slot(words: np.ndarray, n: int) -> np.ndarray:
    return (words & np.uint32(n - 1)).astype(np.int64)


def vocabulary(words: DataFrame) -> tuple[Vocabulary, int]:
    """From the written counts (word, n): the vocabulary and the number of words in the corpus."""
    types, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = class_count(types)
    size, shares = classes * classes, classes * classes // 8
    top = words.orderBy(F.col("n").desc(), "word").limit(size - shares).toPandas()
    own = top["word"].to_numpy(np.int64).astype(np.uint32)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(0, 4 * types - 1).bit_length()))
    rest = words.join(F.broadcast(words.sparkSession.createDataFrame(top[["word"]]) if len(top) else words.select("word").limit(0)), "word", "left_anti")

    def row(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        words_ = part["word"].to_numpy(np.int64).astype(np.uint32)
        n = np.bincount(_slot(words_, slots) % ROW_SLOTS, part["n"], ROW_SLOTS)
        by_share = np.bincount(_share(words_, shares), part["n"], shares)
        return pd.DataFrame({"at": [key[0]], "counts": [_as_byte(n).tobytes()], "shares": [by_share.tobytes()]})

    # a row holds at most ROW_SLOTS slots, so a group has about a quarter of that many words
    at = F.floor(F.pmod("word", F.lit(slots)) / ROW_SLOTS).cast("long")
    counts, by_share = np.zeros(slots, np.uint8), np.zeros(shares)
    for r in rest.groupBy(at.alias("at")).applyInPandas(row, "at long, counts binary, shares binary").toLocalIterator():
        counts[r["at"] * ROW_SLOTS : (r["at"] + 1) * ROW_SLOTS] = np.frombuffer(r["counts"], np.uint8)
        by_share += np.frombuffer(r["shares"])
    of_first = np.concatenate([top["n"].to_numpy(np.int64), np.zeros(size - shares - len(top)), by_share])
    order = np.argsort(-of_first, kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    by = np.argsort(own)
    return Vocabulary(classes, own[by], rank[: len(own)][by], rank[size - shares :], of_first[order], counts), int(total)


class Network:
    """Parameters are one flat array, of which the named arrays are views."""

    def __init__(self, flat: np.ndarray, classes: int = CLASSES) -> None:
        self.flat, self.classes, at = flat, classes, 0
        for name, shape in self.shapes(classes).items():
            setattr(self, name, flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @staticmethod
    def shapes(classes: int) -> dict[str, tuple[int, ...]]:
        return {
            "embed": (len(WINDOW), classes * classes + 1, SIZE), "bias": (SIZE,), "to_class": (SIZE, classes), "class_bias": (classes,),
            "to_word": (classes, SIZE, classes), "word_bias": (classes, classes),
        }

    @classmethod
    def length(cls, classes: int = CLASSES) -> int:
        return sum(math.prod(s) for s in cls.shapes(classes).values())

    @classmethod
    def start(cls, counts: np.ndarray, classes: int = CLASSES, seed: int = 1) -> Network:
        """Small random embeddings; the biases are the frequencies' logarithms."""
        net = cls(np.zeros(cls.length(classes), np.float32), classes)
        rng = np.random.default_rng(seed)
        for name in ("embed", "to_class", "to_word"):
            getattr(net, name)[:] = rng.normal(0, 0.1, cls.shapes(classes)[name])
        p = (counts + 1).reshape(classes, classes) / (counts + 1).sum()
        net.class_bias[:] = np.log(p.sum(1))
        net.word_bias[:] = np.log(p / p.sum(1, keepdims=True))
        return net

    def forward(self, context: np.ndarray, ids: np.ndarray):
        """Logarithms of the conditional probabilities of ids in order, and what backward needs. Matrices have a column a word."""
        hidden = self.embed[0].take(context[0], axis=0)
        for k in range(1, len(WINDOW)):
            hidden += self.embed[k].take(context[k], axis=0)
        hidden += self.bias
        hidden = np.tanh(np.ascontiguousarray(hidden.T))
        classes, words = np.divmod(ids, self.classes)
        bounds = np.searchsorted(classes, np.arange(self.classes + 1))
        of_class, in_class = (np.empty((self.classes, len(ids)), self.flat.dtype) for _ in range(2))
        np.matmul(self.to_class.T, hidden, out=of_class)
        of_class += self.class_bias[:, None]
        for c in range(self.classes):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                in_class[:, a:b] = self.to_word[c].T @ hidden[:, a:b] + self.word_bias[c][:, None]
        score, class_total = _exponentials(of_class, classes)
        of_word, word_total = _exponentials(in_class, words)
        return score + of_word, (hidden, of_class, class_total, in_class, word_total, classes, words, bounds)

    def gradient(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of minus the mean logarithm of the probabilities, by all parameters."""
        _, (hidden, of_class, class_total, in_class, word_total, classes, words, bounds) = self.forward(context, ids)
        columns = np.arange(len(ids))
        of_class /= class_total
        in_class /= word_total
        of_class[classes, columns] -= 1
        in_class[words, columns] -= 1
        grad = Network(np.zeros(len(self.flat), self.flat.dtype), self.classes)
        grad.to_class[:] = hidden @ of_class.T
        grad.class_bias[:] = of_class.sum(1)
        back = self.to_class @ of_class
        for c in range(self.classes):
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                part = in_class[:, a:b]
                grad.to_word[c] = hidden[:, a:b] @ part.T
                grad.word_bias[c] = part.sum(1)
                back[:, a:b] += self.to_word[c] @ part
        hidden *= hidden
        back *= 1 - hidden
        grad.bias[:] = back.sum(1)
        back = back.astype(np.float64)
        for k in range(len(WINDOW)):
            at = context[k].astype(np.intp)
            for j in range(SIZE):
                grad.embed[k, :, j] = np.bincount(at, back[j], self.classes**2 + 1)
        return grad.flat / self.flat.dtype.type(len(ids))

    def step(self, context: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> None:
        """One step of Adagrad on the mean logarithm of the probabilities."""
        g = self.gradient(context, ids)
        squares += g * g
        self.flat -= np.float32(RATE) * g / (np.sqrt(squares) + np.float32(1e-4))


def _exponentials(logits: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the chosen rows' probabilities, column by column, and the columns' totals; logits become exponentials."""
    logits -= logits.max(0)
    score = logits[chosen, np.arange(logits.shape[1])]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    return score - np.log(total), total


def _by_id(ids: np.ndarray) -> np.ndarray:
    """The stable order by id; ids are below 65,536, for which numpy sorts by radix."""
    return np.argsort(ids.astype(np.uint16), kind="stable")


def windows(ids: np.ndarray, text_of: np.ndarray, texts: int, mark: int) -> np.ndarray:
    """The neighbours' ids of every word, one row per place; `mark` beyond a text's ends."""
    reach = max(map(abs, WINDOW))
    padded = np.full(len(ids) + reach * (texts + 1), mark, np.int32)
    at = np.arange(len(ids)) + reach * (text_of + 1)
    padded[at] = ids
    return np.stack([padded[at + w] for w in WINDOW])


def log_likelihoods(net: Network, vocab: Vocabulary, words: np.ndarray, text_of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed conditional log-probabilities of each text."""
    ids, part = vocab.ids(words)
    context = windows(ids, text_of, texts, net.classes**2)
    score = np.zeros(len(ids))
    for at in range(0, len(ids), STEP_WORDS):
        order = at + _by_id(ids[at : at + STEP_WORDS])
        score[order] = net.forward(context[:, order], ids[order])[0]
    return np.bincount(text_of, minlength=texts), np.bincount(text_of, score + part, texts)


class Copy:
    """A copy of the network in training; steps don't depend on how the words come in."""

    def __init__(self, start: np.ndarray, classes: int) -> None:
        self.net, self.squares, self.seen = Network(start.copy(), classes), np.zeros(len(start), np.float32), 0
        self.held: list[np.ndarray] = []
        self.n = 0

    def take(self, ids: np.ndarray, context: np.ndarray) -> None:
        self.held.append(np.concatenate([ids[None], context]))
        self.n += len(ids)
        if self.n >= STEP_WORDS:
            self._steps(self.n - self.n % STEP_WORDS)

    def _steps(self, end: int) -> None:
        rows = np.concatenate(self.held, 1)
        for at in range(0, end, STEP_WORDS):
            part = rows[:, at : min(at + STEP_WORDS, end)]
            part = part[:, _by_id(part[0])]
            self.net.step(part[1:], part[0], self.squares)
        self.seen += end
        self.held, self.n = [rows[:, end:]], self.n - end

    def done(self) -> bytes:
        if self.n:
            self._steps(self.n)
        return self.net.flat.tobytes()


def _pass(rows: DataFrame, start: np.ndarray, classes: int) -> DataFrame:
    """copy, n, net: every copy after one pass over its rows (copy, ids), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, copy = None, None

        def out() -> pa.RecordBatch:
            net = copy.done()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([copy.seen], pa.int64()), pa.array([net])], names=["copy", "n", "net"])

        for part, ids, text_of in _word_slices(batches, 1, np.uint16):
            copies = np.asarray(part.column(0))
            context, ids = windows(ids, text_of, part.num_rows, classes**2), ids.astype(np.int32)
            for which in np.unique(copies).tolist():  # in order, as the rows are
                if which != now:
                    if copy and copy.seen + copy.n:
                        yield out()
                    now, copy = which, Copy(start, classes)
                mine = copies[text_of] == which
                copy.take(ids[mine], context[:, mine])
        if copy and copy.seen + copy.n:
            yield out()

    return rows.mapInArrow(run, "copy long, n long, net binary")


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("copy")
    n = rows["n"].to_numpy(np.int64)
    total = sum(w * np.frombuffer(net, np.float32).astype(np.float64) for w, net in zip(n, rows["net"], strict=True))
    return pd.DataFrame({"copy": [int(rows["copy"].min()) // FAN], "n": [int(n.sum())], "net": [(total / n.sum()).astype(np.float32).tobytes()]})


def deal(rows: DataFrame, copies: int, repeats: int = 100) -> DataFrame:
    """copy, order, words of encoded documents: each row goes to the copy of the network that its hash names. Rows with the
    same id and text of which there are more than `repeats` are dealt out evenly over the copies from there on."""
    order = F.xxhash64("doc_id", "h")
    copy = lambda i: F.pmod(F.pmod(order, F.lit(copies)) + i, F.lit(copies)).alias("copy")
    many = rows.groupBy("doc_id", "h").count().filter(F.col("count") > repeats)
    many = written(many.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "count"), "lm-repeated")
    if not many.count():
        return rows.select(copy(F.lit(0)), order.alias("order"), "words")
    many = small(many)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    one = rows.join(many, same).groupBy("doc_id", "h").agg(F.any_value("words").alias("words"), F.any_value("count").alias("count"))
    some = one.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("count"), F.lit(copies).cast("long")) - 1)))
    more = F.floor((F.col("count") - 1 - F.col("i")) / copies).alias("more")
    # a copy's rows are made behind the shuffle
    some = some.select(copy(F.col("i")), order.alias("order"), "words", more).repartition("copy")
    some = some.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more")))).select("copy", "order", "words")
    return rows.join(many, same, "left_anti").select(copy(F.lit(0)), order.alias("order"), "words").unionByName(some)


def train(rows: DataFrame, rounds: int = ROUNDS, copy_words: int = COPY_WORDS) -> tuple[Network, Vocabulary]:
    """From encoded documents: the averaged network and the vocabulary."""
    vocab, total = vocabulary(written(count_words(rows), "lm-words"))
    classes, net = vocab.classes, Network.start(vocab.of_id, vocab.classes).flat
    copies = max(1, math.ceil(total / copy_words))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, text_of in _word_slices(batches, 2, np.uint32):
            ends = np.cumsum(np.bincount(text_of, minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binaries(vocab.ids(words)[0].astype(np.uint16), ends)], names=["copy", "order", "ids"])

    dealt = deal(rows, copies).mapInArrow(ids, "copy long, order long, ids binary")
    dealt = dealt.repartition(min(2 * copies, 10_000), "copy").sortWithinPartitions("copy", "order", "ids").select("copy", "ids")
    for _ in range(rounds if total else 0):
        made = written(_pass(dealt, net, classes), "lm-copies")
        left = copies
        while left > FAN:
            made = written(made.groupBy(F.floor(F.col("copy") / FAN).alias("at")).applyInPandas(_average, "copy long, n long, net binary"), "lm-copies")
            left = math.ceil(left / FAN)
        net = np.frombuffer(_average(made.toPandas())["net"][0], np.float32).copy()
    return Network(net, classes), vocab


def score(rows: DataFrame, net: Network, vocab: Vocabulary) -> DataFrame:
    """Of encoded documents: doc_id, n_tokens, log_likelihood, mean_log_likelihood."""
    flat, classes = net.flat, net.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(flat, classes)
        for part, words, text_of in _word_slices(batches, 1, np.uint32):
            n, total = log_likelihoods(own, vocab, words, text_of, part.num_rows)
            mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return rows.select("doc_id", "words").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def encode(docs: DataFrame) -> DataFrame:
    """The written table of encoded documents, from doc_id and text."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return written(encoded(docs), "lm-encoded")


def op4_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"))
    return score(rows, *train(rows))
