"""Spelling variants: words that differ from a more frequent one by one character are grouped with it.

Words are counted over the whole corpus. Two words are near if exactly one inserted, deleted or replaced character
turns one into the other. A word's form is its most frequent near word, if that is at least twice as frequent; its
root is where the forms lead in the end.

Near words are found in two minimal acyclic automata, one of the words and one of the words read backwards, whose
states know how many words they lead to, so that a path spells a word and numbers it (perfect hashing). A word is cut in
half. If the error is in its second half, its first half is followed exactly in the forward automaton and its second half
completed with one error; if it is in the first half, the backward automaton does the same from the other end. Words
that both ways find are counted the first way only.

Scale: counting is a scan whose tasks send each slice's distinct words, summed by word. Words are then cut into ranges of
about ``SHARD`` of them, by their order and by their backward order; an automaton holds one range. A word asks the
ranges that hold words with its half as a beginning: mostly one, and as many as there are if very many words share it, so no
range grows with its beginning's frequency. A range answers with a count and its best word, never with pairs. Roots are found by
doubling: a step follows twice as many forms as the one before, and there are at most log2 of the largest count.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count each.
Equal counts: the smallest near word in code-point order is the form. Words of any length take part. An empty table gives
no rows; further columns change nothing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomatch.llm import bytewords as B
from foliomatch.llm.common import table, text_slices, written
from foliomatch.llm.resample import crc_sql

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many occurrences loses a character.
DAMAGED = 97
#: A form is at least so many times as frequent.
TIMES = 2
SLICE = 4 << 20
#: Words, and characters, of an automaton, about.
SHARD = 32_768
SHARD_CHARS = 1 << 20
#: ASCII letters, and the first byte of U+00C0 to U+00FF.
INSIDE = B.byte_class((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC3))


def _damaged(word: str, at: int) -> str:
    at %= len(word)
    return word[:at] + word[at + 1 :]


def slice_words(ids: pa.Array, texts: pa.Array, damaged: int = DAMAGED, least: int = LEAST_LENGTH) -> pa.Array:
    """The words of `least` characters at least that texts (large strings, none null) have after damage, repeated ones repeated.

    damaged: an occurrence loses a character if this divides the CRC-32 of its text's id, a colon and the word."""
    data, bounds = B.buffer(texts)
    inside = INSIDE[data]
    inside[1:] |= data[:-1] == 0xC3  # its second byte
    data = B.LOWER[data]
    found = B.words(inside, bounds)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    size = found.ends - found.starts
    crc = ~B.advance(~heads[found.text], data, found.starts, size)
    two = np.append(0, np.cumsum(data == 0xC3))
    size -= two[found.ends] - two[found.starts]
    hit = crc % np.uint32(damaged) == 0
    kept = (size >= least) & ~hit
    whole = B.strings(data, found.starts[kept], found.ends[kept])
    hit &= size > least
    lost = B.strings(data, found.starts[hit], found.ends[hit]).to_pylist()
    lost = [_damaged(w, c) for w, c in zip(lost, crc[hit].tolist(), strict=True)]
    return pa.concat_arrays([whole, pa.array(lost, pa.large_string())])


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, SLICE):
            counts = pc.value_counts(slice_words(ids, texts))
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    texts = docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; words have numbers in that order.

    A state's edges lead by a character to a state, with how many words of the state come before those."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list[tuple[str, int]]] = [[]]  # of the last word: edges of its states that are settled
        final = [False]
        last = ""

        def settle(depth: int) -> int:
            state = 0
            while len(path) > depth:
                own = (final.pop(), tuple(path.pop()))
                state = known.get(own, -1)
                if state < 0:
                    state = known[own] = len(self.edges)
                    before, out = int(own[0]), {}
                    for c, to in own[1]:
                        out[c] = (to, before)
                        before += self.sizes[to]
                    self.edges.append(out)
                    self.ends.append(own[0])
                    self.sizes.append(before)
                if path:
                    path[-1].append((last[len(path) - 1], state))
            return state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            settle(same + 1)
            path.extend([] for _ in range(len(word) - same))
            final.extend([False] * (len(word) - same))
            final[-1] = True
            last = word
        self.start = settle(0)

    def _walk(self, state: int, text: str, at: int, number: int) -> tuple[int, int]:
        """State and number after text[at:]; state -1 if it leads nowhere."""
        edges = self.edges
        for i in range(at, len(text)):
            to = edges[state].get(text[i])
            if to is None:
                return -1, 0
            state, number = to[0], number + to[1]
        return state, number

    def with_one_error(self, text: str, exact: int) -> set[int]:
        """Numbers of the words that text becomes by one error behind its first `exact` characters. Of errors with the same result, as
        in a run of equal characters, the last one is tried only."""
        state, number = self._walk(self.start, text[:exact], 0, 0)
        found: set[int] = set()
        if state < 0:
            return found
        edges, ends, n = self.edges, self.ends, len(text)

        def complete(state: int, at: int, number: int) -> None:
            state, number = self._walk(state, text, at, number)
            if state >= 0 and ends[state]:
                found.add(number)

        for i in range(exact, n + 1):
            here = text[i] if i < n else ""
            if here and text[i + 1 : i + 2] != here:
                complete(state, i + 1, number)
            for c, (to, before) in edges[state].items():
                if c != here:
                    complete(to, i, number + before)
                    if here:
                        complete(to, i + 1, number + before)
            to = edges[state].get(here)
            if to is None:
                break
            state, number = to[0], number + to[1]
        return found


def _answers(words: list[str], counts: list[int], asked: list[str], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """Words asked with how many near words they have among words, the largest count of these and the smallest such word.
    backward: both are read backwards, and what the forward search finds as well is left to it."""
    automaton = Automaton(words)
    for word in asked:
        half = len(word) // 2
        near = automaton.with_one_error(word, len(word) - half if backward else half)
        own = word[::-1] if backward else word
        names = {i: words[i][::-1] if backward else words[i] for i in near}
        if backward:
            names = {i: w for i, w in names.items() if not w.startswith(own[:half])}
        if names:
            best = min((-counts[i], w) for i, w in names.items())
            yield own, len(names), -best[0], best[1]


def _search(backward: bool):
    """Over rows (shard, role, word, n) sorted by shard, role and word: answers to the words asked (role 1) among the shard's (role 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: list[str], counts: list[int], asked: list[str]) -> Iterator[pa.RecordBatch]:
            if rows := list(_answers(words, counts, asked, backward)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["word", "n_near", "form_n", "form"])

        now, words, counts, asked = None, [], [], []
        for batch in batches:
            for shard, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    yield from out(words, counts, asked)
                    now, words, counts, asked = shard, [], [], []
                if role:
                    asked.append(word)
                else:
                    words.append(word)
                    counts.append(n)
        yield from out(words, counts, asked)

    return run


def _asked(firsts: list[str], shards: list[int], backward: bool):
    """Over rows (word): the shards that may hold words which begin with its exact half. firsts: the shards' first words, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str]] = []
            for word in batch.column(0).to_pylist():
                half = len(word) // 2
                head = word[: len(word) - half if backward else half]
                low = max(0, bisect_right(firsts, head) - 1)
                high = bisect_left(firsts, head + "\U0010ffff", low)
                out += [(shards[i], word) for i in range(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([w for _, w in out], pa.string())], names=["shard", "word"])

    return run


def _one_way(counted: DataFrame, backward: bool, shards: int) -> DataFrame:
    """word, n_near, form_n, form: the answers of each shard in one direction."""
    own = counted.select((F.reverse("word") if backward else F.col("word")).alias("word"), "n")
    cut = own.repartitionByRange(shards, "word").withColumn("shard", F.spark_partition_id())
    cut = written(cut, "spelling-ranges")
    bounds = sorted((r["first"], r["shard"]) for r in cut.groupBy("shard").agg(F.min("word").alias("first")).collect())  # one row a shard
    asks = cut.select("word").mapInArrow(_asked([f for f, _ in bounds], [s for _, s in bounds], backward), "shard int, word string")
    rows = cut.select("shard", F.lit(0).alias("role"), "word", "n").unionByName(asks.select("shard", F.lit(1).alias("role"), "word", F.lit(0).cast("long").alias("n")))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "role", "word")
    return rows.mapInArrow(_search(backward), "word string, n_near long, form_n long, form string")


def near_words(counted: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, form_n, form of the words of counted (word, n) that have near words: how many, the largest count among
    them and the smallest such word."""
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size["n"] // shard), -(-size["chars"] // (SHARD_CHARS * shard // SHARD or 1)))
    both = _one_way(counted, False, shards).unionByName(_one_way(counted, True, shards))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (not null): where forms lead in the end. Forms must have no cycle."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        then = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        new = now.join(then, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        new = written(new, "spelling-roots")
        now = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = written(word_counts(docs, least_count), "spelling-counts")
    near = written(near_words(counted, shard), "spelling-near")
    enough = F.col("form_n") >= times * F.col("n")
    out = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    out = written(out, "spelling-forms")
    out = out.join(roots(out.filter(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_runs = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Near words are found here by their deletions: one word is a deletion of the other, or both have the same one at the same place.
OP13_SQL = rf"""WITH RECURSIVE found AS (SELECT doc_id, {_runs} AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
sums AS (SELECT w, k, {crc_sql("(doc_id || ':' || w)")} AS h FROM found),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(k)::BIGINT AS n FROM sums GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
cuts AS (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT DISTINCT w.word, c.word FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT DISTINCT a.word, b.word FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
best AS (SELECT a, count(*)::BIGINT AS n_near, min((-n, b)) AS x FROM near JOIN words ON word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x[1] >= 2 * n THEN x[2] END AS form, CASE WHEN -x[1] >= 2 * n THEN -x[1] END::BIGINT AS form_n FROM words LEFT JOIN best ON a = word),
up AS (SELECT word, coalesce(form, word) AS top_ FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.top_ WHERE f.form IS NOT NULL),
last AS (SELECT up.word, up.top_ FROM up JOIN forms f ON f.word = up.top_ WHERE f.form IS NULL)
SELECT word, form, top_ AS root, n, n_near, form_n FROM forms JOIN last USING (word)"""
