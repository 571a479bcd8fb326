"""Exact similarity join of documents: which different texts share at least so much of their shingles.

A document's set is that of its runs of ``SHINGLE`` words (a text with fewer words is one shingle); two sets are linked if the Jaccard
similarity reaches the threshold. Texts with the same set are one class, named by its smallest doc_id; only one text of a
class is compared.

Prefix filter: two sets that are similar enough share one of the first few shingles of both (``prefix_size``), by any order of all shingles
that is the same everywhere. The order is that of their hashes, but shingles that more than ``HOT`` sets have among
their first ones go last: sets that have such a shingle choose their first ones anew, unless pairs by such shingles are few beside
all first shingles (``few_pairs``), which are paired like rare ones. So prefixes hold rare shingles, as far as a set has any.

First shingles are shuffled once, packed in blocks, of which those in several sets come back (``shared``). Sets that share a rare one
are paired by a join. Sets that share a frequent one all the same (large groups of near copies) are
not paired: the components they form are dealt into parts of ``PART`` sets, and tasks compare part with part by products of their
incidence matrices. These give counts and each set's closest one, so that no task and no table holds all pairs of a group.

Documents with a null doc_id or without words take no part; each text of a doc_id with several ones has its set, and the
document belongs to the class of the smallest text digest. Ties of similarity go to the smaller doc_id."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.operators import shingles
from foliomatch.sources.intermediate import NARROW_ROWS, bounded, written

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
HOT = 64
ROUNDS = 2
#: One of so many hashes shows which sets share frequent ones, before all are looked at.
FEW = 4
PART = 1_000
#: One document of so many tells which shingles seem to be frequent, and how many of these there may be (8 bytes each in a task).
LOOK = 8
LATE = 1 << 20
SHIFT = 41
#: Rows of hashes that a task sends on at once.
ROWS = 50_000
#: First shingles in a task's bucket, some 60 bytes each there.
BUCKET = 1 << 20
#: Columns of an incidence matrix at once.
COLUMNS = 8_192


class Sets(NamedTuple):
    """members: doc_id, class_id for every document; sets: key (a number of its own), rep, n, digest and first, the first hashes in order
    (``prefix_size``), for each class; texts: doc_id, text of all documents, from which a set is made again where it is needed whole; late: the hashes that
    go last in first (h), if any; twice: whether a doc_id has the same text several times."""

    members: DataFrame
    sets: DataFrame
    texts: DataFrame
    k: int
    late: DataFrame | None
    twice: bool

    def whole(self, keys: DataFrame) -> DataFrame:
        """key, rep, n, hashes (all of them, sorted) of some sets. keys: key, distinct."""
        wanted = self.sets.select("key", "rep", "n", "digest").join(bounded(keys, NARROW_ROWS), "key", "left_semi")
        wanted = written(wanted, "join-wanted")
        texts = self.texts.join(bounded(wanted, NARROW_ROWS), F.col("doc_id") == F.col("rep")).filter(F.md5("text") == F.col("digest")).select("key", "rep", "n", "text")
        if self.twice:
            texts = texts.dropDuplicates(["key"])
        return texts.mapInArrow(_whole(self.k), "key long, rep long, n int, hashes array<long>")


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(shingles.sets(batch.column(3), k))], names=["key", "rep", "n", "hashes"])

    return run


def _lists(arrays: Iterable[np.ndarray]) -> pa.Array:
    arrays = [np.empty(0, np.int64), *arrays]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in arrays]), pa.int32()), pa.array(np.concatenate(arrays)))


def _sets(k: int, threshold: Fraction, late: np.ndarray):
    """Over rows (doc_id, text): doc_id, digest, same, n, first of those with words. 128 bits and the size (same) stand for a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(1 << 64 - SHIFT, bool)
        some[late >> SHIFT] = True  # negative ones count from the end
        for batch in batches:
            found, own = [], []
            for i, h in enumerate(shingles.sets(batch.column(1), k)):
                if n := len(h):
                    found.append((batch.column(0)[i].as_py(), hashlib.md5(batch.column(1)[i].as_py().encode()).hexdigest(), f"{n}:{hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest()}", n))
                    # most are told apart by their first bits
                    if len(at := np.flatnonzero(some[h >> SHIFT])):
                        last = np.zeros(n, bool)
                        last[at] = late[np.minimum(np.searchsorted(late, h[at]), len(late) - 1)] == h[at]
                        h = np.concatenate([h[~last], h[last]])
                    own.append(h[: n - math.ceil(n * threshold) + 1])
            if found:
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(own)], names=["rep", "digest", "same", "n", "first"])

    return run


def _hashes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for h in shingles.sets(batch.column(0), k):
                some.append(h[: np.searchsorted(h, 0)])
                if sum(map(len, some)) > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some))], names=["h"])
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some))], names=["h"])

    return run


def likely_frequent(rows: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """h of shingles that seem to be in over `hot` documents (doc_id, text), by those of one document of LOOK: at most LATE, the most
    frequent. Hashes from 0 on are in the later half of a set and hardly ever among its first ones, so they aren't counted. Those found are put last in the order of shingles. Any order finds all links, so that what is missed or too much costs time only."""
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).select("text").mapInArrow(_hashes(k), "h long")
    often = some.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= max(3, hot // (2 * LOOK)))
    return often.orderBy(F.desc("k"), "h").limit(LATE).select("h")


def classes(docs: DataFrame, threshold: Fraction = SIMILARITY, k: int = SHINGLE) -> Sets:
    """Documents (doc_id, text) with their sets. Texts aren't shuffled; copies are one from there on."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = written(likely_frequent(rows, k), "join-late")
    last = np.sort(np.array([r.h for r in late.collect()], np.int64))  # LATE at most
    own = rows.mapInArrow(_sets(k, threshold, last), "rep long, digest string, same string, n int, first array<long>")
    own = written(own.withColumn("key", F.monotonically_increasing_id()), "join-sets")
    named = own.groupBy("same").agg(F.min("rep").alias("class_id"), F.min(F.struct("rep", "digest", "key")).alias("first"), F.count(F.lit(1)).alias("texts"))
    named = written(named, "join-classes")
    sets, several, twice = own.select("key", "rep", "n", "digest", "first"), named.filter("texts > 1").select("same", F.col("first.key").alias("first")), False
    if several.limit(1).count():
        # of several texts with one set all but the first go
        other = own.select("key", "same").join(bounded(several), "same").filter(F.col("key") != F.col("first")).select("key")
        sets = sets.join(bounded(written(other, "join-copies")), "key", "left_anti")
        twice = own.groupBy("rep", "digest").count().filter("count > 1").limit(1).count() > 0
    of = own.select(F.col("rep").alias("doc_id"), "digest", "same").join(named.select("same", "class_id"), "same")
    members = of.groupBy("doc_id").agg(F.min_by("class_id", "digest").alias("class_id"))
    return Sets(members, sets, rows, k, late if len(last) else None, twice)


def prefix_size(n: Column, threshold: Fraction = SIMILARITY) -> Column:
    """How many first shingles of a set of n must be looked at: n - ceil(threshold n) + 1."""
    a, b = threshold.numerator, threshold.denominator
    return (n - F.ceil(n * a / b - 1e-9) + 1).cast("int")


def _first_others(whole: DataFrame, late: DataFrame, size: Column) -> DataFrame:
    """key, n, first from ``Sets.whole``: the first `size` shingles of each set with `late` ones (h, late) last."""
    marked = whole.select("key", "n", F.explode("hashes").alias("h")).join(late, "h", "left")
    ordered = marked.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("late", F.lit(0)).alias("late"), "h"))).alias("o"))
    return ordered.select("key", "n", F.slice(F.transform("o", lambda x: x["h"]), 1, size).alias("first"))


def _frequent(rows: DataFrame, hot: int) -> DataFrame:
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("h")


def _packed(buckets: int, of: int):
    """Over rows (key, n, first): blocks of first shingles by bucket of their hashes, as bytes of whole numbers. Of the hashes one of
    `of` is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(2)
            offsets, h = np.asarray(first.offsets), np.asarray(first.values)
            h, offsets = h[offsets[0] : offsets[-1]], offsets - offsets[0]
            count = np.diff(offsets)
            key, n = (np.repeat(np.asarray(batch.column(i)).astype(np.int64), count) for i in (0, 1))
            place = np.arange(1, len(h) + 1, dtype=np.int64) - np.repeat(offsets[:-1], count)
            if of > 1:
                at = np.flatnonzero(h >> 8 & of - 1 == 0)
                h, key, n, place = h[at], key[at], n[at], place[at]
            bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            low = int(key.min()) if len(key) else 0
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(ends)):
                at = order[ends[b] : ends[b + 1]]
                rows.append((int(b), low, h[at].tobytes(), *(_least_bytes(x[at]) for x in (key - low, n, place))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "low", "h", "key", "n", "place"])

    return run


def _least_bytes(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over whole buckets of ``_packed``: h, key, n, place, k of hashes with several rows, k how many."""
    parts = []
    for batch in batches:
        for r in batch.to_pylist():
            h = np.frombuffer(r["h"], np.int64)
            key, n, place = (_unpacked(r[c], len(h)) for c in ("key", "n", "place"))
            parts.append((h, key + r["low"], n.astype(np.int32), place.astype(np.int32)))
    if not parts:
        return
    h, key, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(h)
    starts = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
    k = np.repeat(*[np.diff(starts, append=len(h))] * 2)
    order, k = order[k > 1], k[k > 1]
    for i in range(0, len(order), ROWS):
        at = order[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at], key[at], n[at], place[at], k[i : i + ROWS].astype(np.int64))], names=["h", "key", "n", "place", "k"])


def shared(first: DataFrame, total: int, of: int = 1) -> DataFrame:
    """h, key, n, place (from 1), k of first shingles (key, n, first) that k > 1 sets have among their first ones. total: how many first
    shingles there are; a task gets about BUCKET of them. Most are in one set only and go no further. of: a power of two; one of so many
    hashes is taken, with all its sets."""
    buckets = max(1, -(-total // (of * BUCKET)))
    blocks = first.select("key", "n", "first").mapInArrow(_packed(buckets, of), "bucket int, low long, h binary, key binary, n binary, place binary")
    return blocks.repartition(buckets, "bucket").mapInArrow(_in_several, "h long, key long, n int, place int, k long")


def few_pairs(frequent: DataFrame, total: int, hot: int) -> bool:
    """Whether the sets that share frequent shingles (h, k: in how many) can be paired like others: these pairs are then fewer than a
    quarter of all first shingles, and none of the shingles is in very many sets."""
    k = F.col("k")
    most, pairs = frequent.agg(F.max("k"), F.sum(k * (k - 1) / 2)).first()
    return most is None or (most <= 16 * hot and pairs <= total / 4)


class Prefixes(NamedTuple):
    """first: key, n, first (hashes in order) of every set; rows: ``shared`` of these; often: h of frequent ones, none of them if the sets
    that share them can be paired like others."""

    first: DataFrame
    rows: DataFrame
    often: DataFrame


def chosen(got: Sets, threshold: Fraction = SIMILARITY, hot: int = HOT) -> Prefixes:
    """Each set's first shingles.

    Sets with a frequent shingle among the first choose these anew, with all that are frequent among all hashes of these sets put
    last; a shared passage's shingles are found together that way. So do all other sets that have one of these among the first: the order
    is then the same in every set, and a shingle's place in it holds. (What was put last before is behind all else in a set: a set with such
    a shingle among its first has all others there too.) As passages and copies show in a part of the hashes, one of FEW is looked at
    before all are. After ROUNDS rounds few sets have a frequent one left, mostly those that have nothing rarer; these are compared in
    blocks, so that stopping there costs no link."""
    size, known = prefix_size(F.col("n"), threshold), got.late
    first = got.sets.select("key", "n", "first")
    total = got.sets.agg(F.sum(size)).first()[0] or 0
    for left in range(ROUNDS, -1, -1):
        of = FEW if left == ROUNDS else 1
        rows = written(shared(first, total, of), "join-rare" if of == 1 else "join-look")
        often = written(rows.filter(F.col("k") > hot).select("h", "k").distinct(), "join-often")
        new = often if known is None else written(often.join(bounded(known), "h", "left_anti"), "join-new")
        few = few_pairs(new, total // of, hot)
        if of == 1 and few:
            often = often.limit(0) if known is None or few_pairs(often, total, hot) else written(often.join(bounded(known), "h", "left_semi"), "join-late-often")
        if of == 1 and (few or not left):
            break
        if few:
            continue
        new = new.select("h")
        having = written(rows.join(bounded(new), "h", "left_semi").select("key").distinct(), "join-having")
        found = _frequent(got.whole(having).select(F.explode("hashes").alias("h")), hot).union(new).distinct()
        found = written(found if known is None else found.join(bounded(known), "h", "left_anti"), "join-found")
        known = written(found if known is None else found.union(known), "join-known")
        again = first.select("key", F.explode("first").alias("h")).join(bounded(found), "h", "left_semi").select("key").distinct()
        again = written(again, "join-again")
        redone = written(_first_others(got.whole(again), bounded(known.withColumn("late", F.lit(1))), size), "join-first")
        first = first.join(bounded(again, NARROW_ROWS), "key", "left_anti").union(redone)
    return Prefixes(first, rows, often.select("h"))


def prefixes(got: Sets, threshold: Fraction = SIMILARITY, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """key, n, h, place (from 1) of each set's first shingles, and h of those that are frequent all the same (``chosen``)."""
    first, _, often = chosen(got, threshold, hot)
    return first.select("key", "n", F.posexplode("first").alias("at", "h")).select("key", "n", "h", (F.col("at") + 1).alias("place")), often


def _labels(edges: DataFrame) -> DataFrame:
    """key, label from edges (key, h): the components, named by their smallest key. A step takes the smallest label over each h and
    follows labels of labels, so that steps are few."""
    now = written(edges.groupBy("key").agg(F.min("key").alias("label")), "join-labels")
    while True:
        over = edges.join(now, "key").groupBy("h").agg(F.min("label").alias("label"))
        near = edges.join(over, "h").groupBy("key").agg(F.min("label").alias("label"))
        far = now.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
        new = near.join(far, F.col("label") == F.col("_key")).select("key", F.least("label", "_label").alias("label"))
        new = written(new, "join-labels")
        if not new.join(now.withColumnRenamed("label", "old"), "key").filter(F.col("label") != F.col("old")).limit(1).count():
            return new
        now = new


FOUND = "rep long, links long, similarity double, closest long"


def _meetings(rare: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b (keys, a < b), na, nb, met (how many first shingles are shared), once each, of the sets that ``met_by`` finds."""
    a, b = threshold.numerator, threshold.denominator
    left, right = (rare.select("h", F.col("key").alias(c), F.col("n").alias(f"n{c}"), (F.col("n") - F.col("place") + 1).alias(f"m{c}")) for c in "ab")
    alike = F.least("na", "nb") * b >= F.greatest("na", "nb") * a
    enough = F.least("ma", "mb") * (a + b) >= (F.col("na") + F.col("nb")) * a
    met = left.join(right, "h").filter((F.col("a") < F.col("b")) & alike)
    return met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"), F.bool_or(enough).alias("enough")).filter("enough").drop("enough")


def met_by(rare: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b (keys, a < b), once each, of the sets that share a first shingle and may be linked (rare: key, n, h, place).

    Linked sets of na and nb shingles share at least t (na + nb) / (1 + t) of them. All of these stand at or behind the first one that
    they share, which is in both prefixes: a shingle with fewer behind it in either set isn't that one, and the pair needn't be met by it."""
    return _meetings(rare, threshold).select("a", "b")


def may_link(met: DataFrame, frequent: DataFrame | None, threshold: Fraction) -> DataFrame:
    """a, b of ``_meetings`` over whole prefixes that can reach the threshold. frequent: key, k, how many first shingles of a set aren't
    among those met by, if there are any.

    Of the two sets one has a prefix that ends no later in the order than the other's: whatever of it they share is in both prefixes,
    and what is behind it is all else that they can share."""
    a, b = threshold.numerator, threshold.denominator
    behind = lambda n: F.col(n) - prefix_size(F.col(n), threshold)
    most = F.col("met") + F.greatest(behind("na"), behind("nb"))
    if frequent is not None:
        for c in "ab":
            met = met.join(bounded(frequent.select(F.col("key").alias(c), F.col("k").alias(f"k{c}"))), c, "left")
        most = most + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    return met.filter(most * (a + b) >= (F.col("na") + F.col("nb")) * a).select("a", "b")


def _pairs(got: Sets, rare: DataFrame, groups: DataFrame | None, frequent: DataFrame | None, threshold: Fraction) -> DataFrame:
    """a, b (doc_ids), similarity of the links between sets that share a rare first shingle (rare: rows of ``shared``) and aren't of one
    group. frequent: as in ``may_link``."""
    a, b = threshold.numerator, threshold.denominator
    met = may_link(_meetings(rare, threshold), frequent, threshold)
    if groups is not None:
        label = lambda c: bounded(groups.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")))
        met = met.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).select("a", "b")
    met = written(met, "join-candidates")
    some = written(got.whole(met.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "join-compared")
    of = lambda c: some.select(F.col("key").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}"))
    both = met.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.filter(F.col("common") * b >= union * a).select(F.col("ra").alias("a"), F.col("rb").alias("b"), (F.col("common") / union).alias("similarity"))


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([len(s) for s in sets])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one side shares with each of the other."""
    (x, xi, _), (y, yi, _) = _incidence(left), _incidence(right)
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    at = lambda v: np.searchsorted(both, v)
    kx, ky = np.isin(x, both), np.isin(y, both)
    px, py, xi, yi = at(x[kx]), at(y[ky]), xi[kx], yi[ky]
    for c in range(0, len(both), COLUMNS):
        m = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for matrix, p, i in ((m[0], px, xi), (m[1], py, yi)):
            here = (p >= c) & (p < c + COLUMNS)
            matrix[i[here], p[here] - c] = 1
        out += m[0] @ m[1].T  # whole numbers, exact below 2^24
    return out.astype(np.int64)


def _block(names: dict[int, list[int]], sets: dict[int, list[np.ndarray]], a: int, b: int) -> Iterator[tuple[int, int, float, int]]:
    """Links, greatest similarity and its set, for each set of a block: between parts 0 and 1, or within part 2."""
    one, two = (0, 1) if sets[0] and sets[1] else (2, 2)
    if not sets[one] or not sets[two]:
        return
    common = common_counts(sets[one], sets[two])
    sizes = [np.array([len(s) for s in sets[i]]) for i in (one, two)]
    union = sizes[0][:, None] + sizes[1][None] - common
    linked = common * b >= union * a
    if one == two:
        np.fill_diagonal(linked, False)
    value = np.where(linked, common / union, -1.0)
    for axis, own, other in ((1, one, two), (0, two, one))[: 1 if one == two else 2]:
        # names are sorted, so the first of equal ones is the smallest
        links, best = linked.sum(axis), value.argmax(axis)
        for i in np.flatnonzero(links):
            at = (i, best[i]) if axis else (best[i], i)
            yield names[own][i], int(links[i]), float(value[at]), names[other][best[i]]


def _compared(threshold: Fraction):
    """Over rows (block, side, rep, hashes) sorted by block, side and rep: FOUND of each block. side: 0 and 1 of two parts, 2 of one."""
    a, b = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            if rows := list(_block(reps, sets, a, b)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["rep", "links", "similarity", "closest"])

        now, reps, sets = None, {0: [], 1: [], 2: []}, {0: [], 1: [], 2: []}
        for batch in batches:
            block, side, rep = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                if block[i] != now:
                    yield from out()
                    now, reps, sets = block[i], {0: [], 1: [], 2: []}, {0: [], 1: [], 2: []}
                reps[side[i]].append(rep[i])
                sets[side[i]].append(np.array(batch.column(3)[i].values))
        yield from out()

    return run


def _grouped(got: Sets, groups: DataFrame, threshold: Fraction, part: int) -> DataFrame:
    """FOUND within groups (key, label), by blocks of two parts."""
    sizes = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    dealt = groups.join(bounded(sizes), "label").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = written(dealt, "join-dealt")
    rows = got.whole(groups.select("key")).join(bounded(dealt), "key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    rows = rows.select(F.concat_ws(":", "label", low, high).alias("block"), side.alias("side"), "rep", "hashes")
    rows = rows.repartition("block").sortWithinPartitions("block", "side", "rep")
    return rows.mapInArrow(_compared(threshold), FOUND)


def similar_documents(docs: DataFrame, threshold: Fraction = SIMILARITY, hot: int = HOT, part: int = PART) -> DataFrame:
    """doc_id, class_id, links, closest, similarity of every document (doc_id, text) with words.

    class_id: the smallest doc_id with the same set; links: how many other classes are linked; closest: the most
    similar of them, by its class_id, and how similar it is (null without links)."""
    got = classes(docs, threshold)
    _, rows, often = chosen(got, threshold, hot)
    rare, groups, frequent = rows, None, None
    if often.limit(1).count():
        rare = rows.join(bounded(often), "h", "left_anti")
        edges = written(rows.join(bounded(often), "h", "left_semi").select("key", "h"), "join-edges")
        groups, frequent = _labels(edges), written(edges.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "join-frequent")
    pairs = _pairs(got, rare, groups, frequent, threshold)
    ways = [F.struct(F.col(x).alias("rep"), F.lit(1).cast("long").alias("links"), "similarity", F.col(y).alias("closest")) for x, y in ("ab", "ba")]
    found = pairs.select(F.explode(F.array(*ways)).alias("x")).select("x.*")
    if groups is not None:
        found = found.union(_grouped(got, groups, threshold, part))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "closest")).alias("best")
    found = found.groupBy("rep").agg(F.sum("links").alias("links"), best)
    out = got.members.join(found, F.col("class_id") == F.col("rep"), "left")
    return out.select("doc_id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.col("best.closest").alias("closest"), (-F.col("best.s")).alias("similarity"))


def closest_pairs(similar: DataFrame) -> DataFrame:
    """pair_id, doc1, doc2 from ``similar_documents``: each class that has links with the one closest to it, two that are closest to each
    other once. pair_id is doc1, the document whose closest one doc2 is."""
    each = written(similar.filter((F.col("doc_id") == F.col("class_id")) & F.col("closest").isNotNull()).select(F.col("doc_id").alias("doc1"), F.col("closest").alias("doc2")), "join-closest")
    back = each.select(F.col("doc1").alias("doc2"), F.col("doc2").alias("doc1")).filter("doc1 > doc2")
    return each.join(back, ["doc1", "doc2"], "left_anti").select(F.col("doc1").alias("pair_id"), "doc1", "doc2")
