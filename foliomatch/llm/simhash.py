"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set where over half of its shingles' hashes have it (XXH64, seed 42;
further groups of 64 bits come from mixing the same hash anew). Documents are linked if their
fingerprints differ in at most ``radius`` bits; groups are the connected components of the links.

Candidates share blocks of bits: the bits are cut into m blocks, and fingerprints within the radius agree in
m - radius of them, so every choice of that many blocks is a key and no link can be missed. m rises with the
number of fingerprints (``block_count``), which keeps buckets, and so comparisons per document, of one size.
Rows of one key are a bucket: its fingerprints are stored as vertical bit planes, 64 to a word, so one
XOR compares a bit of one fingerprint with 64 others. Distances are kept in carry-save counters, also
bit by bit; words in which every lane has exceeded the radius are abandoned.

Scale: each document is read once for its fingerprint (bounded memory for any length), after that all
tables are narrow. Copies fall together before any comparison. A bucket over ``BUCKET`` rows is dealt out in
parts (``bucket_links``): first each part is compared with itself; members outside the largest group so found
are then compared with all parts. No link is lost, and a large group of copies costs about its size, not its
square. A task reports a spanning forest of its links, not the links, so its output is at most its input.
Components are found by passing on least labels with pointer jumping, on tables written to the shared folder.

The pipeline's near copies (``close_groups``) have a Jaccard similarity of 0.8 or more of their sets of five-word
shingles. Buckets are documents that share one of their rarest shingles (prefix filter: no link can be missed);
there, bit-sliced comparison of 128-bit fingerprints of the sets proposes, with a radius over five standard
deviations wide of the distance at 0.8; then whole sets are compared exactly within the groups so proposed.

Defined cases: null, empty and blank texts have fingerprint 0, linked like any other. Fewer words than
a shingle: the whole text is the one shingle. A null doc_id can't name a group; such a row gets the
group of its fingerprint, if that has another row, else null. Repeated rows are copies. Ties in a bit (set in
exactly half) are 0. An empty table gives no rows. Other columns are ignored or returned as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.llm.common import BROADCAST_ROWS, small, table, unused, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Near copies: words of a shingle, groups of 64 bits of a fingerprint, and radius. At 0.8 the sets' cosine is 8/9, so
#: 128 bits differ in 128 arccos(8/9) / pi = 19 bits on average, in 24 for the smallest sets, give or take 4.4.
NEAR_SHINGLE, NEAR_PRINTS, NEAR_RADIUS = 5, 2, 48
BUCKET = 16_384
#: Rows that a bucket of one key holds on average, at most.
KEY_ROWS = 64
#: Least and most slots of the counts that order shingles by rarity, and shingles of a group that one task compares.
SLOTS, MOST_SLOTS, TASK_SHINGLES = 1 << 18, 1 << 22, 4_000_000
CHUNK_ROWS, CHUNK_PAIRS = 32_768, 32_768
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of k words, repeats included."""
    words = text.lower().split()
    n = len(words)
    h = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([h(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The hashes' i-th further 64 bits (a finaliser of multiplications and shifts); i = 0: themselves."""
    if not i:
        return h
    h = h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, k: int = SHINGLE, prints: int = 1, distinct: bool = False) -> list[int]:
    """Groups of 64 bits; distinct: of the set of shingles instead of all of them."""
    hashes = shingle_hashes(text, k)
    return print_of(np.unique(hashes) if distinct else hashes, prints)


def print_of(hashes: np.ndarray, prints: int) -> list[int]:
    """The fingerprint of hashes."""
    n = len(hashes)
    if not n:
        return [0] * prints
    out = []
    for i in range(prints):
        count = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = np.ascontiguousarray(mixed(hashes[at : at + (1 << 16)], i))
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, prints: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id and p0, p1 ...: the fingerprint's groups of 64 bits as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 512):
                rows = np.array([fingerprint(t.as_py() or b"", shingle, prints, distinct) for t in texts.slice(at, 512)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *[pa.array(rows[:, i]) for i in range(prints)]], names=["doc_id", *_names(prints)])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{p} long" for p in _names(prints)))


def _names(prints: int) -> list[str]:
    return [f"p{i}" for i in range(prints)]


def block_count(n: int, radius: int = RADIUS, bits: int = 64) -> int:
    """How many blocks to cut the bits into, so that buckets of n evenly spread fingerprints stay small."""
    m = radius + 1
    while m < 2 * radius and n / 2 ** (bits * (m - radius) / m) > KEY_ROWS:
        m += 1
    return m


def exact_blocks(radius: int, bits: int = 64, m: int | None = None) -> list[int]:
    """Masks of the bits: fingerprints within the radius agree under one of them at least. The bits are cut into m
    blocks (least: radius + 1); each mask covers m - radius of them."""
    m = m or radius + 1
    cut = [bits * i // m for i in range(m + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cut)]
    return [sum(some) for some in itertools.combinations(block, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is over the radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def sliced_links(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) of rows of the same bucket that differ in at most radius bits.

    prints: one row of uint64 per fingerprint; buckets are the ranges from starts to ends."""
    n, groups = prints.shape
    sizes = ends - starts
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    in_bucket = np.repeat(np.arange(len(sizes)), sizes)
    row = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]) if len(sizes) else np.zeros(0, np.int64)
    place = row - starts[in_bucket]
    word_of = first_word[in_bucket] + place // 64
    lane = (place % 64).astype(np.uint64)
    word_starts = np.flatnonzero(place % 64 == 0)
    word_row = row[word_starts]
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, word_starts) if len(row) else np.zeros(0, np.uint64)
    own = prints[row]
    planes = [
        np.bitwise_or.reduceat((own[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)) << lane, word_starts) if len(row) else valid
        for p in range(64 * groups)
    ]
    ahead = first_word[in_bucket] + words[in_bucket] - word_of
    width = max(1, radius.bit_length())
    bounds = np.concatenate([[0], np.cumsum(ahead)])
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_PAIRS, "right")) - 1)
        count = ahead[at:end]
        q = np.repeat(np.arange(at, end), count)
        w = word_of[q] + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        at = end
        counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
        over = ~valid[w]
        for p in range(64 * groups):
            carry = planes[p][w] ^ (np.uint64(0) - (own[q, p // 64] >> np.uint64(p % 64) & np.uint64(1)))
            for c in counters:
                nxt = c & carry
                c ^= carry
                carry = nxt
            over |= carry
            if p % 8 == 7 and p + 1 > radius:
                over |= _over(counters, radius)
                live = over != _ONES
                if live.sum() < 0.8 * len(live):
                    q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
                    if not len(q):
                        break
        if not len(q):
            continue
        near = np.unpackbits((~(over | _over(counters, radius))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(near)
        i, j = row[q[pair]], word_row[w[pair]] + bit
        keep = i < j
        if keep.any():
            yield i[keep], j[keep]


class Forest:
    """Least members of the groups of places that links join."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            self.parent[high] = self.find(high)


def _runs(groups: int, radius: int):
    """Over rows sorted by bucket (band, key, i, j, rep, p0 ...): rep and the least rep of its group there."""

    def links(rep: np.ndarray, key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
        many = ends - starts > 1
        forest = Forest(len(rep))
        for i, j in sliced_links(prints, starts[many], ends[many], radius):
            forest.join(i, j)
        root = forest.find(np.arange(len(rep)))
        joined = np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[joined]), pa.array(rep[root[joined]])], names=["a", "b"]) if len(joined) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([np.asarray(c) for c in batch.columns], 1))
            n += batch.num_rows
            if n < CHUNK_ROWS:
                continue
            rows = np.concatenate(held)
            last = rows[-1, :4]
            whole = int(np.flatnonzero((rows[:, :4] != last).any(1))[-1]) + 1 if (rows[:, :4] != last).any() else 0
            if whole:
                done = links(rows[:whole, 4], rows[:whole, :4], rows[:whole, 5:].view(np.uint64))
                if done:
                    yield done
            held, n = [rows[whole:]], len(rows) - whole
        if n:
            rows = np.concatenate(held)
            done = links(rows[:, 4], rows[:, :4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64))
            if done:
                yield done

    return run


def _met(rows: DataFrame, prints: int, radius: int) -> DataFrame:
    """Links of a forest of every bucket (band, key, i, j) of rows (band, key, i, j, rep, p0 ...)."""
    ordered = rows.select("band", "key", "i", "j", "rep", *_names(prints))
    ordered = ordered.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return ordered.mapInArrow(_runs(prints, radius), "a long, b long")


def bucket_links(rows: DataFrame, large: DataFrame, prints: int, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join the same groups as all links within the buckets of rows (band, key, rep, p0 ...) do.

    large: band, key, n of the buckets with more than `bucket` rows; they are dealt out in parts of half that."""
    zero = F.lit(0).cast("long")
    large = written(large.select("band", "key", F.ceil(F.col("n") / (bucket / 2)).cast("long").alias("parts")), "simhash-large")
    if not large.count():
        return _met(rows.withColumn("i", zero).withColumn("j", zero), prints, radius)
    dealt = rows.join(small(large), ["band", "key"], "left")
    dealt = dealt.withColumn("i", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), zero)).withColumn("j", zero)
    first = written(_met(dealt, prints, radius), "simhash-first")
    labels = components(first).toDF("rep", "label")
    # members of a large bucket outside its largest group so far meet all its parts
    hot = dealt.filter(F.col("parts").isNotNull()).drop("j").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    hot = written(hot, "simhash-hot")
    main = hot.groupBy("band", "key", "label").count().groupBy("band", "key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    # every bucket left has one row here, and there are at most rows / bucket of them
    main = written(main, "simhash-main")
    apart = hot.join(small(main), ["band", "key"]).filter(F.col("label") != F.col("main"))
    shares = apart.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / (bucket / 2)).cast("long").alias("shares"))
    shares = written(shares, "simhash-shares")
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    asked = hot.join(small(shares), ["band", "key"]).withColumn("j", each("shares"))
    asking = apart.join(small(shares), ["band", "key"]).withColumn("j", F.pmod(F.xxhash64(F.col("rep"), F.lit(1)), F.col("shares")))
    asking = asking.drop("i").withColumn("i", each("parts"))
    columns = ["band", "key", "i", "j", "rep", *_names(prints)]
    second = _met(asked.select(*columns).union(asking.select(*columns)), prints, radius)
    return first.union(second)


def linked(reps: DataFrame, prints: int, radius: int, blocks: list[int], bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join the same groups as all links between the fingerprints do."""
    names = _names(prints)
    full = (1 << 64) - 1

    def key(mask: int) -> Column:
        under = [F.col(p).bitwiseAND(F.lit(_signed(mask >> 64 * i & full))) for i, p in enumerate(names)]
        return under[0] if len(under) == 1 else F.xxhash64(*under)

    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("band"), key(m).alias("key")) for i, m in enumerate(blocks)])
    rows = reps.filter(F.col("rep").isNotNull()).select("rep", *names, F.explode(keys).alias("k")).select("k.band", "k.key", "rep", *names)
    return bucket_links(rows, rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket), prints, radius, bucket)


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least member of the group of every end of a link."""
    links = written(links.distinct(), "simhash-links")
    both = links.union(links.select("b", "a")).toDF("v", "u")
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "simhash-labels")
    while True:
        heard = both.join(labels.toDF("u", "l"), "u").groupBy("v").agg(F.min("l").alias("heard"))
        passed = labels.join(heard, "v").select("v", "label", F.least("label", "heard").alias("next"))
        jump = labels.toDF("next", "far")
        moved = written(passed.join(jump, "next").select("v", "label", F.least("next", "far").alias("next")), "simhash-labels")
        changed = moved.filter(F.col("label") != F.col("next")).limit(1).count()
        labels = moved.select("v", F.col("next").alias("label"))
        if not changed:
            return labels


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, prints: int = 1, blocks: list[int] | None = None, bucket: int = BUCKET, distinct: bool = False) -> DataFrame:
    """doc_id, p0 ..., component_id for every document."""
    names = _names(prints)
    made = written(fingerprints(docs, shingle, prints, distinct), "simhash-prints")
    reps = written(made.groupBy(*names).agg(F.min("doc_id").alias("rep")), "simhash-reps")
    blocks = blocks or exact_blocks(radius, 64 * prints, block_count(reps.count(), radius, 64 * prints))
    labels = components(linked(reps, prints, radius, blocks, bucket))
    named = reps.join(labels, reps["rep"] == labels["v"], "left").select(*names, F.coalesce("label", "rep").alias("component_id"))
    return made.join(named, names).select("doc_id", *names, "component_id")


def prefix_length(n: int) -> int:
    """Sets of which 4/5 is common share one of this many first members in any common order."""
    return n - (4 * n + 4) // 5 + 1


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets (distinct values each) of 4/5 at least, in whole numbers."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def close_links(sets: list[np.ndarray], asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Places of sets that are alike: links that join the same groups as all such pairs do (asks: all pairs with
    one that asks). Pairs that are joined already aren't compared; all others that the sizes and the rarest
    members allow are."""
    if len(sets) < 2:
        return []
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    parent = list(range(len(sets)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    index: dict[int, list[int]] = {}
    out = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(sets[i])
        own = which[ends[i] - n : ends[i]]
        first = own[np.lexsort((own, count[own]))[: prefix_length(n)]].tolist()
        seen: set[int] = set()
        for x in first:
            for j in index.get(x, ()):
                if j in seen or 5 * len(sets[j]) < 4 * n:
                    continue
                seen.add(j)
                if (asks is None or asks[i] or asks[j]) and top(i) != top(j) and alike(sets[i], sets[j]):
                    parent[top(i)] = top(j)
                    out.append((i, j))
        for x in first:
            index.setdefault(x, []).append(i)
    return out


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), k))


def slots_for(n: int) -> int:
    """Slots of shingle counts for n documents."""
    return min(MOST_SLOTS, max(SLOTS, 1 << max(0, n // 4).bit_length()))


def _rarity(texts: DataFrame, k: int, slots: int) -> np.ndarray:
    """How many of the texts' shingles fall into each slot. It orders shingles, rare ones first, and bounds how many
    texts share one, so shared slots cost time and no link. What the driver gets is bounded by the slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount((_shingle_set(text.as_py(), k) % np.uint64(slots)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + (1 << 15)]), pa.array(counts[some[at : at + (1 << 15)]])], names=["slot", "n"])

    rows = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))


def _prefixes(texts: DataFrame, k: int, bucket: int) -> DataFrame:
    """doc_id, digest of the text, key (a digest of the shingle set), rep (64 bits of it), size, rarest shingles, those
    of them that more than `bucket` texts may share, and fingerprint of every text."""
    slots = slots_for(texts.count())
    rarity = _rarity(texts.select("text"), k, slots)
    names = _names(NEAR_PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, first, hot, prints = [], [], [], [], []
                for text in part.column(2):
                    s = _shingle_set(text.as_py(), k)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    count = rarity[(s % np.uint64(slots)).astype(np.int64)]
                    rarest = np.lexsort((s, count))[: prefix_length(len(s))]
                    first.append(s[rarest])
                    hot.append(s[rarest[count[rarest] > bucket]])
                    prints.append(print_of(s, NEAR_PRINTS))
                own = np.array(prints, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([int.from_bytes(x[:8], "big", signed=True) for x in keys], pa.int64()), pa.array(sizes, pa.int64()), _lists(first), _lists(hot), *[pa.array(own[:, i]) for i in range(NEAR_PRINTS)]],
                    names=["doc_id", "digest", "key", "rep", "size", "first", "hot", *names],
                )

    return texts.mapInArrow(run, "doc_id long, digest string, key binary, rep long, size long, first array<long>, hot array<long>, " + ", ".join(f"{p} long" for p in names))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (label, i, j, key, set, asks) sorted by label, i and j: links (a, b) between keys."""

    def links(keys: list[bytes], sets: list[np.ndarray], asks: list[bool]) -> Iterator[pa.RecordBatch]:
        if found := [(x, y) for x, y in close_links(sets, asks) if keys[x] != keys[y]]:
            yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in found], pa.binary()), pa.array([keys[y] for _, y in found], pa.binary())], names=["a", "b"])

    now, keys, sets, asks = None, [], [], []
    for batch in batches:
        label, i, j, key, members, asking = batch.columns
        for row in range(batch.num_rows):
            at = (label[row].as_py(), i[row].as_py(), j[row].as_py())
            if at != now:
                yield from links(keys, sets, asks)
                now, keys, sets, asks = at, [], [], []
            keys.append(key[row].as_py())
            sets.append(np.array(members[row].values).view(np.uint64))
            asks.append(asking[row].as_py())
    yield from links(keys, sets, asks)


def _compared(rows: DataFrame) -> DataFrame:
    """Links between the sets of every (label, i, j) of rows (label, i, j, key, members, asks)."""
    rows = rows.select("label", "i", "j", "key", "members", "asks").repartition("label", "i", "j")
    return rows.sortWithinPartitions("label", "i", "j", "key").mapInArrow(_verified, "a binary, b binary")


def close_groups(docs: DataFrame, k: int = NEAR_SHINGLE, most: int = TASK_SHINGLES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, digest of the text and label of every document; labels are equal where links join the documents.

    Documents are linked if the Jaccard similarity of their sets of k-word shingles is 0.8 or more. Bit-sliced
    comparison among the documents that share a rare shingle proposes groups, in which whole sets are compared. A
    group with more than ``most`` shingles is dealt out in parts, as large buckets are."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("digest"), docs["text"].cast("string").alias("text"))
    rows = written(_prefixes(texts, k, bucket), "near-prefixes")
    names = _names(NEAR_PRINTS)
    sets = rows.select("rep", "first", "hot", *names).dropDuplicates(["rep"])
    band = F.lit(0).cast("long").alias("band")
    shared = sets.select(band, F.explode("first").alias("key"), "rep", *names)
    hot = sets.select(band, F.explode("hot").alias("key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
    maybe = components(bucket_links(shared, hot, NEAR_PRINTS, NEAR_RADIUS, bucket))
    # one text of each candidate set
    named = rows.groupBy("key").agg(F.min("digest").alias("_digest"), F.first("size").alias("size"), F.first("rep").alias("rep")).join(maybe, F.col("rep") == F.col("v")).select("_digest", "key", "size", "label")
    named = written(named, "near-members")
    zero = F.lit(0).cast("long")
    large = named.groupBy("label").agg(F.sum("size").alias("n")).filter(F.col("n") > most).select("label", F.ceil(F.col("n") / (most / 2)).cast("long").alias("parts"))
    large = written(large, "near-large")
    named = written(named.join(small(large), "label", "left"), "near-dealt")
    held = texts.join(small(named), F.col("digest") == F.col("_digest")).select("digest", "label", "key", "parts", "text").dropDuplicates(["digest"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                members = pa.array([_shingle_set(t.as_py(), k).view(np.int64) for t in part.column(3)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), members], names=["label", "key", "parts", "members"])

    full = held.select("label", "key", "parts", "text").mapInArrow(whole, "label long, key binary, parts long, members array<long>")
    if not large.count():
        links = _compared(full.withColumn("i", zero).withColumn("j", zero).withColumn("asks", F.lit(True)))
        return _labelled(rows, components(links))
    full = full.withColumn("i", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), zero)).withColumn("j", zero)
    full = written(full, "near-sets")
    first = written(_compared(full.withColumn("asks", F.lit(True))), "near-first")
    # sets of a large group outside its largest group of links so far meet all its parts
    joined = components(first).toDF("key", "group")
    parted = full.filter(F.col("parts").isNotNull()).drop("j").join(joined, "key", "left").withColumn("group", F.coalesce("group", "key"))
    parted = written(parted, "near-parted")
    main = parted.groupBy("label", "group").count().groupBy("label").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    apart = parted.join(small(written(main, "near-main")), "label").filter(F.col("group") != F.col("main"))
    shares = apart.groupBy("label").agg(F.ceil(F.sum(F.size("members")) / (most / 2)).cast("long").alias("shares"))
    shares = written(shares, "near-shares")
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    asked = parted.join(small(shares), "label").withColumn("j", each("shares")).withColumn("asks", F.lit(False))
    asking = apart.join(small(shares), "label").withColumn("j", F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.col("shares")))
    asking = asking.drop("i").withColumn("i", each("parts")).withColumn("asks", F.lit(True))
    columns = ["label", "i", "j", "key", "members", "asks"]
    second = _compared(asked.select(*columns).union(asking.select(*columns)))
    return _labelled(rows, components(first.union(second)))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.select("doc_id", "digest", "key").join(labels, F.col("key") == F.col("v"), "left").select("doc_id", "digest", F.coalesce("label", "key").alias("label"))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, null last, then of the smallest digest of the text; of rows
    that agree in both, the one whose columns have the smallest digest. What goes are rows, not ids: a doc_id that stands
    for unrelated texts keeps each of them."""
    found = written(close_groups(docs).groupBy("label", "doc_id", "digest").count(), "near-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    several = found.groupBy("label").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    several = written(several.select("label", "first"), "near-first-rows")
    key = lambda c: F.struct(F.coalesce(c, F.lit(0)), c.isNull())
    own, digest = unused(docs, "copy_id", "copy_digest")
    named = lambda rows: rows.select(key(F.col("doc_id")).alias(own), F.col("digest").alias(digest))
    rows = docs.withColumn(digest, F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))).withColumn(own, key(docs["doc_id"].cast("long")))
    others = found.join(small(several), "label").filter(rank != F.col("first"))
    gone = written(named(others), "near-gone")
    out = rows.join(small(gone), [own, digest], "left_anti")
    again = written(named(found.filter("count > 1")).join(small(gone), [own, digest], "left_anti"), "near-again")
    n = again.count()
    if not n:
        return out.select(*docs.columns)
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    single = out.join(again, [own, digest], "left_anti")
    whole = F.struct(*docs.columns)
    repeated = out.join(again, [own, digest], "left_semi").groupBy(own, digest).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
    return single.select(*docs.columns).unionByName(repeated.select("row.*"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")
