"""The similarity join of documents against all pairs."""

import itertools
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from foliomatch.operators import shingles as H
from foliomatch.operators import similarity_join as S
from foliomatch.sources.intermediate import written

DOCS = "doc_id long, text string"


def shingles(text):
    w = [x for x in text.replace("\n", " ").replace("\t", " ").split(" ") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> class_id, links, closest, similarity, by comparing all classes with all."""
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and shingles(t):
            sets.setdefault(shingles(t), set()).add(i)
    name = {s: min(ids) for s, ids in sets.items()}
    links = defaultdict(list)
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            for x, y in ((a, b), (b, a)):
                links[x].append((-len(a & b) / len(a | b), name[y]))
    out = {}
    for s, ids in sets.items():
        best = min(links[s], default=(None, None))
        for i in ids:
            out[i] = (name[s], len(links[s]), best[1], best[0] and -best[0])
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.class_id, r.links, r.closest, r.similarity) for r in rows}


def some(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(S.similar_documents(docs)) == want
    assert sf == "0.001" or sum(w[1] for w in want.values()) > 10


@pytest.mark.parametrize(("hot", "part"), [(2, 4), (3, 1_000), (10_000, 10)])
def test_groups_and_passages(spark, hot, part):
    """Near copies in groups of all sizes, and passages that many documents share; frequent shingles from few on."""
    rng, rows = random.Random(hot), [(1, ""), (2, None), (3, " \n"), (4, "one"), (5, "one"), (6, "One"), (None, "one")]
    passage = some(rng, 40)
    for n in (1, 2, 3, 9, 30):
        words = some(rng, rng.choice([7, 30, 90]))
        for _ in range(n):
            own = [x if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for x in words]
            rows.append((len(rows) + 10, " ".join(own + passage * (rng.random() < 0.4)) + rng.choice(["", " ", "\n"])))
            if rng.random() < 0.3:
                rows.append((len(rows) + 10, rows[-1][1].replace(" ", "  ")))
    rows += [(500 + i, " ".join(passage + some(rng, k))) for i, k in enumerate([0, 0, 2, 9, 10, 11, 60])]
    want = brute(rows)
    assert found(S.similar_documents(spark.createDataFrame(rows, DOCS).repartition(5), hot=hot, part=part)) == want
    pairs = {(r.doc1, r.doc2) for r in S.closest_pairs(S.similar_documents(spark.createDataFrame(rows, DOCS), hot=hot)).collect()}
    best = {(i, c) for i, (k, _, c, _) in want.items() if i == k and c is not None}
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in best} and pairs <= best and len(pairs) == len({frozenset(p) for p in pairs})


def test_frequent_shingles_go_last(spark):
    """A passage of many documents is in no prefix, as each of them has rarer shingles."""
    rng = random.Random(1)
    passage = some(rng, 60)
    rows = [(i, " ".join(passage + some(rng, 60))) for i in range(80)]
    got = S.classes(spark.createDataFrame(rows, DOCS))
    prefixes, often = S.prefixes(got, S.SIMILARITY, 10)
    assert (often is None or often.count() == 0) and prefixes.groupBy("h").count().agg({"count": "max"}).first()[0] <= 10
    sizes = {r.key: r.n for r in got.sets.collect()}
    assert all(r["count"] == n - -(-4 * n // 5) + 1 for r in prefixes.groupBy("key").count().collect() for n in [sizes[r.key]])


def test_a_late_common_shingle_is_no_meeting(spark):
    """Sets of 90 need 80 in common: from its eleventh shingle on a set has 80, from its twelfth on 79."""
    rows = [(1, 90, 7, 11), (2, 90, 7, 11), (3, 90, 7, 12), (4, 90, 8, 1), (5, 90, 8, 12), (6, 100, 9, 12), (7, 80, 9, 1)]
    rare = spark.createDataFrame(rows, "key long, n int, h long, place int")
    assert sorted(map(tuple, S.met_by(rare, S.SIMILARITY).collect())) == [(1, 2), (6, 7)]
    assert S.met_by(rare, Fraction(9, 10)).count() == 0


def test_places_are_those_of_one_order(spark):
    """Whatever is put last in one set is put last in all: two sets have no two shingles in opposite orders."""
    rng = random.Random(4)
    passages = [some(rng, 30) for _ in range(4)]
    rows = [(i, " ".join(sum((p for p in passages if rng.random() < 0.4), []) + some(rng, 30))) for i in range(60)]
    got, _ = S.prefixes(S.classes(spark.createDataFrame(rows, DOCS)), S.SIMILARITY, 8)
    sets = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r.place):
        sets[r.key].append(r.h)
    before = {(x, y) for hs in sets.values() for x, y in itertools.combinations(hs, 2)}
    assert not any((y, x) in before for x, y in before)


def test_four_fifths(spark):
    rng, rows, want = random.Random(2), [], {}
    for n in (4, 8, 40, 400):
        for more in (n // 4, n // 4 + 1):
            words, i = some(rng, n + 4), len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(words + some(rng, more)))]
            want |= dict.fromkeys((i, i + 1), int(more == n // 4))
    got = found(S.similar_documents(spark.createDataFrame(rows, DOCS)))
    assert {i: g[1] for i, g in got.items()} == want
    strict = found(S.similar_documents(spark.createDataFrame(rows, DOCS), Fraction(9, 10)))
    assert not any(g[1] for g in strict.values())


def test_common_counts(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(S, "COLUMNS", 7)
    sets = [np.unique(rng.integers(-(2**62), 2**62, 40) // 2**57) for _ in range(9)]
    got = S.common_counts(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert S.similar_documents(docs).count() == 0


def test_hashes_of_runs(monkeypatch):
    """Two texts share a hash if and only if they share a run, whatever is between words and wherever a batch is cut."""
    rng = random.Random(5)
    letters = ["a", "b", "é", "ก", "\0", "x" * 63, "x" * 64, "x" * 65, "x" * 200, " ", "\x85"]
    texts = ["", " \n\t", "a", " a", "a b c d", "b a c d", "a b c d e", "a b c d e f", "ab c", "a bc"]
    texts += [rng.choice(["", " "]) + rng.choice([" ", "\x0b", "\f\r", "\t \n"]).join("".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20))) for _ in range(60)]
    runs = []
    for t in texts:
        w = t.encode().split()
        runs.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    whole = list(H.sets(pa.array(["left out", *texts])[1:], 5))
    monkeypatch.setattr(H, "CHUNK", 50)
    parts = list(H.sets(pa.array(texts), 5))
    for x, y, r in zip(whole, parts, runs, strict=True):
        assert x.tolist() == y.tolist() == sorted(set(x.tolist())) and len(x) == len(r)
    for (x, r), (y, s) in itertools.combinations(zip(whole, runs, strict=True), 2):
        assert len(np.intersect1d(x, y)) == len(r & s)


def test_one_shared_shingle_is_no_candidate(spark):
    """Sets of 90 have 72 shingles behind the first 18 + 1: with 80 in common they share 9 of the first ones at least, or as many fewer as
    frequent ones were left out of both."""
    met = spark.createDataFrame([(1, 2, 90, 90, 8), (1, 3, 90, 90, 9), (3, 4, 90, 90, 8), (4, 5, 90, 90, 7), (6, 7, 80, 100, 1)], "a long, b long, na int, nb int, met long")
    assert sorted(map(tuple, S.may_link(met, None, S.SIMILARITY).collect())) == [(1, 3), (6, 7)]
    frequent = spark.createDataFrame([(3, 1), (4, 2), (5, 1)], "key long, k long")
    assert sorted(map(tuple, S.may_link(met, frequent, S.SIMILARITY).collect())) == [(1, 3), (3, 4), (6, 7)]


def test_passages_give_no_candidates(spark, monkeypatch):
    """Texts that share a passage of a tenth are met by it, as all else in them is their own, but none is compared."""
    rng, seen = random.Random(6), {}
    passage = some(rng, 24)
    rows = [(i, " ".join(passage + some(rng, 180))) for i in range(20)]
    monkeypatch.setattr(S, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    assert {v[1] for v in found(S.similar_documents(spark.createDataFrame(rows, DOCS))).values()} == {0}
    assert seen["join-rare"].count() > 0 and seen["join-candidates"].count() == 0


@pytest.mark.parametrize("late", [1, 1_000])
def test_any_order_finds_all(spark, monkeypatch, late):
    """Which shingles are taken for frequent changes no result, nor does a doc_id that has one text several times."""
    rng, rows = random.Random(7), []
    for _ in range(6):
        words = some(rng, 60)
        rows += [(len(rows) + i, " ".join(w if rng.random() > 0.01 else "x" for w in words)) for i in range(6)]
    rows += [rows[3], rows[3], rows[9], (rows[3][0], rows[20][1])]
    monkeypatch.setattr(S, "LOOK", 1)
    monkeypatch.setattr(S, "LATE", late)
    df = spark.createDataFrame(rows, DOCS)
    assert S.likely_frequent(df, 5, 4).count() == min(late, S.likely_frequent(df, 5, 4).count()) > 0
    monkeypatch.setattr(S, "likely_frequent", lambda r, k, f=S.likely_frequent: f(r, k, 4))
    got, want = found(S.similar_documents(df, hot=4)), brute(rows)
    assert {i: v[1:] for i, v in got.items() if i != rows[3][0]} == {i: v[1:] for i, v in want.items() if i != rows[3][0]}


@pytest.mark.parametrize("of", [1, 4])
def test_shared_first_shingles(spark, monkeypatch, of):
    """What several sets have among their first shingles, with places and counts, whatever the buckets; no more is kept of a set than must
    be looked at."""
    rng = random.Random(9)
    words = [some(rng, rng.choice([3, 20, 300])) for _ in range(12)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else "x" for w in rng.choice(words))) for i in range(60)]
    got = S.classes(spark.createDataFrame(rows, DOCS).repartition(3))
    sets = {r.key: (r.n, r.first) for r in got.sets.collect()}
    assert all(len(first) == n - -(-4 * n // 5) + 1 for n, first in sets.values())
    k = defaultdict(int)
    for _, first in sets.values():
        for h in first:
            k[h] += 1
    want = sorted((h, key, n, i + 1, k[h]) for key, (n, first) in sets.items() for i, h in enumerate(first) if k[h] > 1)
    monkeypatch.setattr(S, "BUCKET", 50)
    have = sorted(map(tuple, S.shared(got.sets.select("key", "n", "first"), sum(len(f) for _, f in sets.values()), of).collect()))
    assert len(want) > 50 and (have == want if of == 1 else have == [r for r in want if r[0] >> 8 & 3 == 0] and have)


def test_few_frequent_shingles_are_paired(spark, monkeypatch):
    """A few sets more than `hot` with a common passage beside many others: nothing is chosen anew for that, and no groups are made."""
    rng, seen = random.Random(10), []
    words = some(rng, 60)
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(5)] + [(100 + i, " ".join(some(rng, 60))) for i in range(120)]
    monkeypatch.setattr(S, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    assert found(S.similar_documents(spark.createDataFrame(rows, DOCS), hot=3)) == brute(rows)
    assert any(df.count() for name, df in seen if name == "join-often") and not {"join-again", "join-edges"} & {name for name, _ in seen}
