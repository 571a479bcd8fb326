"""Near copies by exact Jaccard similarity: 0.8 in both directions, short texts, chains and large groups."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from foliomatch.llm import common, simhash

DOCS = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    group = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return group


def some(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_four_fifths_in_both_directions(spark):
    rng, texts = random.Random(1), []
    for n in (4, 8, 12, 40, 200, 2000):
        words = some(rng, n + 4)
        # n shingles in common of n * 5 / 4 in all: 0.8; one more: just below
        texts += [" ".join(words), " ".join(words + some(rng, n // 4))]
        words = some(rng, n + 4)
        texts += [" ".join(words), " ".join(words + some(rng, n // 4 + 1))]
    kept = simhash.without_copies(spark.createDataFrame(list(enumerate(texts)), DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i % 4 != 1]


@pytest.mark.parametrize("most", [200, 4_000_000])
def test_groups_equal_brute_force(spark, most):
    rng, texts = random.Random(2), [None, "", " \t", "one", "One", "one two"]
    passage = some(rng, 30)
    for _ in range(12):
        words = some(rng, rng.choice([6, 12, 50, 120]))
        for _ in range(rng.randint(1, 8)):
            words = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in words]
            texts.append(" ".join(words + passage * (rng.random() < 0.3)))
    labels = {r.doc_id: r.label for r in simhash.close_groups(spark.createDataFrame(list(enumerate(texts)), DOCS), most=most).collect()}
    want = brute(texts)
    assert all((labels[i] == labels[j]) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2))
    assert 20 < len(set(want)) < len(texts) - 5


def test_close_links_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(50) < 0.93], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for _ in range(60)]
    pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if simhash.alike(sets[i], sets[j])]
    found = []
    for links in (pairs, simhash.close_links(sets)):
        forest = simhash.Forest(60)
        forest.join(*np.array(links).T)
        found.append(forest.find(np.arange(60)).tolist())
    assert found[0] == found[1] and len(links) < len(pairs)


def kept_rows(rows):
    """The rows that stay, by brute force: of each group the smallest id, null last, then the smallest digest."""
    group = brute([t for _, t in rows])
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    return sorted((min((r for r, g in zip(rows, group, strict=True) if g == x), key=rank) for x in set(group)), key=repr)


def test_rows_not_ids_are_dropped(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(some(rng, 60)) for _ in range(4))
    rows = [(5, a), (5, a), (None, a), (4, a), (5, b), (3, b + " more"), (7, c), (7, d), (None, c), (None, c), (None, c + " more"), (None, "alone"), (None, None), (1, ""), (2, " ")]
    kept = [(r.doc_id, r.text) for r in simhash.without_copies(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(kept, key=repr) == kept_rows(rows)
    assert sorted(kept, key=repr) == sorted([(4, a), (3, b + " more"), (7, c), (7, d), (None, "alone"), (1, "")], key=repr)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_one_row_of_each_group_stays(spark, monkeypatch, broadcast):
    """Ids that are null or stand for several rows, in groups of all sizes; with and without broadcasts."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(simhash, "small", lambda df: common.small(df, broadcast))
    rng, rows = random.Random(6), []
    for n in (1, 1, 2, 5, 40):
        words = some(rng, 80)
        for _ in range(n):
            text = " ".join(words + some(rng, rng.randint(0, 3)))
            rows += [(rng.choice([None, rng.randint(0, 20)]), text)] * rng.randint(1, 3)
    df = spark.createDataFrame([(i, t, {"k": k % 2}) for k, (i, t) in enumerate(rows)], DOCS + ", other map<string,int>")
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == kept_rows(rows)
