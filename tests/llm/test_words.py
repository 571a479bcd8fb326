"""Resampling and spelling variants against brute force, and the automata below them."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomatch.llm import bytewords as B
from foliomatch.llm import resample, spelling
from tests.llm.test_operators import LONG, TEXTS, docs, empty  # noqa: F401

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ["x" * 5000, "İ ſ K-é×÷ß", " é", "ab" * 40 + " " + "cd" * 33, "Ünï-cödé 漢字, 12 AB", "0" * 64 + " " + "1" * 65]


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé \nK漢{0\x00Ãÿ"), max_size=12), max_size=6))
def test_features(texts):
    texts = [*texts, *EXTRA]
    bucket, of, n_words = resample.features(pa.array(["skipped", *texts], pa.large_string()).slice(1))
    for i, t in enumerate(texts):
        n, want = grams(t)
        assert n_words[i] == n
        assert Counter(bucket[of == i].tolist()) == Counter(zlib.crc32(g.encode()) % resample.BUCKETS for g in want)


def test_features_of_nothing():
    for texts in ([], [""], ["", ""]):
        bucket, of, n_words = resample.features(pa.array(texts, pa.large_string()))
        assert len(bucket) == len(of) == 0 and n_words.tolist() == [0] * len(texts)


def draw(rows, target, percent, least):
    """(doc_id, text) rows by brute force: doc_id, n_features, weight, score, rank."""
    n = resample.BUCKETS
    bucket = lambda t: [zlib.crc32(g.encode()) % n for g in grams(t)[1]]
    s, t = (Counter(b for x in texts for b in bucket(x)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bucket(x)))
        out.append((i, len(bucket(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), grams(x)[0]))
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = Counter(long[: len(long) * percent // 100])
    rank = {r: [k + 1 for k, x in enumerate(long) if x == r][: drawn[r]] for r in drawn}
    return Counter((*r[:4], rank[r].pop() if rank.get(r) else None) for r in out)


def test_resample(spark, docs, empty):  # noqa: F811
    target = spark.createDataFrame([(1, "Ties ties more"), (2, None), (3, LONG[:400])], "item_id long, text string")
    rows = [(i, t) for i, t, _ in TEXTS]
    got = resample.resampled(docs, target, 50, 1).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == draw(rows, ["Ties ties more", None, LONG[:400]], 50, 1)
    assert resample.resampled(empty, target).count() == 0
    none = resample.resampled(docs, target.limit(0), 100, 0)
    assert sorted(r.rank for r in none.collect()) == list(range(1, len(TEXTS) + 1))


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9), None) for i in range(500)] + [(7, 3, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, score long, other string")
    for n in (0, 1, 250, 499, 1000):
        got = resample.ranked(df, n, "score", ("doc_id",), 40).collect()
        best = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
        assert len(got) == len(rows)
        assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [r[:2] for r in best]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(rows, least_count=3, times=2):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least_count}
    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in by.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("shard", [30, 10_000])
def test_variants(spark, shard):
    rng = random.Random(shard)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    pick = lambda: rng.choice(base[: rng.randint(1, len(base))])
    rows = [(rng.choice([None, *range(40)]), " ".join(pick().upper() if rng.random() < 0.1 else pick() for _ in range(60))) for _ in range(60)]
    rows += [(6, "stone " * 40 + "stona " * 16 + "stana " * 5), (1, None), (2, ""), (3, "×÷ ÀÁ 漢字aaaaaa漢"), (4, ("a" * 3000 + " ") * 4), (4, ("a" * 2999 + "b ") * 4), (4, ("a" * 3001 + " ") * 9)]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    got = spelling.variants(df, shard=shard).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == grouped(rows)
    assert any(r.root != (r.form or r.word) for r in got)
    assert spelling.variants(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=25), st.text("abc", min_size=1, max_size=6))
def test_automaton(words, asked):
    words = sorted(words)
    automaton = spelling.Automaton(words)
    for i, w in enumerate(words):
        assert automaton._walk(automaton.start, w, 0, 0)[1] == i
    answers = {i for i, w in enumerate(words) if near(asked, w)}
    assert automaton.with_one_error(asked, 0) == answers
    half = len(asked) // 2
    assert automaton.with_one_error(asked, half) == {i for i in answers if words[i].startswith(asked[:half])}
    got = {w: n for w, n, _, _ in itertools.chain(spelling._answers(words, [1] * len(words), [asked], False))}
    back = sorted(w[::-1] for w in words)
    other = {w: n for w, n, _, _ in spelling._answers(back, [1] * len(back), [asked[::-1]], True)}
    assert got.get(asked, 0) + other.get(asked, 0) == len(answers)


def test_minimal():
    """Words with common beginnings and ends share their states."""
    words = sorted(a + b for a in ("ab", "cd", "ee") for b in ("ing", "ed", "s"))
    assert len(spelling.Automaton(words).edges) == 9  # start, 3 + 1 behind the beginnings' characters, 4 of the ends' characters
    assert B.crc_table()[1] == zlib.crc32(b"\x01") ^ zlib.crc32(b"\x00") ^ B.crc_table()[0] and np.all(B.step(np.array([B.START]), np.uint32(65)) == ~np.uint32(zlib.crc32(b"A")))
