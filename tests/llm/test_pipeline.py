"""The pipeline's stages, each on all its predecessor kept, against brute force; and its edge cases."""

import itertools

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foliomatch.llm import packing, quality
from tests.llm.test_operators import docs, empty  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "packing"]


def test_quality_stage(spark, stages):
    model = quality.classifier(spark, SF, stages[0])
    want = [r.doc_id for r in stages[0].collect() if model.scores(np.array([quality.features(r.text.encode())]))[0] >= quality.CUT]
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(want)


def test_near_duplicate_stage(stages):
    """The contract's rule by brute force over all pairs: five words, Jaccard similarity of 0.8 or more, components."""
    rows = {r.doc_id: r.text for r in stages[1].collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, t in rows.items() for w in [(t or "").lower().split()]}
    group = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        common = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(group.values())) != sorted(sets)


def test_later_stages(stages):
    two, three, four, five = (s.collect() for s in stages[2:])
    assert len(two) == len(three)
    changed = {r.doc_id for r in three} - {r.doc_id for r, s in itertools.product(three, two) if r == s}
    assert changed and all(any(c in "0123456789@" for c in r.text) for r in two if r.doc_id in changed)
    count = {i: [r.doc_id for r in four].count(i) for i in {r.doc_id for r in four}}
    assert max(count.values()) <= 3
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    total = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in four)
    assert sum(r.length for r in five) == total


def test_edges(spark, docs, empty):  # noqa: F811
    """Nulls, empty and long texts, repeats and helper names in the input, through every stage."""
    clashing = ["copy_id", "copy_digest", "copy_turn", "mix_source", "mix_last", "mix_copy", "pii_values", "pii_parts", "pii_new", "place", "gone"]
    for start in (docs.selectExpr("*", *[f"doc_id as {c}" for c in clashing]), empty):
        rows, counts = start, []
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.written(stage(spark, rows, SF), f"edge-{name}")
            counts.append(rows.count())
            if name != "packing":
                assert rows.columns == start.columns
            if name == "near_duplicates" and start is not empty:
                ids = sorted((r.doc_id for r in rows.collect()), key=str)
                assert len(ids) == len(set(ids)) and counts[1] < counts[0]
        assert counts == [0] * 5 if start is empty else min(counts) >= 1 and counts[2] == counts[1]
