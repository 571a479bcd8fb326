"""Query rows that repeat."""

import numpy as np

from foliomatch.llm import ann


def test_repeated_query_rows(spark):
    x = np.random.default_rng(5).normal(size=(40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (7, x[7].tolist()), (1, x[20].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id < 2"), shard=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in (0, 1):
        asked = [v for i, v in rows if i == q]
        want = sorted((min(np.linalg.norm(np.array(v) - a) for a in asked), i) for i, v in rows if i != q)[:10]
        assert got[q] == [(i, round(float(s), 9)) for s, i in want]


def test_recall_on_the_table(spark):
    """The query against all distances, over the whole table of embeddings."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    got: dict[int, list] = {}
    for r in ann.op7_ann_search(spark, sf).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for q, v in ((i, v) for i, v in rows if i % 100 == 0):
        distance = np.sqrt(((x - v) ** 2).sum(1))
        near = sorted((d, i) for d, i in zip(distance.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert all(abs(distance[ids == i].min() - s) < 1e-9 for i, s in got[q]) and len(got[q]) == 10
        hits, total = hits + len({i for _, i in near} & {i for i, _ in got[q]}), total + 10
    assert total >= 200 and hits >= 0.95 * total
