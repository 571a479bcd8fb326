"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard.

Points are put into a shard's graph in batches that at most double it. A greedy beam search in the graph so
far proposes neighbours; relaxed pruning keeps a neighbour only if no neighbour already kept is closer
to it by more than the factor ``ALPHA``, which leaves edges in all directions; reverse edges are added and
pruned in the same way. A query searches every shard with a beam, from the nearest of about 4 sqrt(n) points,
and its results are merged. The beam widens with the shard (``beam_width``): a query visits a smaller share
of a larger shard.

Scale: identical vectors are one node that keeps the 2 k smallest rows' ids, k of one id at most, all that any
query could return of them; Spark limits them before the shuffle, so a vector that fills a third of the table
is no hot spot. Shards hold about ``SHARD`` nodes, drawn by hash. The graphs are built once and written to the
shared folder; queries meet them in blocks of ``QUERY_BLOCK``, so no task's memory grows with the input.

Scores are Euclidean distances of the original vectors in double precision; only the way through
the graph uses single precision.

Defined cases: rows with a null vec_id, and vectors that are null, empty, zero or hold a null or a
number that isn't finite, take no part as queries or candidates. Vectors of another length than the
query's aren't its candidates. With fewer candidates than k all that were found are returned; a
shard within the beam width is searched as a whole. Ties go to the smaller id. Repeated rows (same
vec_id) are separate candidates, but not of a query with that id. Repeated query rows are one query; a
query id with several vectors gets the k rows nearest to any of them. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomatch.llm.common import table, written

K = 10
DEGREE, BUILD_BEAM, ALPHA, CLIQUE, STARTS = 32, 64, 1.2, 16, 16
#: The beam of a search in a shard of at most BEAM_NODES nodes.
SEARCH_BEAM, BEAM_NODES = 64, 8_192
SHARD = 32_768
QUERY_BLOCK = 65_536
BATCH = 256


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each row of q to the points in its row of ids."""
    d = x[ids] - q[:, None, :]
    return np.einsum("brd,brd->br", d, d)


def _to_entries(x: np.ndarray, entries: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each row of q to the entries."""
    e = x[entries]
    return np.maximum(np.einsum("ed,ed->e", e, e) + np.einsum("bd,bd->b", q, q)[:, None] - 2 * q @ e.T, 0)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points that a greedy search of this beam width meets, nearest first: places (-1: none), distances.
    visited: gets the share of points whose distance was computed, besides the entries, of each query."""
    b = len(q)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, len(x) + 1), bool)  # the last column takes what isn't there
    seen[:, -1] = True
    ids = np.full((b, width), -1)
    dist = np.full((b, width), np.inf, np.float32)
    first = _to_entries(x, entries, q)
    order = np.argsort(first, 1, kind="stable")[:, : min(width, STARTS)]
    start = entries[order]
    ids[:, : start.shape[1]], dist[:, : start.shape[1]] = start, np.take_along_axis(first, order, 1)
    seen[rows, start] = True
    done = ids < 0
    active = np.arange(b)
    while len(active):
        a = active[:, None]
        nxt = np.argmin(done[active], 1)
        done[active, nxt] = True
        near = edges[ids[active, nxt]]
        fresh = ~seen[a, near]
        seen[a, near] = True
        d = np.where(fresh, _distances(x, np.where(fresh, near, 0), q[active]), np.float32(np.inf))
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
        all_d = np.concatenate([dist[active], d], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        ids[active], dist[active], done[active] = (np.take_along_axis(z, order, 1) for z in (all_ids, all_d, all_done))
        active = active[~done[active].all(1)]
    if visited is not None:
        visited += ((seen.sum(1) - 1) / len(x)).tolist()
    return ids, dist


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each own point at most `degree` of its candidates (-1: none): the nearest, then the nearest that
    no kept one is nearer to by the factor alpha, and so on."""
    out = np.full((len(own), degree), -1)
    dist = np.where((ids < 0) | (ids == own[:, None]), np.inf, dist)
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    points = x[ids]
    norms = np.einsum("bcd,bcd->bc", points, points)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1), 0)
    open_ = np.isfinite(dist)
    rows = np.arange(len(own))
    for k in range(degree):
        some = open_.any(1)
        if not some.any():
            break
        best = np.argmax(open_, 1)
        out[some, k] = ids[rows, best][some]
        open_ &= alpha * alpha * between[rows, best] > dist
        open_[rows, best] = False
    return out


def beam_width(n: int) -> int:
    """Beam of a search among n points. Nearest neighbours in many dimensions need a beam that grows with n, more
    slowly than n; measured at 8 thousand to 51 thousand vectors of 64 dimensions for a recall of 0.95."""
    return max(SEARCH_BEAM, math.ceil(SEARCH_BEAM * (n / BEAM_NODES) ** 0.75))


def entry_count(n: int) -> int:
    """Points of a graph of n at which searches may begin; a search takes the STARTS nearest of them."""
    return max(CLIQUE, 4 * math.isqrt(n))


def build(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> np.ndarray:
    """Edges of the graph over the points: one row of places each, len(x) where there is none."""
    n = len(x)
    edges = np.full((n, degree), n)
    order = np.random.default_rng(seed).permutation(n)
    at = min(n, CLIQUE)
    entries = order[:at]
    edges[entries[:, None], np.arange(at - 1)[None, :]] = np.stack([np.delete(entries, i) for i in range(at)]) if at > 1 else 0
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        ids, dist = beam_search(x, edges, order[: min(at - len(batch), entry_count(n))], x[batch], width)
        kept = robust_prune(x, batch, ids, dist, degree, alpha)
        edges[batch] = np.where(kept < 0, n, kept)
        # reverse edges
        source, target = np.repeat(batch, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        for low, high in ((0, 8), (8, 64), (64, BATCH + 1)):
            some = (count > low) & (count <= high)
            if not some.any():
                continue
            h, width_new = heads[some], int(count[some].max())
            new = np.full((len(h), width_new), -1)
            mine = np.repeat(some, count)
            new[np.repeat(np.arange(len(h)), count[some]), place[mine]] = source[mine]
            old = np.where(edges[h] == n, -1, edges[h])
            for a in range(0, len(h), BATCH):
                cand = np.concatenate([old[a : a + BATCH], new[a : a + BATCH]], 1)
                room = (cand >= 0).sum(1) <= degree
                d = np.where(cand < 0, np.inf, _distances(x, np.maximum(cand, 0), x[h[a : a + BATCH]]))
                pruned = robust_prune(x, h[a : a + BATCH], cand, d, degree, alpha)
                full = np.take_along_axis(cand, np.argsort(cand < 0, 1, kind="stable"), 1)[:, :degree]
                full = np.pad(full, ((0, 0), (0, degree - full.shape[1])), constant_values=-1)
                out = np.where(room[:, None], full, pruned)
                edges[h[a : a + BATCH]] = np.where(out < 0, n, out)
    return edges


def _single(x: np.ndarray) -> np.ndarray:
    """Single precision, scaled so that no square overflows."""
    return (x / max(float(np.abs(x).max(initial=0)), 1e-300)).astype(np.float32)


def search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, width: int | None = None, seed: int = 1, copies: np.ndarray | None = None, visited: list | None = None) -> np.ndarray:
    """For each query the places (-1: none) that its beam ends with. Up to `width` points: all of them. copies: of
    each point; searches begin at those with the most copies too, as missing one of them costs many results."""
    n = len(x)
    width = width or beam_width(n)
    if n <= width:
        return np.broadcast_to(np.arange(n), (len(q), n))
    both = _single(np.concatenate([x, q]))
    entries = np.random.default_rng(seed).permutation(n)[: entry_count(n)]
    if copies is not None:
        most = np.argsort(-copies, kind="stable")[:CLIQUE]
        entries = np.union1d(entries, most[copies[most] > 1])
    return np.concatenate([beam_search(both[:n], edges, entries, both[n + a : n + a + BATCH], width, visited)[0] for a in range(0, len(q), BATCH)])


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda e: e != 0), F.lit(False))


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """vec, ids: distinct vectors with the ids of the 2 k smallest rows of each, k of one id at most: without the rows
    of any one id, k are left or all."""
    place = lambda by: F.row_number().over(by.orderBy("vec_id"))
    few = vectors.withColumn("_n", place(W.partitionBy("vec", "vec_id"))).filter(F.col("_n") <= k)
    few = few.withColumn("_n", place(W.partitionBy("vec"))).filter(F.col("_n") <= 2 * k)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


INDEX = "dim int, shard long, vec array<double>, ids array<long>, edges array<int>"


def index(points: DataFrame, shards: int) -> DataFrame:
    """Every node with its shard, its place there (the order of rows by vec) and its edges."""

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["vec"].to_numpy())
        order = np.lexsort(x.T[::-1])
        part, x = part.iloc[order], x[order]
        edges = build(_single(x)) if len(x) > beam_width(len(x)) else np.full((len(x), 1), len(x))
        return pd.DataFrame({"dim": key[0], "shard": key[1], "vec": part["vec"], "ids": part["ids"], "edges": list(edges.astype(np.int32))})

    keyed = points.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("long"))
    return keyed.groupBy("dim", "shard").applyInPandas(grow, INDEX)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """vectors, queries: vec_id, embedding. query_id, rank, vec_id, score: the k nearest found."""
    clean = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    vectors, queries = clean(vectors), clean(queries).dropDuplicates(["vec_id", "vec"])
    points = written(nodes(vectors, k), "ann-nodes")
    shards = max(1, math.ceil(points.count() / shard))
    graph = written(index(points, shards), "ann-graph")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = graph.withColumn("block", spread(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")).withColumn("dim", F.size("vec")).withColumn("shard", spread(shards))

    columns = ["query_id", "dim", "shard", "place", "copy", "vec_id", "score"]

    def look(key: tuple, g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(q):
            return pd.DataFrame({c: [] for c in columns})
        x = np.stack(g["vec"].to_numpy())
        order = np.lexsort(x.T[::-1])
        x, ids = x[order], g["ids"].to_numpy()[order]
        edges, asked = np.stack(g["edges"].to_numpy())[order], np.stack(q["vec"].to_numpy())
        found = search(x, edges, asked, copies=np.array([len(i) for i in ids]))
        out = []
        for query_id, v, places in zip(q["vec_id"], asked, found, strict=True):
            places = places[places >= 0]
            d = np.sqrt(((x[places] - v) ** 2).sum(1))
            rows, enough = [], 0
            for i in np.argsort(d, kind="stable"):
                if len(rows) >= k and d[i] > enough:
                    break
                enough = d[i]
                rows += [(float(d[i]), own, int(places[i]), c) for c, own in enumerate(ids[places[i]]) if own != query_id]
            rows = sorted(rows)[:k]
            out += [(query_id, key[0], key[1], p, c, i, s) for s, i, p, c in rows]
        return pd.DataFrame(out, columns=columns)

    keys = ["dim", "shard", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(look, "query_id long, dim int, shard long, place long, copy int, vec_id long, score double")
    # a candidate row that several vectors of one query id found counts once, with its smallest distance
    met = met.groupBy(*columns[:-1]).agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
