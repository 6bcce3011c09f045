"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size and similar length. Each shard builds a directed graph:
a greedy search proposes the neighbours of a node, and relaxed distance pruning keeps a
candidate only if no kept neighbour is nearer to it by the factor alpha, so long and
diverse edges remain. A query runs a beam search in each shard; the best of all shards
are merged. Inner products become distances by one more coordinate,
sqrt(longest**2 - |x|**2), which is 0 for queries; as a shard's vectors are about equally
long, that coordinate stays small, and distances among them lead to what queries want. The
beam is as wide as a sample of the queries needs to find what a brute-force search finds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .topk import usable

SHARD_ROWS = 8192
#: Queries that a shard is sent with at once; they are searched BATCH by BATCH.
QUERY_BLOCK = 65_536
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 24, 40, 128, 1.2
#: Lengths of a shard differ by this factor at most, but for shards that a beam holds whole.
BAND = 1.08
#: Queries of the sample that the beam is fitted to, and the recall that it must have.
TUNE_ROWS, TUNE_RECALL = 64, 0.97
#: Nodes inserted together, and nodes of a beam expanded together.
BATCH, EXPAND = 512, 4

INDEX_SCHEMA = "shard int, node int, entry int, vec_ids array<long>, vector array<double>, neighbours array<int>"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that no square is infinite; zeros stay."""
    top = np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.where(top > 0, top, 1)


def _with_length(x: np.ndarray) -> np.ndarray:
    """Vectors as parts of the longest one, with the coordinate that makes them equally long."""
    x = x / (np.abs(x).max(initial=0) or 1.0)
    sq = (x * x).sum(axis=1)
    longest = sq.max(initial=0) or 1.0
    return (np.column_stack([x, np.sqrt(np.maximum(longest - sq, 0))]) / np.sqrt(longest)).astype(np.float32)


def beam_search(x, graph, entries, qs, beam: int):
    """Nodes and squared distances of the beam of each query, nearest first; -1: none."""
    m, width = len(qs), beam
    ids, dist = np.full((m, width), -1, np.int32), np.full((m, width), np.inf, np.float32)
    done, seen = np.zeros((m, width), bool), np.zeros((m, len(x) + 1), bool)
    n = min(len(entries), width)
    ids[:, :n] = entries[:n]
    dist[:, :n] = ((x[entries[:n]][None] - qs[:, None]) ** 2).sum(axis=2)
    seen[:, entries[:n]] = True
    rows = np.arange(m)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        pick = np.argpartition(open_, EXPAND - 1, axis=1)[:, :EXPAND] if width > EXPAND else np.tile(np.arange(width), (len(rows), 1))
        ok = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        alive = ok.any(axis=1)
        rows, pick, ok = rows[alive], pick[alive], ok[alive]
        if not len(rows):
            break
        nodes = np.where(ok, np.take_along_axis(ids[rows], pick, axis=1), -1)
        flag = done[rows]
        np.put_along_axis(flag, pick, True, axis=1)
        done[rows] = flag | ~np.isfinite(dist[rows])
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(rows), -1)
        near[seen[rows[:, None], near]] = -1  # the last column stands for -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows[:, None], near] = True
        seen[:, -1] = False
        fresh = near >= 0
        d = np.full(near.shape, np.inf, np.float32)
        r, c = np.nonzero(fresh)
        diff = x[near[r, c]] - qs[rows[r]]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], near], axis=1)
        all_f = np.concatenate([done[rows], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(a, best, axis=1) for a in (all_i, all_d, all_f))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def robust_prune(x, nodes, cand, alpha: float, degree: int) -> np.ndarray:
    """Up to degree diverse neighbours of each node from its row of candidates (-1: none)."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for at in range(0, len(nodes), 1024):
        p, c = nodes[at : at + 1024], np.sort(cand[at : at + 1024], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == p[:, None]] = -1
        v = x[c]
        sq = np.einsum("bcd,bcd->bc", v, v)
        between = np.maximum(sq[:, :, None] + sq[:, None] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
        diff = v - x[p][:, None]
        own = np.where(c >= 0, np.einsum("bcd,bcd->bc", diff, diff), np.inf)
        r = np.arange(len(p))
        for k in range(degree):
            j = own.argmin(axis=1)
            ok = np.isfinite(own[r, j])
            if not ok.any():
                break
            out[at + r[ok], k] = c[r[ok], j[ok]]
            covered = alpha * alpha * between[r, j] <= own
            own[covered & ok[:, None]] = np.inf
            own[r, j] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
    """Neighbours of each vector (-1: none) and the entry node."""
    n = len(vectors)
    x = _with_length(vectors)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    if n <= 1:
        return graph, 0
    k = min(degree // 2, n - 1)
    graph[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(x, graph, np.array([entry]), x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), a, degree)
            # edges back: put where there is room, else prune again
            src = np.repeat(nodes, degree)
            dst = graph[nodes].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            turn = np.argsort(dst, kind="stable")
            src, dst = src[turn], dst[turn]
            while len(dst):
                first = np.r_[True, dst[1:] != dst[:-1]]
                start = np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
                nth = np.arange(len(dst)) - start
                now = nth < degree  # so many at a time; the rest of a crowded node in the next turn
                own, slot = np.unique(dst[now], return_inverse=True)
                extra = np.full((len(own), degree), -1, np.int32)
                extra[slot, nth[now]] = src[now]
                both = np.concatenate([graph[own], extra], axis=1)
                both = -np.sort(-both, axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                full = (both >= 0).sum(axis=1) > degree
                both = -np.sort(-both, axis=1)
                graph[own[~full]] = both[~full, :degree]
                if full.any():
                    graph[own[full]] = robust_prune(x, own[full], both[full], a, degree)
                src, dst = src[~now], dst[~now]
    return connected(x, graph, entry), entry


def reached_from(graph: np.ndarray, nodes: np.ndarray, reached: np.ndarray) -> None:
    """Mark what edges lead to from nodes."""
    reached[nodes] = True
    while len(nodes):
        nodes = np.unique(graph[nodes])
        nodes = nodes[nodes >= 0]
        nodes = nodes[~reached[nodes]]
        reached[nodes] = True


def connected(x: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """The graph with an edge to each node without a path from the entry, from the nearest node that has one."""
    reached = np.zeros(len(x), bool)
    reached_from(graph, np.array([entry]), reached)
    for node in np.flatnonzero(~reached).tolist():
        if reached[node]:
            continue
        have = np.flatnonzero(reached & (graph < 0).any(axis=1))  # with room for an edge
        if not len(have):
            graph = np.column_stack([graph, np.full(len(graph), -1, np.int32)])
            have = np.flatnonzero(reached)
        near = have[((x[have] - x[node]) ** 2).sum(axis=1).argmin()]
        graph[near, np.flatnonzero(graph[near] < 0)[0]] = node
        reached_from(graph, np.array([node]), reached)
    return graph


def _build(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("first_id").reset_index(drop=True)
    dims = max(map(len, f.vector))
    x = np.zeros((len(f), dims))
    for i, v in enumerate(f.vector):
        x[i, : len(v)] = v
    graph, entry = build_graph(x)
    return pd.DataFrame({"shard": f.shard, "node": np.arange(len(f), dtype=np.int32), "entry": entry, "vec_ids": f.vec_ids, "vector": f.vector, "neighbours": list(graph)})


def build_index(vectors: DataFrame, keep: int = 21, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """An index table with a row for each distinct vector of (vec_id long, vector array<double>).

    Equal vectors share a row with their `keep` smallest ids: as ties go to the smaller
    id, no other can be among the keep nearest of a query. Null ids take no part; rows
    that repeat id and vector count once. Shorter vectors count as padded with zeros.
    Shards are bands of similar length; rare lengths share shards that a beam holds whole,
    and common ones have several. Vectors are searched as 32-bit parts of the longest of
    their shard, of any size; every node of a shard can be reached from its entry.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    small = vectors.where("vec_id is not null").select("vec_id", "vector").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    classes = small.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids")).withColumn("first_id", F.col("vec_ids")[0])
    top = F.array_max(F.transform("vector", F.abs))
    inner = F.aggregate("vector", F.lit(0.0), lambda a, v: a + (v / top) * (v / top))
    band = F.floor((F.log(top) + F.log(inner) / 2) / math.log(BAND) + 0.5).cast("long")
    classes = materialize(classes.withColumn("band", F.when(top > 0, band).otherwise(-(10**6))), "ann-classes")
    sizes = sorted(((r.band, r.n) for r in classes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 20,000 bands
    plan, base, held = [], -1, math.inf  # (band, first shard, shards)
    for at, n in sizes:
        if held + n <= SEARCH_BEAM:
            held += n
            plan.append((at, base, 1))
            continue
        parts = math.ceil(n / shard_rows)
        base += plan[-1][2] if plan else 1
        held = n if parts == 1 else math.inf
        plan.append((at, base, parts))
    known = classes.sparkSession.createDataFrame(plan, "band long, base int, parts int")
    dealt = classes.join(F.broadcast(known), "band").withColumn("shard", (F.col("base") + F.pmod(F.xxhash64("first_id"), F.col("parts"))).cast("int"))
    return materialize(dealt.select("shard", "vector", "vec_ids", "first_id").groupBy("shard").applyInPandas(_build, INDEX_SCHEMA), "ann-index")


def _exact_sample(vectors: DataFrame, sample: list, k: int) -> dict:
    """The k-th largest product of each sampled query with other ids, by brute force: each task returns its k best."""
    dims = max(len(v) for _, v in sample)

    def best(frames):
        for f in frames:
            width = max(dims, max(map(len, f.vector), default=0))
            x, q = np.zeros((len(f), width)), np.zeros((len(sample), width))
            for to, column in ((x, f.vector), (q, [v for _, v in sample])):
                for i, v in enumerate(column):
                    to[i, : len(v)] = v
            for (qid, _), part in zip(sample, q):
                score = np.where(f.vec_id.to_numpy() == qid, -np.inf, (x * part).sum(axis=1))
                top = np.argsort(-score, kind="stable")[:k]
                yield pd.DataFrame({"query_id": qid, "score": score[top]})

    found = vectors.mapInPandas(best, "query_id long, score double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    return {r.query_id: r.floor for r in ranked.groupBy("query_id").agg(F.min("score").alias("floor")).collect()}  # TUNE_ROWS rows


def fitted_beam(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> int:
    """The least doubling of the beam with which a sample of the queries finds TUNE_RECALL of its k nearest.

    At most TUNE_ROWS queries are sampled, those with the least hash of the id; a beam as
    wide as a shard finds all.
    """
    rows = queries.where("vec_id is not null").select("vec_id", "vector").dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNE_ROWS)
    sample = [(r.vec_id, r.vector) for r in rows.collect()]
    if not sample:
        return beam
    floors = _exact_sample(vectors.where("vec_id is not null").select("vec_id", "vector"), sample, k)
    asked = queries.sparkSession.createDataFrame(sample, "vec_id long, vector array<double>")
    total = vectors.limit(k + 1).count() - 1
    while beam < SHARD_ROWS:
        found = search_index(index, asked, k, beam).select("query_id", "score").collect()  # k rows for each of the sample
        hits = sum(r.score >= floors.get(r.query_id, math.inf) for r in found)
        if hits >= TUNE_RECALL * min(k, total) * len(sample):
            break
        beam *= 2
    return beam


def _search(k: int, beam: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "name": pd.Series(dtype="int64"), "found": pd.Series(dtype=object)})
        index = index.sort_values("node").reset_index(drop=True)
        dims = max(max(map(len, index.vector)), max(map(len, queries.asked)))
        exact, qs = np.zeros((len(index), dims)), np.zeros((len(queries), dims))
        for to, column in ((exact, index.vector), (qs, queries.asked)):
            for i, v in enumerate(column):
                to[i, : len(v)] = v
        x, graph = _with_length(exact), np.stack(index.neighbours.to_numpy())
        entry, members = np.array([index.entry.iloc[0]]), index.vec_ids.tolist()
        out = []
        for at in range(0, len(qs), BATCH):
            part = qs[at : at + BATCH]
            # the order of a query's products does not depend on its length, nor do its nearest
            unit = scaled(part)
            unit /= np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-300)
            flat = np.column_stack([unit, np.zeros(len(part))]).astype(np.float32)
            nodes, _ = beam_search(x, graph, entry, flat, beam)
            for q, row in zip(part, nodes, strict=True):
                row = row[row >= 0]
                score = (exact[row] * q).sum(axis=1)
                best = [(-s, i) for s, r in zip(score.tolist(), row, strict=True) for i in members[r]]
                out.append([{"vec_id": int(i), "score": -s} for s, i in sorted(best)[:k]])
        return pd.DataFrame({"query": queries["query"].to_numpy(), "name": queries["name"].to_numpy(), "found": out})

    return search


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest found of each query (vec_id long, vector array<double>), without its own id.

    Returns query_id, rank, vec_id, score (inner product in double precision). Equal
    query vectors are searched once; a query that repeats id and vector asks once, one
    that repeats an id with another vector is a query of its own, with ranks from 1. The
    index must keep k + 1 ids of equal vectors. Other columns are ignored.
    """
    asked = queries.where("vec_id is not null").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked")).distinct()
    kinds = asked.groupBy("asked").agg(F.min("query_id").alias("query")).withColumn("name", F.xxhash64("asked"))
    blocks = max(1, math.ceil(kinds.count() / QUERY_BLOCK))
    n = max((r.shard for r in index.agg(F.max("shard").alias("shard")).collect() if r.shard is not None), default=-1) + 1
    if not n:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = kinds.withColumn("block", F.pmod("name", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(_search(k + 1, beam), "query long, name long, found array<struct<vec_id: long, score: double>>")
    # k + 1 of each shard, a list for each query
    merged = found.groupBy("query", "name").agg(F.flatten(F.collect_list("found")).alias("found"))
    best = F.slice(F.array_sort("found", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)), 1, k + 1)
    merged = merged.select("query", "name", best.alias("found"))
    own = asked.join(kinds, "asked").select("query_id", "query", "name").join(merged, ["query", "name"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = own.select("query_id", F.posexplode(others).alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def nonzero(column):
    return F.exists(column, lambda x: x != 0)


def op4_ann_graph(spark, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all, with a beam fitted to a sample of these queries."""
    vec = read_table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & nonzero("embedding"))
    vec = vec.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    index, asked = build_index(vec), vec.where("vec_id % 20 = 0")
    return search_index(index, asked, beam=fitted_beam(index, vec, asked))
