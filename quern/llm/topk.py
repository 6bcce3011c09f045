"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length. Chunks of similar length (a crowded length is salted over
several chunks) are dealt to tasks; the chunk of the longest vectors gives each query a
first threshold, with which later chunks that cannot reach it are never sent the query.
Inside a chunk, buckets of similar length are taken from the longest down. A query's
local cosine threshold in a bucket (threshold / (|query| * longest)) decides: above 1
the bucket is skipped; where it is high, coordinate pruning takes only vectors whose
focus coordinate lies in the feasible interval; else length pruning takes those long
enough. What is left is verified by its product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, shuffle_parts

RATIO = 0.9  # shortest to longest vector of a bucket
BUCKET_ROWS = 512
CHUNK_ROWS = (1024, 16384)
#: Queries that a chunk is sent with, and those that are multiplied with a bucket at once.
QUERY_BLOCK, QUERY_STEP = 32_768, 4096
#: Local cosine threshold from which a bucket is pruned by coordinates.
COORDINATE_FROM = 0.6
EPS = 1e-9


def _padded(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


#: Scores beyond the range of a long stand at its ends.
MOST = (1 << 63) - 1


class TopK:
    """Running k best of each query, ties to the smaller id. Scores are whole numbers; floor is rounded."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(float)
        self.q, self.s, self.i = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = np.arange(len(q)) - start < self.k
        last = np.arange(len(q)) - start == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def _length_pruned(qs, q_len, cs, c_len, floor, slack, active):
    """Products with the vectors long enough for at least one query, then per query."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor[active] > 0, floor[active] / q_len[active] * (1 - EPS), 0.0)
    n = int(np.searchsorted(-c_len, -need.min(), side="right"))
    products = qs[active] @ cs[:n].T
    r, c = np.nonzero(products >= (floor[active] - slack[active] * c_len.max(initial=0))[:, None])
    return active[r], products[r, c], c


def _coordinate_pruned(qs, q_len, cs, c_len, floor, slack, active, local):
    """Products with the vectors whose focus coordinate can reach the local threshold."""
    unit = cs / np.maximum(c_len, 1e-300)[:, None]
    orders = np.argsort(unit, axis=0)
    columns = np.take_along_axis(unit, orders, axis=0)
    found = [], [], []
    for a, t in zip(active, local, strict=True):
        u = qs[a] / q_len[a]
        f = int(np.abs(u).argmax())
        half = math.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
        low = -1.0 if u[f] < -t else u[f] * t - half
        high = 1.0 if u[f] > t else u[f] * t + half
        lo, hi = np.searchsorted(columns[:, f], [low - EPS, high + EPS])
        rows = orders[lo:hi, f]
        s = cs[rows] @ qs[a]
        ok = s >= floor[a] - slack[a] * c_len.max(initial=0)
        found[0].append(np.full(int(ok.sum()), a))
        found[1].append(s[ok])
        found[2].append(rows[ok])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def _near_best(r, s, c, k: int, slack: np.ndarray):
    """Of pairs with rounded products those that can be among the k best of their query."""
    order = np.lexsort((-s, r))
    r, s, c = r[order], s[order], c[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    sizes = np.bincount(r, minlength=len(slack))[r]
    least = s[start + np.minimum(k, sizes) - 1]
    keep = s >= least - 2 * slack[r]
    return r[keep], c[keep]


def _whole_products(qi, ci, r, c) -> np.ndarray:
    """Exact products of pairs of rows of whole numbers, of any size."""
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), 4096):
        part = slice(at, at + 4096)
        exact = (qi[r[part]].astype(object) * ci[c[part]].astype(object)).sum(axis=1)
        out[part] = [max(-MOST, min(MOST, x)) for x in exact.tolist()]
    return out


def search_chunk(qid, qi, floor, cid, ci, k: int) -> TopK:
    """The k best of each query among the vectors of a chunk that reach its floor.

    qi and ci hold whole numbers. Where a product could pass 2**53, floating-point ones
    only select, with slack for their rounding, what is then multiplied exactly.
    """
    dims = max(1, qi.shape[1])
    qs, cs = qi.astype(float), ci.astype(float)
    exact = float(np.abs(cs).max(initial=0)) * float(np.abs(qs).max(initial=0)) * dims < 2**53
    q_len, c_len = np.linalg.norm(qs, axis=1), np.linalg.norm(cs, axis=1)
    slack = np.zeros(len(qs)) if exact else q_len * (dims * 2.0**-50)
    order = np.argsort(-c_len, kind="stable")
    cid, ci, cs, c_len = cid[order], ci[order], cs[order], c_len[order]
    top, start = TopK(len(qid), k, floor), 0
    while start < len(cid):
        end = min(start + BUCKET_ROWS, int(np.searchsorted(-c_len, -RATIO * c_len[start], side="right")))
        b, b_len, b_id, b_int = cs[start:end], c_len[start:end], cid[start:end], ci[start:end]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(top.floor > 0, top.floor / (q_len * b_len[0]), -1.0)
        active = np.nonzero(local <= 1 + EPS)[0]
        start = end
        if not len(active):
            continue
        # one choice for a bucket, by the thresholds of its queries
        high = local[active] >= COORDINATE_FROM
        if high.mean() > 0.5:
            r, s, c = _coordinate_pruned(qs, q_len, b, b_len, top.floor, slack, active[high], np.minimum(local[active][high], 1.0))
            if not high.all():
                r2, s2, c2 = _length_pruned(qs, q_len, b, b_len, top.floor, slack, active[~high])
                r, s, c = np.concatenate([r, r2]), np.concatenate([s, s2]), np.concatenate([c, c2])
        else:
            r, s, c = _length_pruned(qs, q_len, b, b_len, top.floor, slack, active)
        r, c = r.astype(np.int64), c.astype(np.int64)
        other = b_id[c] != qid[r]
        r, s, c = r[other], s[other], c[other]
        if exact:
            s = np.rint(s).astype(np.int64)
        else:
            r, c = _near_best(r, np.clip(s, -(2.0**63), 2.0**63), c, k, slack * b_len[0])
            s = _whole_products(qi, b_int, r, c)
        top.add(r, s, b_id[c])
    return top


def _cell(k: int):
    def cell(cand: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": "int64", "query": "int64", "vec_id": "int64", "score": "int64"}
        out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in cols.items()})]
        if len(cand) and len(queries):
            dims = max(max(map(len, cand.v)), max(map(len, queries.qv)))
            ci, cid = _padded(cand.v, dims), cand.vec_id.to_numpy(np.int64)
            for at in range(0, len(queries), QUERY_STEP):
                part = queries.iloc[at : at + QUERY_STEP]
                qid, names = part.query_id.to_numpy(np.int64), part["query"].to_numpy(np.int64)
                top = search_chunk(qid, _padded(part.qv, dims), part.floor.fillna(-np.inf).to_numpy(float), cid, ci, k)
                out.append(pd.DataFrame({"query_id": qid[top.q], "query": names[top.q], "vec_id": top.i, "score": top.s}))
        return pd.concat(out, ignore_index=True)

    return cell


def plan_chunks(bins: list[tuple[int, int, float]], rows: int) -> list[tuple[int, int, int, float]]:
    """(bin, first chunk, chunks, longest) from (bin, count, longest); long bins first.

    A crowded bin is split over several chunks, short neighbours share one.
    """
    out, chunk, filled, top = [], -1, rows, 0.0
    for b, n, longest in sorted(bins, reverse=True):
        if filled + n <= rows and n <= rows:
            out.append((b, chunk, 1, top))
            filled += n
        else:
            many = max(1, math.ceil(n / rows))
            out.append((b, chunk + 1, many, longest))
            chunk, filled, top = chunk + many, n if many == 1 else rows, longest
    return out


def usable(column) -> object:
    """True for vectors without null or non-finite components."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & ok, F.lit(False))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, chunk_rows: int | None = None) -> DataFrame:
    """The k largest inner products of each query: query_id, rank, vec_id, score.

    vectors and queries: (vec_id long, v array<long>), null and non-finite vectors left
    out before. A row with the query's own id is no candidate; ties go to the smaller
    vec_id; fewer than k candidates are all returned. Shorter vectors count as padded
    with zeros. Candidates that repeat an id appear as often as they stand. A query that
    repeats id and vector asks once; one that repeats an id with another vector is a query
    of its own, with ranks from 1. Rows with a null id take no part. Products are exact at
    any size; those beyond the range of a long count as its ends.
    """
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    bin_ = F.when(F.col("len") > 0, F.floor(F.log("len") / -math.log(RATIO))).otherwise(F.lit(-(10**6))).cast("int")
    vec = vectors.where("vec_id is not null").select("vec_id", "v").withColumn("len", length).withColumn("bin", bin_)
    # at most one row for each power of 1 / RATIO between the shortest and the longest
    bins = [(r.bin, r.n, r.longest) for r in vec.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).collect()]
    n = sum(x[1] for x in bins)
    rows = chunk_rows or min(CHUNK_ROWS[1], max(CHUNK_ROWS[0], math.ceil(n / (2 * shuffle_parts(spark)))))
    plan = plan_chunks(bins, rows)
    schema = "query_id long, query long, vec_id long, score long"
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of_bin = spark.createDataFrame(plan, "bin int, first int, many int, longest double")
    chunks = spark.createDataFrame([(c, top) for _, first, many, top in {p[1]: p for p in reversed(plan)}.values() for c in range(first, first + many)], "chunk int, longest double")
    cand = vec.join(F.broadcast(of_bin), "bin").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("chunk"))
    q = queries.where("vec_id is not null").withColumn("len", length).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("len").alias("len"))
    q = q.dropDuplicates(["query_id", "qv"]).withColumn("query", F.xxhash64("query_id", "qv"))
    blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))
    q = q.withColumn("block", F.pmod("query", F.lit(blocks)).cast("int"))

    def run(cand, q, pairs):
        """pairs: (chunk, block) with a query; candidates go to these only."""
        cells = cand.join(pairs, "chunk")
        return cells.groupBy("chunk", "block").cogroup(q.groupBy("chunk", "block")).applyInPandas(_cell(k), schema)

    none = F.lit(None).cast("double")
    ids = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    first = run(cand.where("chunk = 0"), q.select("query_id", "query", "qv", "block", F.lit(0).alias("chunk"), none.alias("floor")), ids.withColumn("chunk", F.lit(0)))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy("query_id", "query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    later = chunks.where("chunk > 0")
    if len(plan) == 1 and plan[0][2] == 1:
        found = first
    else:
        # a query reaches the chunks whose longest vector times ratio is 1 or more; a block what one of its queries does
        ratio = F.when(F.col("floor") > 0, F.col("len") * (1 + EPS) / F.col("floor")).otherwise(F.lit(float("inf")))
        asked = q.join(floors, ["query_id", "query"], "left").withColumn("ratio", ratio)
        asked = materialize(asked, "asked")
        reach = (F.col("ratio") == float("inf")) | (F.col("ratio") * F.col("longest") >= 1)
        pairs = materialize(asked.groupBy("block").agg(F.max("ratio").alias("ratio")).join(F.broadcast(later), reach).select("block", "chunk", "longest"), "cells")
        sent = asked.join(pairs, "block").where(reach).select("query_id", "query", "qv", "block", "chunk", "floor")
        found = first.unionByName(run(cand.where("chunk > 0"), sent, pairs.select("block", "chunk")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vec = read_table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    vec = vec.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long")).alias("v"))
    return exact_topk(vec, vec.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
