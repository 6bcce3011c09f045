import numpy as np
import pytest

from quern.llm import ann, topk


def brute(ids, x, q_of, k):
    out = {}
    for i in q_of:
        s = x @ x[ids.index(i)]
        best = sorted((-v, j) for v, j in zip(s.tolist(), ids, strict=True) if j != i)[:k]
        out[i] = [(j, -v) for v, j in best]
    return out


@pytest.mark.parametrize("kind", ["lengths", "one length", "copies", "close"])
def test_chunk_search_is_exact(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-64, 64, (1500, 16)).astype(float)
    if kind == "lengths":
        x = np.floor(x * rng.random((1500, 1)) ** 3)
    if kind == "copies":
        x[200:900] = x[5]
    if kind == "close":
        x = np.floor(200 * np.eye(16)[rng.integers(0, 16, 1500)] + rng.integers(-12, 12, (1500, 16)))
    ids = list(range(1500))
    qid = np.arange(0, 1500, 10)
    top = topk.search_chunk(qid, x[qid], np.full(len(qid), -np.inf), np.arange(1500), x, 7)
    want = brute(ids, x, qid.tolist(), 7)
    got = {}
    for q, s, i in zip(top.q, top.s, top.i, strict=True):
        got.setdefault(int(qid[q]), []).append((int(i), s))
    assert got == want


@pytest.mark.parametrize("size", [2**27, 2**30, 2**55])
def test_products_beyond_double_precision(size):
    """Exact where floating-point products are not, and the ends of a long beyond its range."""
    rng = np.random.default_rng(4)
    x = rng.integers(-size, size, (400, 8))
    x[100:110] = x[3] + np.arange(10)[:, None] % 3
    top = topk.search_chunk(np.arange(0, 400, 8), x[::8], np.full(50, -np.inf), np.arange(400), x, 6)
    most = 2**63 - 1
    for a in range(50):
        s = [(-max(-most, min(most, sum(int(u) * int(v) for u, v in zip(x[8 * a], y, strict=True)))), j) for j, y in enumerate(x) if j != 8 * a]
        mine = top.q == a
        assert list(zip((-top.s[mine]).tolist(), top.i[mine].tolist(), strict=True)) == sorted(s)[:6]


def test_repeated_queries_and_huge_components(spark):
    rows = [(20, [3, 0]), (20, [3, 0]), (20, [0, 5]), (1, [2, 1]), (3, [1, 1]), (4, [1 << 40, -(1 << 40)]), (5, [-4, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, df.where("vec_id % 20 = 0"), k=2).collect())
    assert got == [(20, 1, 1, 5), (20, 1, 4, 3 << 40), (20, 2, 1, 6), (20, 2, 3, 5)]


def test_chunks_split_crowded_lengths_and_merge_short_ones():
    plan = topk.plan_chunks([(5, 10, 9.0), (4, 2500, 7.0), (3, 10, 5.0), (2, 20, 4.0)], 1000)
    assert [(p[1], p[2]) for p in plan] == [(0, 1), (1, 3), (4, 1), (4, 1)]


def test_topk_over_spark_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(size=4) * 3 ** rng.integers(0, 5)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None, 2.0, 3.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [1.0] * 4), (305, [0.0] * 4), (306, rows[7][1]), (307, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.where(topk.usable(df.embedding)).selectExpr("vec_id", "transform(embedding, x -> cast(floor(64 * x) as long)) v", "1 as score")
    out = topk.exact_topk(df, df.where("vec_id % 20 = 0"), k=5, chunk_rows=40).collect()
    good = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = brute([i for i, _ in good], np.array([v for _, v in good]), [i for i, _ in good if i % 20 == 0], 5)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, float(r.score)))
    assert got == want
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0
    assert topk.exact_topk(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_robust_prune_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]], np.float32)
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]], np.int32), 1.2, 4)
    assert set(kept[0].tolist()) - {-1} == {1, 3, 4}


def test_ann_recall_scores_and_copies(spark):
    d = "/root/testdata/sf0.1"
    emb = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids = [r.vec_id for r in emb]
    x = np.array([r.embedding for r in emb], float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in ann.op4_ann_graph(spark, d).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.95
    for q, g in got.items():
        assert sorted(g) == list(range(1, 21)) and q not in {v for v, _ in g.values()}
        assert [g[k] for k in sorted(g)] == sorted(g.values(), key=lambda v: (-v[1], v[0]))
        assert all(abs(s - x[ids.index(v)] @ x[ids.index(q)]) < 1e-9 for v, s in g.values())


def test_ann_odd_rows(spark):
    rng = np.random.default_rng(2)
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(100, 0, -1)] + [(200 + i, rng.normal(size=3).tolist()) for i in range(30)] + [(None, one), (501, None), (502, [0.0, 0.0, 0.0]), (503, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vec = df.where(topk.usable(df.embedding) & ann.nonzero("embedding")).withColumnRenamed("embedding", "vector")
    out = ann.search_index(ann.build_index(vec, shard_rows=16), vec.where("vec_id % 20 = 0"), 20).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in out] == [i for i in range(1, 22) if i != 20]
    assert ann.search_index(ann.build_index(vec.limit(0)), vec.limit(0)).count() == 0
    alone = ann.search_index(ann.build_index(vec.where("vec_id = 220")), vec.where("vec_id = 220"))
    assert alone.count() == 0


@pytest.mark.parametrize("n", [40, 100])
def test_every_node_is_reached(n):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(n, 6)) * 10.0 ** rng.integers(-3, 4, (n, 1))
        graph, entry = ann.build_graph(x, seed=seed)
        reached = np.zeros(n, bool)
        ann.reached_from(graph, np.array([entry]), reached)
        assert reached.all()
        assert sorted(ann.beam_search(ann._with_length(x), graph, np.array([entry]), ann._with_length(x)[:1], 128)[0][0].tolist())[-n:] == list(range(n))


def test_unreached_nodes_are_linked():
    x = ann._with_length(np.random.default_rng(1).normal(size=(9, 3)))
    graph = np.full((9, 1), -1, np.int32)
    graph[0, 0], graph[1, 0] = 1, 0
    out = ann.connected(x, graph, 0)
    reached = np.zeros(9, bool)
    ann.reached_from(out, np.array([0]), reached)
    assert reached.all()


def test_ann_huge_repeated_and_uneven_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-20, 21)).tolist()) for i in range(60)] + [(60, [1e150, -1e150]), (61, [1e-150])]
    rows += [rows[0], rows[0], (20, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*r, 7, 0.0) for r in rows], "vec_id long, vector array<double>, rank int, score double")
    out = ann.search_index(ann.build_index(df), df.where("vec_id in (0, 20, 60)"), 62).collect()
    vec = {(i, tuple(v)) for i, v in rows}
    pad = lambda v: np.array([*v, *[0.0] * (4 - len(v))])
    for q, v in [(0, rows[0][1]), (60, rows[60][1]), (20, rows[20][1]), (20, [1.0, 2.0, 3.0, 4.0])]:
        want = sorted((-float((pad(v) * pad(w)).sum()), j) for j, w in vec if j != q)[:62]
        found = {(r["rank"], r.vec_id, r.score) for r in out if r.query_id == q}
        missing = {(k, j, -s) for k, (s, j) in enumerate(want, 1)} - found
        assert not missing, (sorted(missing)[:3], sorted(found)[:70])


def _recall(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vec = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(4)
    index, asked = ann.build_index(vec), vec.where("vec_id % 20 = 0")
    got = {}
    for r in ann.search_index(index, asked, beam=ann.fitted_beam(index, vec, asked)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(len(x))), x, list(range(0, len(x), 20)), 20)
    return sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["gauss32", "gauss64", "lognormal", "giant"])
def test_ann_recall_with_unequal_lengths(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64 if kind == "gauss64" else 32))
    if kind == "lognormal":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    if kind == "giant":
        x[77] *= 10_000
    assert _recall(spark, x) >= 0.95
