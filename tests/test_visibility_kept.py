import random

import pytest
from pyspark.sql import functions as F

from quern.operators import audit as D
from quern.operators import index as I
from quern.streaming import mutations as W

DAY = 1_704_067_200
WRITES = "write_id long, document_id long, content string, t long"
SEEN = "node_id long, document_id long, content string, t long"


def timed(spark, rows, schema, column):
    return spark.createDataFrame(rows, schema).withColumn(column, F.timestamp_seconds(F.col("t") + DAY)).drop("t")


def by_hand(writes, seen, timeout=10):
    out = []
    for w, doc, content, t in writes:
        first = [min((s for n, d, c, s in seen if n == node and d == doc and d is not None and c == content and s >= t), default=None) for node in (0, 1, 2)]
        p = first[0] if first[0] is not None and first[0] <= t + timeout else None
        nodes = [x if p is not None and x is not None and x <= p + timeout else None for x in first[1:]]
        missing = ", ".join(str(k) for k, x in enumerate(nodes, 1) if x is None)
        error = "not published" if p is None else f"missing on {missing}" if missing else ""
        us = lambda a, b: None if a is None else max(0, a - b) * 1_000_000
        last = None if error else max(nodes)
        out.append((w, doc, us(p, t), us(nodes[0], t), us(nodes[1], t), us(last, t), None if last is None else us(last, p), error))
    return sorted(out, key=repr)


def logs(seed, n):
    rng = random.Random(seed)
    writes = [(k, rng.choice([1, 2, None, 3]), rng.choice(["a", "b", None, ""]), rng.randrange(200)) for k in range(n)]
    seen = [(rng.choice([0, 0, 1, 2, 7]), rng.choice([1, 2, None, 3]), rng.choice(["a", "b", None, ""]), rng.randrange(230)) for _ in range(5 * n)]
    return writes, seen + seen[:5]


@pytest.mark.parametrize("span", [1, 7, 600])
def test_visibility_by_hand(spark, span):
    writes, seen = logs(span, 120)
    got = D.write_visibility(timed(spark, writes, WRITES, "t_write"), timed(spark, seen, SEEN, "t_seen"), span_s=span)
    want = by_hand(writes, seen)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[-1] for r in want} == {"", "not published", "missing on 1", "missing on 2", "missing on 1, 2"}


def test_visibility_without_rows(spark):
    none, some = timed(spark, [], WRITES, "t_write"), timed(spark, [(1, 1, "a", None), (2, 1, "a", 5)], WRITES, "t_write")
    seen = timed(spark, [], SEEN, "t_seen")
    assert D.write_visibility(none, seen).count() == 0
    assert [(r.write_id, r.error) for r in D.write_visibility(some, seen).collect()] == [(2, "not published")]


def test_visibility_stream_equals_batch(spark, tmp_path):
    writes, seen = logs(3, 60)
    end = [(1000, 9, "end", 5000)]  # moves both watermarks on
    timed(spark, writes, WRITES, "t_write").coalesce(1).write.parquet(str(tmp_path / "w"))
    timed(spark, end, WRITES, "t_write").coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
    timed(spark, seen, SEEN, "t_seen").coalesce(1).write.parquet(str(tmp_path / "o"))
    timed(spark, [(0, 9, "end", 5000)], SEEN, "t_seen").coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    source = lambda name, column, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    w = source("w", "t_write", "write_id long, document_id long, content string, t_write timestamp")
    o = source("o", "t_seen", "node_id long, document_id long, content string, t_seen timestamp")
    q = W.write_visibility(w, o, lateness="1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == by_hand(writes, seen)


def test_runs_are_digits():
    assert W._runs(1, 3) == [(0, 1)] and W._runs(9, 3) == [(0, 9)]
    assert W._runs(14, 3) == [(0, 9), (9, 12), (12, 13), (13, 14)]
    for n in range(1, 300):
        runs = W._runs(n, 4)
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
        assert len(runs) <= 3 * 5


def changes(k):
    """Batch k changes some documents, removes one and adds one."""
    rows = [(k % 5, 10 * k, f"w{k} same"), (k % 3 + 5, 10 * k + 1, None), (100 + k, 10 * k + 2, f"new w{k % 4}"), (k % 5, 10 * k + 3, f"last w{k}")]
    return [(d, o, 0, "x", "Applied", c) for d, o, c in rows]


def test_kept_index_does_not_grow(spark, tmp_path):
    kept, state = W.KeptIndex(spark, str(tmp_path / "kept"), fan=3, keep=2), {}
    assert kept.batches() == 0 and kept.documents().count() == 0 and kept.postings().count() == 0
    for k in range(28):
        rows = changes(k)
        if k in (8, 20):  # a crash after runs are written, before they count
            whole, kept._at = kept._at, lambda name: (_ for _ in ()).throw(RuntimeError("lost")) if name.startswith("head/") else whole(name)
            with pytest.raises(RuntimeError):
                kept.add(spark.createDataFrame(rows, W.OUTCOMES), k)
            del kept._at
            assert kept.batches() == k and sorted(map(tuple, kept.documents().collect())) == sorted(state.items())
        kept.add(spark.createDataFrame(rows, W.OUTCOMES), k)
        kept.add(spark.createDataFrame(rows, W.OUTCOMES), k)  # delivered again
        for d, _, _, _, _, c in rows:
            state.pop(d, None)
            if c is not None:
                state[d] = c
        assert kept.batches() == k + 1
        if k % 9 in (0, 8) or k == 27:
            docs = kept.documents()
            assert sorted(map(tuple, docs.collect())) == sorted(state.items())
            assert sorted(map(tuple, kept.postings().collect())) == sorted(map(tuple, I.build_postings(docs).collect()))
    assert len(W._runs(28, 3)) == 2 and len(kept._names("documents")) <= 12 and len(kept._names("head")) == 1
