"""Writes of mixed kinds against a plain fold, and audits by digests against a plain join."""

import random
import re

from quern.operators import audit as D
from quern.operators import mutations as M


def fold(ops, held):
    out, now = [], dict(held)
    for seq, i, kind, content in sorted(ops):
        if kind not in ("insert", "update", "delete") or (kind != "delete" and not (content or "").strip(" \t\n\r")):
            status = "invalid"
        elif kind == "insert":
            status = "conflict" if i in now else "created"
        elif i not in now:
            status = "not_found"
        else:
            status = "updated" if kind == "update" else "deleted"
        if status in ("created", "updated"):
            now[i] = content
        if status == "deleted":
            del now[i]
        out.append((seq, i, status))
    return out, now


def test_fold_with_a_hot_id(spark):
    rng = random.Random(4)
    ops = [(k * 3, 1 if rng.random() < 0.6 else rng.randrange(40), rng.choice(["insert", "update", "delete", "insert", "update", "merge", None]), rng.choice(["a", "a b", " ", None, f"t{k}"])) for k in range(900)]
    held = {i: f"old {i}" for i in range(0, 60, 3)}
    batch = spark.createDataFrame(ops, "seq long, document_id long, kind string, content string")
    corpus = spark.createDataFrame(list(held.items()), "document_id long, content string")
    want, table = fold(ops, held)
    for span in (1, 7, 100, 10**6):
        assert sorted((r.seq, r.document_id, r.status) for r in M.mixed_writes(batch, corpus, span).collect()) == want
        assert {r.document_id: r.content for r in M.mixed_table(batch, corpus, span).collect()} == table


def test_one_id_is_spread_over_tasks(spark):
    """All writes of one id, ranges of which lie in several partitions of the fold."""
    from pyspark.sql import functions as F

    batch = spark.range(2000).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("document_id"), F.lit("update").alias("kind"), F.lit("x").alias("content"))
    out = M.mixed_writes(batch, spark.createDataFrame([(1, "y")], "document_id long, content string"), span=50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.status for r in out.collect()} == {"updated"}


def test_empty_batch(spark):
    corpus = spark.createDataFrame([(1, "y")], "document_id long, content string")
    none = spark.createDataFrame([], "seq long, document_id long, kind string, content string")
    assert M.mixed_writes(none, corpus).count() == 0 and [tuple(r) for r in M.mixed_table(none, corpus).collect()] == [(1, "y")]
    assert M.mixed_table(none, corpus.limit(0)).count() == 0


def test_digests_find_every_difference(spark):
    docs = [(k, f"text {k}" if k % 9 else None, k % 3) for k in range(500)]
    corpus = spark.createDataFrame(docs, "document_id long, content string, shard_id long")
    copies = {(k, s, (s + r) % 3): c for k, c, s in docs for r in range(2)}
    copies[17, 17 % 3, 17 % 3] = "other"
    copies[18, 0, 0] = ""  # null became empty
    del copies[40, 40 % 3, (40 + 1) % 3]
    copies[41, 2, 1] = "text 41"
    copies[999, 0, 0] = "no such document"
    inventory = spark.createDataFrame([(n, k, s, c) for (k, s, n), c in copies.items()], "node_id int, document_id long, shard_id long, content string")
    for buckets in (1, 64, 4096):
        rows = D.replica_differences(corpus, inventory, buckets=buckets).collect()
        assert sorted((r.document_id, r.node_id, r.difference) for r in rows) == [(17, 2, "content"), (18, 0, "content"), (40, 2, "missing"), (41, 1, "unexpected"), (999, 0, "unexpected")]
    # only buckets that differ are compared row by row
    assert D.differing_buckets(corpus, inventory).count() == 5
    assert D.differing_buckets(corpus, inventory.limit(0)).count() > 0
    whole = spark.createDataFrame([(n, k, s, c) for k, c, s in docs for n in (s, (s + 1) % 3)], "node_id int, document_id long, shard_id long, content string")
    assert D.differing_buckets(corpus, whole).count() == 0


def test_differences_shuffle_no_texts(spark):
    """Every bucket differs, and still only hashes are shuffled."""
    corpus = spark.range(400).selectExpr("id AS document_id", "repeat(sha2(string(id), 512), 80) AS content", "id % 3 AS shard_id")
    inventory = corpus.selectExpr("int(shard_id) AS node_id", "document_id", "shard_id", "content || '!' AS content")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = D.replica_differences(corpus, inventory)
    text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.difference: r["count"] for r in out.groupBy("difference").count().collect()} == {"content": 400, "missing": 400}
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert inputs and not [x for x in inputs if "content#" in x]


def test_ambiguous_placement(spark):
    corpus = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 2)], "document_id long, content string, shard_id long")
    inventory = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 2, 1), (0, 3, 2)], "node_id int, document_id long, shard_id long")
    assert sorted(tuple(r) for r in D.ambiguous_placement(corpus, inventory).collect()) == [(1, 2, "ambiguous"), (3, 0, "not_found")]
