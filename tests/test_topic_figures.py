"""The partitioned topic as a source and sink, live figures of streams, and quantile sketches."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import audit as D
from quern.operators import outbox as O  # noqa: E741
from quern.operators import telemetry as T
from quern.plans.views import view
from quern.sources import jsonl, topic
from quern.streaming import figures as L
from quern.streaming import mutations as W


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def started(df, name, ck, out):
    q = df.writeStream.queryName(name).format("parquet").option("checkpointLocation", str(ck)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def test_order_by_key_and_offsets(spark, tmp_path):
    path = str(tmp_path / "t")
    # one key holds half of the rows; another is null
    events = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), F.col("id").cast("string").alias("v"), (F.col("id") * 3).alias("seq"))
    for part in (events.where("seq < 7500"), events.where("seq >= 7500")):
        topic.publish(part, path, "k", "v", "seq", 4)
    got = topic.read_topic(spark, path)
    assert rows(got.select("key", "value"), "key", "value") == rows(events, "k", "v")
    by_part = {}
    for r in got.collect():
        by_part.setdefault(r.partition, []).append((r.offset, int(r.value), r.key))
    assert topic.TopicLog(path).ends() == {str(p): len(x) for p, x in by_part.items()} and len(by_part) > 1
    homes = {}
    for part, records in by_part.items():
        records.sort()
        assert [r[0] for r in records] == list(range(len(records)))
        assert [r[1] for r in records] == sorted(r[1] for r in records)  # arrival order, so that of each key too
        for r in records:
            assert homes.setdefault(r[2], part) == part
    files = [f for v in (1, 2) for f in topic.TopicLog(path).commit(v)["files"]]
    assert max(f[2] - f[1] for f in files) < 4_000 / 2  # a hot key is cut into files


def test_offsets_to_start_from(spark, tmp_path):
    path = str(tmp_path / "t")
    events = spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("v"), F.col("id").alias("seq"))
    for half in (events.where("seq < 150"), events.where("seq >= 150")):
        topic.publish(half, path, "k", "v", "seq", 2)
    low = {"0": 100, "1": 20}
    got = topic.read_topic(spark, path, json.dumps(low))
    ends = topic.TopicLog(path).ends()
    assert got.count() == sum(ends[p] - low[p] for p in low) and got.where("offset < 100 and partition = 0").count() == 0
    assert topic.read_topic(spark, path, "latest").count() == 0
    small = spark.read.format(topic.FORMAT).option("rowsPerTask", 10).load(path)
    assert small.count() == 300 and small.rdd.getNumPartitions() > 2
    with pytest.raises(Exception, match="appended"):
        topic.records(events, "k", "v", 2).write.format(topic.FORMAT).mode("overwrite").save(path)


def test_empty_topic(spark, tmp_path):
    path = str(tmp_path / "t")
    assert topic.read_topic(spark, path).count() == 0
    topic.publish(spark.createDataFrame([], "k string, v string, seq long"), path, "k", "v", "seq", 2)
    assert topic.TopicLog(path).version() == 0 and topic.read_topic(spark, path).count() == 0
    topic.publish(spark.createDataFrame([(None, None, 1), ("", "é" * 200_000, 2)], "k string, v string, seq long"), path, "k", "v", "seq", 5)
    assert [(r.key, r.value and len(r.value), r.offset) for r in topic.read_topic(spark, path).orderBy("offset").collect()] == [(None, None, 0), ("", 200_000, 1)]


def test_restart_in_mid_log(spark, sf_dir, tmp_path):
    path, out, ck = str(tmp_path / "t"), tmp_path / "out", tmp_path / "ck"
    log = view(spark, sf_dir, "mutation_log").where("topic = 'documents.mutations'")
    cut = 400
    topic.publish(log.where(F.col("log_offset") < cut), path, "document_id", "payload", "log_offset", 3)
    source = lambda: jsonl.mutation_source(spark, format=topic.FORMAT, path=path)
    assert started(source(), "first", ck, out).lastProgress["numInputRows"] == log.where(F.col("log_offset") < cut).count()
    topic.publish(log.where(F.col("log_offset") >= cut), path, "document_id", "payload", "log_offset", 3)
    q = started(source(), "second", ck, out)
    assert sum(p["numInputRows"] for p in q.recentProgress) == log.where(F.col("log_offset") >= cut).count()
    assert rows(spark.read.parquet(str(out)), "payload") == rows(log, "payload")
    assert started(source(), "third", ck, out).lastProgress["numInputRows"] == 0


def test_sink_and_batch_again(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    topic.publish(spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("v"), "id"), first, "k", "v", "id", 2)
    events = topic.read_topic(spark, first, stream=True).select(F.col("key").cast("long").alias("document_id"), F.col("value").alias("payload"))
    q = jsonl.mutation_sink(events, str(tmp_path / "ck"), {"partitions": "4"}, topic.FORMAT, second)
    q.awaitTermination(240)
    assert q.exception() is None and rows(topic.read_topic(spark, second), "value") == rows(topic.read_topic(spark, first), "value")
    log = topic.TopicLog(second)
    before = log.ends()
    assert len(before) == 4
    # a batch that is committed again, as after a crash, adds nothing and leaves no file
    log.fs.copy_file(f"{log.root}/data/{log.commit(1)['files'][0][3]}", f"{log.root}/data/again.parquet")
    log.append([topic._Written(0, [(0, "again.parquet", 5)]), None], str(tmp_path / "ck"), 0)
    assert topic.TopicLog(second).ends() == before and not (tmp_path / "b/data/again.parquet").exists()
    # two writers that take one number
    late = topic.TopicLog(second)
    late.version()
    late.version = lambda: 0
    with pytest.raises(RuntimeError, match="another writer"):
        late.append([topic._Written(0, [(0, "x", 1)])])


def test_live_figures(spark, sf_dir, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    log = view(spark, sf_dir, "attempt_log")
    payload = F.to_json(F.struct("topic", "message_id", "seq", "ok")).alias("payload")
    events = log.select("message_id", payload, "seq")
    cuts = [0, 300, 650, 10**9]
    listener = L.FigureTables(spark, kept)
    spark.streams.addListener(listener)
    lags = []
    try:
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            topic.publish(events.where(f"seq >= {a} and seq < {b}"), path, "message_id", "payload", "seq", 3)
            if n:
                # what the consumer has not read yet, against the batch twin over its last offsets
                lags.append(L.lag_now(spark.read.parquet(f"{kept}/offsets"), topic.TopicLog(path).ends()).where("consumer_group = 'delivery-test'").first().lag)
            raw = topic.read_topic(spark, path, stream=True).select(F.from_json("value", "topic string, message_id long, seq long, ok boolean").alias("e")).select("e.*")
            attempts = raw.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
            made = L.observe_delivery(W.delivery_attempts(attempts), ["topic-0"])
            q = started(made, "delivery-test", tmp_path / "ck", tmp_path / "out")
            until = time.time() + 60
            while time.time() < until:
                try:
                    if spark.read.parquet(f"{kept}/offsets").where(F.col("run_id") == str(q.runId)).count():
                        break
                except Exception:  # noqa: BLE001 - nothing is written yet
                    pass
                time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    cols = ["published", "delivered", "acknowledged", "retried", "dead_lettered", "depth"]
    want = O.broker_stats(log).withColumn("topic", F.when(F.col("topic") == "topic-0", F.col("topic")))
    assert rows(L.live_broker_stats(spark.read.parquet(f"{kept}/figures"), "delivery-test"), "topic", *cols) == rows(want, "topic", *cols)
    ends = [log.where(f"seq >= {a} and seq < {b}").count() for a, b in zip(cuts[1:], cuts[2:])]
    assert lags == ends
    offsets = spark.read.parquet(f"{kept}/offsets")
    assert L.live_samples(offsets).count() >= 9 and L.live_lag(offsets).where("lag <> 0").count() == 0
    last = offsets.orderBy(F.desc("batch")).first().batch
    assert {str(r.part): r.current_offset for r in offsets.where(F.col("batch") == last).collect()} == topic.TopicLog(path).ends()
    samples = [(0, "g", 0, 2, 10, 7), (0, "g", 1, 3, 9, None)]
    assert D.consumer_lag(spark.createDataFrame(samples, "sample_index int, consumer_group string, part int, log_start_offset long, log_end_offset long, current_offset long")).first().lag == 9


def test_sketches(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir.replace("sf0.001", "sf0.1"), "request_log")
    T.latency_sketches(log, 600).write.parquet(str(tmp_path / "sk"))
    kept = spark.read.parquet(str(tmp_path / "sk"))
    for keys in ((), ("node_id",)):
        found = T.sketch_percentiles(kept, keys)
        if keys:
            off = T.sketch_rank_errors(log, found, keys).collect()
        else:
            one = F.lit(0).alias("g")
            off = T.sketch_rank_errors(log.withColumn("g", one), found.withColumn("g", one), ("g",)).collect()
        assert off and all(r[m] < 0.01 for r in off for m in T.PERCENTILES)
        exact = log.where("success").groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))
        assert rows(found, *keys, "samples", "min_ms", "max_ms") == rows(exact, *keys, "samples", "min_ms", "max_ms")
    # a range of spans is the union of its sketches
    mid = kept.agg(F.percentile("span", 0.5).cast("long")).first()[0]
    part = log.where(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(600)) * 600 <= mid)
    off = T.sketch_rank_errors(part, T.sketch_percentiles(kept.where(F.col("span") <= mid), ("node_id",)), ("node_id",)).collect()
    assert off and all(r[m] < 0.01 for r in off for m in T.PERCENTILES)


def test_sketches_of_odd_rows(spark):
    schema = "node_id long, ts timestamp, success boolean, latency_ms double, sketch string"
    data = [(1, "2024-01-01 00:00:00", True, float(x), "clash") for x in (5, 5, 5, 9)] + [(1, "2024-01-01 00:00:00", True, None, ""), (1, "2024-01-01 00:00:00", True, float("nan"), ""), (2, None, True, 1.0, ""), (None, "2024-01-01 00:00:00", True, 3.0, ""), (3, "2024-01-01 00:00:00", False, 3.0, "")]
    log = spark.createDataFrame([(n, t, s, x, c) for n, t, s, x, c in data], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    found = {r.node_id: r for r in T.sketch_percentiles(T.latency_sketches(log), ("node_id",)).collect()}
    assert set(found) == {1, None} and (found[1].samples, found[1].p50_ms, found[1].max_ms) == (4, 5.0, 9.0)
    assert T.sketch_percentiles(T.latency_sketches(log.limit(0))).count() == 0
