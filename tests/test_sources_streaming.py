import json
import os
import random

from pyspark.sql import functions as F

from quern.operators import index as I
from quern.operators import mutations as M
from quern.operators import outbox as O  # noqa: E741
from quern.plans.views import view
from quern.sources import jsonl
from quern.streaming import mutations as W


def test_documents_jsonl(spark, tmp_path):
    lines = ['{"id":1,"content":"a"}', "", '{"id":1,"content":"again"}', "not json", '{"content":"x"}', '{"id":-1,"content":"x"}', '{"id":1.5,"content":"x"}', '{"id":"3","content":"x"}', '{"id":4}', '{"id":5,"content":5}', '{"id":4294967295,"content":"é\\n"}', '{"id":4294967296,"content":"x"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    docs, rejects = jsonl.load_documents(spark, str(tmp_path / "in.jsonl"))
    assert {r.document_id: r.content for r in docs.collect()} == {1: "a", 4294967295: "é\n"}
    assert rejects.count() == 9 and rejects.where("reason = 'duplicate id'").count() == 1
    jsonl.save_documents(docs, str(tmp_path / "out"))
    back, none = jsonl.load_documents(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect())) and none.count() == 0


def test_outbox_jsonl(spark, tmp_path):
    lines = ['{"id":2,"topic":"t","status":"FAILED","attempt_count":3}', '{"id":1,"topic":"t","status":"odd","key":"k"}', '{"id":2,"topic":"u","status":"PENDING"}', '{"id":3,"status":"PENDING"}']
    (tmp_path / "o.jsonl").write_text("\n".join(lines))
    rows = {r.id: r for r in jsonl.load_outbox(spark, str(tmp_path / "o.jsonl")).collect()}
    assert set(rows) == {1, 2} and rows[1].status == "PENDING" and rows[2].attempt_count == 3 and rows[1].payload == ""
    jsonl.save_outbox(spark.createDataFrame(list(rows.values())), str(tmp_path / "out"))
    assert [r.id for r in spark.read.json(str(tmp_path / "out/events")).orderBy("id").collect()] == [1, 2]
    assert spark.read.json(str(tmp_path / "out/meta")).first().next_id == 3


def test_report_csv(spark, tmp_path):
    jsonl.write_report_csv(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["a", "b"]


def write_topic(log, folder, files=3):
    """Files in the order of the log, the rows of each shuffled; the second file comes twice."""
    rows = log.select("topic", F.col("payload").alias("value"), F.col("log_offset").alias("offset"), F.lit(0).alias("partition")).orderBy("offset").collect()
    size, rng = -(-len(rows) // files), random.Random(1)
    for n, k in enumerate([*range(files), 1]):
        part = rows[k * size : (k + 1) * size]
        rng.shuffle(part)
        (folder / f"f{n}.json").write_text("\n".join(json.dumps(r.asDict()) for r in part))
        os.utime(folder / f"f{n}.json", (1_000_000 + n, 1_000_000 + n))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    log = view(spark, sf_dir.replace("sf0.001", "sf0.01"), "mutation_log").where("log_offset < 1500")  # ids clash beyond 1000
    write_topic(log, tmp_path / "in")
    source = lambda: jsonl.mutation_source(spark, {"maxFilesPerTrigger": "1"}, "json", str(tmp_path / "in"))
    q = W.index_mutations(source()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    got = sorted((r.log_offset, r.document_id, r.event_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    events = M.candidates(log)
    want = sorted((r.log_offset, r.document_id, r.event_id, r.outcome) for r in M.apply_mutations(events).collect())
    assert got == want and {r[3] for r in want} == {"Applied", "Skipped", "Failed"}
    assert len({r[2] for r in want}) < len(want)  # ids of events clash
    W.keep_index(W.index_mutations(source()), str(tmp_path / "kept"), str(tmp_path / "ck2")).awaitTermination(240)
    docs = M.materialize_documents(events)
    assert sorted(map(tuple, W.kept_documents(spark, str(tmp_path / "kept")).collect())) == sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, W.kept_postings(spark, str(tmp_path / "kept")).collect())) == sorted(map(tuple, I.build_postings(docs).collect()))


def test_topic_sink(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "document_id long, payload string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("document_id long, payload string").parquet(str(tmp_path / "in"))
    jsonl.mutation_sink(source, str(tmp_path / "ck"), format="json", path=str(tmp_path / "out")).awaitTermination(240)
    rows = sorted((r.key, r.value, r.topic) for r in spark.read.schema("key string, value string, topic string").json(str(tmp_path / "out")).collect())
    assert rows == [("1", "a", "documents.mutations"), ("2", None, "documents.mutations")]


def test_running_metrics(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir, "request_log")
    rows = log.orderBy("ts", "request_id").collect()
    half = len(rows) // 2
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, log.schema).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part*")).rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.running_metrics(source, 50).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out{i}"))).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(240)
    for i, upto in ((0, half), (1, len(rows))):
        for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect():
            mine = [x for x in rows[:upto] if x.node_id == r.node_id]
            last = sorted([x.latency_ms for x in mine if x.success][-50:])
            assert (r.requests, r.accepted) == (len(mine), sum(x.success for x in mine)) and r.recent_p99_ms == last[int(0.99 * (len(last) - 1))]


def test_dead_letter_stream_equals_batch(spark, sf_dir, tmp_path):
    log = view(spark, sf_dir, "attempt_log").where("seq < 600").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    log.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = W.split_dead_letters(W.deliver(source), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "ck"))
    q.awaitTermination(240)
    got = sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "dead")).collect())
    assert got == sorted(r.message_id for r in O.dead_letters(log).collect()) and got


def test_delivery_forgets_old_messages(spark, tmp_path):
    hour = 3600
    rows = [(1, 1, False, 0), (2, 2, True, 0), (3, 3, True, 9 * hour), (4, 4, True, 10 * hour), (2, 5, True, 10 * hour), (1, 6, False, 10 * hour), (1, 7, False, 10 * hour + 1)]
    for n, part in enumerate((rows[:2], rows[2:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "message_id long, seq long, ok boolean, t long").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part*")).rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    source = spark.readStream.schema("message_id long, seq long, ok boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.split_dead_letters(W.deliver(source, 2, "1 hour", 2.0), str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    good = sorted((r.message_id, r.seq) for r in spark.read.parquet(str(tmp_path / "good")).collect())
    # message 2 was forgotten, so it counts anew; the first failure of 1 no longer counts
    assert good == [(2, 2), (2, 5), (3, 3), (4, 4)]
    assert [(r.seq, r.attempts) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [(7, 2)]


def test_stream_dedup_and_windows(spark, sf_dir, tmp_path):
    events = view(spark, sf_dir, "events").limit(300)
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = W.dedup_messages(source, horizon="3650 days").writeStream.format("memory").queryName("quern_dedup").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("quern_dedup").count() == 300
    log = view(spark, sf_dir, "request_log")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = W.request_metrics(source).writeStream.format("memory").queryName("quern_metrics").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("quern_metrics").agg(F.sum("requests")).first()[0] == log.count()
