"""Golden cases and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import audit as D
from quern.operators import index as I
from quern.operators import mutations as M
from quern.operators import outbox as O  # noqa: E741
from quern.operators import search as S
from quern.operators import telemetry as T

FIVE = [(1, "the cat sat on the mat"), (2, "the dog chased the cat"), (3, "the cat and the dog played"), (4, "a bird sang on the hill"), (5, "the mat was blue")]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "document_id long, content string").withColumn("shard_id", F.col("document_id") % 2)


@pytest.fixture(scope="module")
def postings(five):
    return I.build_postings(five).cache()


def ids(df):
    return sorted(r.document_id for r in df.collect())


@pytest.mark.parametrize(
    ("mode", "query", "want"),
    [("and", "cat dog", [2, 3]), ("or", "cat dog", [1, 2, 3]), ("and", "the cat", [1, 2, 3]), ("and", "cat mat", [1]), ("or", "bird hill", [4]), ("and", "the bird mat", []), ("or", "bird mat hill", [1, 4, 5]), ("and", "cat zzz", []), ("or", "!!!", []), ("and", "CAT, cat!", [1, 2, 3])],
)
def test_boolean_queries(postings, mode, query, want):
    assert ids(S.boolean_query(postings, query, mode)) == want


def test_ranked_and_scores(five):
    rows = S.search(five, "cat dog", "and", 10).collect()
    want = math.log(5 / 3) + math.log(5 / 2)
    assert [r.document_id for r in rows] == [2, 3] and all(math.isclose(r.score, want) for r in rows)


def test_scores_of_one_and_all_documents(spark):
    two = spark.createDataFrame([(1, "cat"), (2, "dog")], "document_id long, content string")
    assert [(r.document_id, round(r.score, 9)) for r in S.search(two, "cat").collect()] == [(1, round(math.log(2), 9))]
    one = two.where("document_id = 1")
    assert [(r.document_id, r.score) for r in S.search(one, "cat").collect()] == [(1, 0.0)]
    tf = spark.createDataFrame([(1, "cat"), (2, "cat " * 5), (3, "cat cat"), (4, "x")], "document_id long, content string")
    assert [r.document_id for r in S.search(tf, "cat").collect()] == [2, 3, 1]


def test_search_rejects_blank_and_takes_punctuation(five):
    with pytest.raises(ValueError):
        S.search(five, " \t")
    with pytest.raises(ValueError):
        S.search(five, "cat", limit=0)
    assert S.search(five, "!!!").count() == 0


def test_tokens(spark):
    cases = ["Search-engine, SEARCH!", "", None, "a1B2", "straße", "Kb", "naïve café", "_x_"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r[0] for r in df.select(X.tokens(F.col("c"))).collect()]
    assert got == [["search", "engine", "search"], [], [], ["a1b2"], ["stra", "e"], ["b"], ["na", "ve", "caf"], ["x"]]


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
def test_sharding_does_not_change_results(spark, five, postings, shards):
    requests = spark.createDataFrame([(1, "the cat", "or", 10), (2, "mat the", "and", 3), (3, "dog", "", 100)], "query_id int, query string, mode string, lim int")
    split = five.withColumn("shard_id", F.pmod("document_id", F.lit(shards)))
    want = sorted(map(tuple, S.search_batch(requests, postings, I.corpus_size(five)).collect()))
    assert sorted(map(tuple, S.sharded_search(requests, split).collect())) == want
    for q, text, mode in ((1, "the cat", "or"), (2, "mat the", "and")):
        alone = [(r.document_id, r.score) for r in S.search(five, text, mode, 10).collect()]
        assert alone[:3] == [(d, s) for i, _, d, s in want if i == q][:3]


def test_and_within_or_and_order_of_build(five, postings):
    assert set(ids(S.boolean_query(postings, "the cat mat", "and"))) <= set(ids(S.boolean_query(postings, "the cat mat", "or")))
    again = I.build_postings(five.orderBy(F.desc("document_id")).repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, postings.collect()))


def test_stored_postings_answer_like_fresh_ones(spark, five, postings, tmp_path):
    I.write_postings(postings, str(tmp_path / "p"), 2)
    stored = I.read_postings(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, postings.select(stored.columns).collect()))
    few = I.read_postings(spark, str(tmp_path / "p"), "cat", "dog")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [cat,dog])]" in plan
    fresh = S.search(five, "cat dog", "or", None).collect()
    assert [tuple(r) for r in S.search(five, "cat dog", "or", None, few).collect()] == [tuple(r) for r in fresh] and fresh


def test_update_index_equals_rebuild(spark, five, postings):
    changed = spark.createDataFrame([(2, "a new cat"), (9, "fresh text")], "document_id long, content string")
    rebuilt = I.build_postings(five.select("document_id", "content").where("document_id <> 2").unionByName(changed))
    assert sorted(map(tuple, I.update_index(postings, changed).collect())) == sorted(map(tuple, rebuilt.collect()))


def test_partial_shards(spark):
    corpus = spark.createDataFrame([(100, "quantum", 0), (101, "other", 0), (102, "more", 0), (200, "quantum", 1)], "document_id long, content string, shard_id long")
    health = spark.createDataFrame([(0, 0, 0, True, True), (1, 0, 1, False, False), (1, 1, 2, False, True)], "shard_id long, replica_rank int, node_id int, count_ok boolean, search_ok boolean")
    q = spark.createDataFrame([(1, "quantum", "or", 10)], "query_id int, query string, mode string, lim int")
    rows = S.partial_search(q, corpus, health).collect()
    assert [(r.document_id, round(r.score, 9), r.complete) for r in rows] == [(100, round(math.log(3), 9), False)]
    bad = sorted(tuple(r) for r in S.failure_rows(q, corpus, health).collect())
    assert bad == [(1, 1, 1, "count_failure", ""), (1, 1, 1, "search_failure", "quantum")]


def test_write_outcomes_and_tables(spark, five):
    batch = spark.createDataFrame([(1, 9, "new text"), (2, 9, "again"), (3, 1, "clash"), (4, 8, " \n"), (5, 8, "after blank")], "seq long, document_id long, content string")
    got = {r.seq: (r.status, r.terms_indexed) for r in M.ingest_documents(batch, five).collect()}
    assert got == {1: ("created", 2), 2: ("conflict", 0), 3: ("conflict", 0), 4: ("invalid", 0), 5: ("created", 2)}
    assert {r.document_id: r.content for r in M.ingested_table(batch, five).collect()} == {**dict(FIVE), 9: "new text", 8: "after blank"}
    up = {r.seq: r.status for r in M.update_documents(batch, five).collect()}
    assert up == {1: "not_found", 2: "not_found", 3: "updated", 4: "invalid", 5: "not_found"}
    assert {r.document_id: r.content for r in M.updated_table(batch, five).collect()}[1] == "clash"
    gone = {r.seq: r.status for r in M.delete_documents(batch.withColumn("document_id", F.lit(1)), five).collect()}
    assert gone == {1: "deleted", 2: "not_found", 3: "not_found", 4: "not_found", 5: "not_found"}
    events = M.emit_mutation_events(M.ingest_documents(batch, five), base=7).orderBy("event_id").collect()
    assert [(r.event_id, r.document_id) for r in events] == [(7, 9), (8, 8)]


def test_numbering_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "NUMBER_RANGE", 10)
    df = spark.range(0, 95).where("id % 3 <> 1").withColumnRenamed("id", "seq")
    rows = M.number_rows(df, "seq").orderBy("seq").collect()
    assert [r.event_id for r in rows] == list(range(1, len(rows) + 1))


def test_apply_is_the_ordered_fold(spark):
    import random

    from quern.streaming.mutations import step

    rng = random.Random(3)
    log = [(i, rng.randrange(6), rng.choice(M.TYPES), rng.choice(["a", "b", "c", " ", ""])) for i in range(600)]
    got = {r.event_id: (r.outcome, r.content_after) for r in M.apply_mutations(spark.createDataFrame(log, "event_id long, document_id long, event_type string, content string").withColumn("log_offset", F.col("event_id"))).collect()}
    state = {}
    for i, d, kind, content in log:
        state[d], outcome = step(state.get(d), kind, content)
        assert got[i] == (outcome, state[d]), i


def test_outbox_transitions(spark):
    log = [(1, 1, "mark_published"), (1, 2, "mark_dispatching"), (1, 3, "record_attempt"), (1, 4, "mark_failed"), (1, 5, "requeue"), (1, 6, "requeue"), (2, 1, "record_attempt"), (3, 2, "mark_published"), (3, 1, "mark_dispatching")]
    got = {r.outbox_id: (r.status, r.attempt_count, r.retried) for r in O.replay_transitions(spark.createDataFrame(log, "outbox_id long, seq long, action string")).collect()}
    assert got == {1: ("PENDING", 1, 1), 2: ("PENDING", 1, 0), 3: ("PUBLISHED", 0, 0)}


def test_outbox_folds_by_ranges_like_one_fold(spark):
    import random

    rng = random.Random(5)
    actions = ["mark_dispatching", "mark_published", "mark_failed", "requeue", "record_attempt"]
    log = [(rng.randrange(3), seq, rng.choice(actions)) for seq in rng.sample(range(4_000), 900)]
    moves = {("mark_dispatching", "PENDING"): "DISPATCHING", ("mark_published", "DISPATCHING"): "PUBLISHED", ("mark_failed", "DISPATCHING"): "FAILED", ("requeue", "FAILED"): "PENDING"}
    want = {k: ["PENDING", 0, 0] for k in range(3)}
    for k, _, action in sorted(log, key=lambda x: x[1]):
        s = want[k]
        s[1] += action == "record_attempt"
        s[2] += (action, s[0]) == ("requeue", "FAILED")
        s[0] = moves.get((action, s[0]), s[0])
    got = O.replay_transitions(spark.createDataFrame(log, "outbox_id long, seq long, action string"), fold_range=4).collect()
    assert {r.outbox_id: [r.status, r.attempt_count, r.retried] for r in got} == want


@pytest.mark.parametrize("seconds", [1, 7, 10_000])
def test_reports_by_ranges_of_time_do_not_depend_on_the_ranges(spark, seconds):
    import random

    rng = random.Random(seconds)
    rows = [(i, i % 2, rng.random() < 0.3, rng.choice(["Open", "Closed", "HalfOpen"]), i // 3) for i in range(300)]
    log = spark.createDataFrame(rows, "request_id long, node_id long, success boolean, circuit_state string, t long").withColumn("ts", F.timestamp_seconds("t"))
    trips, moves = set(), {}
    for node in (0, 1):
        run, before, opened, closed = 0, "Closed", 0, 0
        for i, n, ok, state, _ in rows:
            if n == node:
                run = 0 if ok else run + 1
                if run == 3:
                    trips.add((node, i))
                opened += state == "Open" and before != "Open"
                closed += state != "Open" and before == "Open"
                before = state
        moves[node] = (opened, closed)
    assert {(r.node_id, r.request_id) for r in T.failure_trips(log, 3, seconds).collect()} == trips and trips
    assert {r.node_id: (r.open_events, r.close_events) for r in T.breaker_transitions(log, seconds).collect()} == moves


def test_order_statistics(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": np.repeat([3.0, -2.0], [40, 41]), "c": np.array([7.0]), None: rng.exponential(1e5, 77).round()}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    picks = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "f95": 0.95}
    got = {r.k: r for r in T.order_statistics(df, "v", ("k",), picks, ("f95",)).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, q in picks.items():
            want = np.quantile(vs, q, method="linear") if name != "f95" else np.sort(vs)[int(np.floor(q * (len(vs) - 1)))]
            assert math.isclose(got[k][name], want, rel_tol=1e-12, abs_tol=1e-12), (k, name)
    one = T.order_statistics(df.where("k = 'b'"), "v", (), {"p50": 0.5}).collect()
    assert [r.p50 for r in one] == [-2.0] and T.order_statistics(df.where("k = 'd'"), "v", ("k",), picks).count() == 0


def test_p99_takes_the_floor_index(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(10)], "request_id long, latency_ms double").withColumn("ts", F.current_timestamp())
    assert T.latency_last_n(log).first().p99_ms == 8.0
    assert T.latency_last_n(log, 3).first().sample_count == 3


def test_placement_and_lag_rules(spark):
    shards = spark.range(3).withColumnRenamed("id", "shard_id")
    p = D.replica_placement(shards)
    assert D.placement_violations(p).count() == 0
    broken = spark.createDataFrame([(0, 0), (0, 0), (5, 1), (5, 9)], "shard_id long, node_id long")
    rules = {(r.rule, r.shard_id) for r in D.placement_violations(broken).collect()}
    assert rules == {("duplicate_node", 0), ("shard_out_of_range", 5), ("node_out_of_range", 5), ("shard_missing", 1), ("shard_missing", 2)}
    with pytest.raises(ValueError):
        D.replica_placement(shards, nodes=2, replicas=3)
    with pytest.raises(ValueError):
        D.shard_routing(shards, 0)
    low = spark.createDataFrame([(0, "g", 0, 4, 10, 6), (0, "g", 1, 3, 5, None), (0, "h", 0, 4, 4, 9)], "sample_index long, consumer_group string, part long, log_start_offset long, log_end_offset long, current_offset long")
    assert {r.consumer_group: r.lag for r in D.consumer_lag(low).collect()} == {"g": 6, "h": 0}
    samples = spark.createDataFrame([(0, "drain", "g", 0, 10, 4, False), (0, "drain", "g", 1, 5, None, False), (1, "drain", "g", 0, 10, 12, False), (1, "drain", "g", 1, None, 3, False)], "sample_index long, phase string, consumer_group string, part long, log_end_offset long, current_offset long, query_failed boolean")
    assert {r.sample_index: r.lag for r in D.total_lag(D.partition_lag(samples)).collect()} == {0: 11, 1: None}
