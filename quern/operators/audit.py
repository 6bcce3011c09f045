"""Consumer lag, propagation, replica placement and consistency audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from .telemetry import order_statistics


def partition_lag(samples: DataFrame) -> DataFrame:
    """samples with lag and failed: end - current, at least 0; end if nothing is committed; null without an end."""
    end, cur = F.col("log_end_offset"), F.col("current_offset")
    lag = F.when(F.col("query_failed") | end.isNull(), F.lit(None).cast("long")).otherwise(F.greatest(F.lit(0), end - F.coalesce(cur, F.lit(0))))
    return samples.withColumn("lag", lag.cast("long")).withColumn("failed", lag.isNull())


def _strict(agg) -> Column:
    """An aggregate of lag that is null if any part failed."""
    return F.when(F.bool_or("failed"), F.lit(None)).otherwise(agg)


def group_lag(lags: DataFrame) -> DataFrame:
    return lags.groupBy("sample_index", "phase", "consumer_group").agg(_strict(F.sum("lag")).alias("lag"))


def max_partition_lag(lags: DataFrame) -> DataFrame:
    """The largest lag of each partition over the groups of a sample."""
    return lags.groupBy("sample_index", "phase", "part").agg(_strict(F.max("lag")).alias("lag"))


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.groupBy("sample_index", "phase").agg(_strict(F.sum("lag")).alias("lag"), F.bool_or("failed").alias("failed"))


def lag_summary(lags: DataFrame) -> DataFrame:
    """Per group: mean lag under load, largest lag, last lag of the drain, failed samples, PASS or FAIL.

    Only samples in which no query failed count; a sample is one moment over all groups.
    """
    groups, totals = group_lag(lags), total_lag(lags).select("sample_index", F.col("failed").alias("bad"), F.col("lag").alias("total"))
    both = groups.join(totals, "sample_index")
    ok, drain = ~F.col("bad"), F.col("phase") == "drain"
    load = F.col("phase").isin("workload", "workload_end")
    final = F.max_by("total", F.when(ok & drain, F.col("sample_index")))
    out = both.groupBy("consumer_group").agg(
        F.round(F.avg(F.when(ok & load, F.col("lag"))), 2).alias("mean_lag"),
        F.max(F.when(ok, F.col("lag"))).alias("max_lag"),
        F.max_by("lag", F.when(ok & drain, F.col("sample_index"))).alias("final_lag"),
        F.count(F.when(F.col("bad"), 1)).alias("failed_samples"),
        final.alias("_final"),
    )
    return out.withColumn("status", F.when(F.coalesce(F.col("_final"), F.lit(1)) == 0, "PASS").otherwise("FAIL")).drop("_final")


def drain_time(lags: DataFrame, limit: int = 15) -> DataFrame:
    """Samples from the start of the drain to the first without lag, and whether the limit is passed."""
    d = total_lag(lags).where("phase = 'drain'")
    out = d.agg(F.min("sample_index").alias("drain_start"), F.min(F.when(F.col("lag") == 0, F.col("sample_index"))).alias("drained_at"))
    took = F.col("drained_at") - F.col("drain_start")
    return out.select("drain_start", "drained_at", took.alias("took"), (took.isNull() | (took > limit)).alias("timed_out"))


def final_lag_verdict(lags: DataFrame) -> DataFrame:
    """For each sample, whether it would do as the final one: no failure and no lag."""
    t = total_lag(lags)
    message = F.when(F.col("failed"), "query failed").when(F.col("lag").isNull(), "unknown").when(F.col("lag") != 0, F.concat(F.lit("remaining lag = "), F.col("lag").cast("string"))).otherwise("reached zero")
    return t.select("sample_index", F.coalesce(~F.col("failed") & (F.col("lag") == 0), F.lit(False)).alias("passed"), message.alias("message"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Per sample and group, the sum over partitions of high - position; without a position high - low.

    offsets: log_start_offset (low), log_end_offset (high), current_offset (position).
    """
    lag = F.greatest(F.lit(0), F.col("log_end_offset") - F.coalesce("current_offset", "log_start_offset"))
    return offsets.groupBy("sample_index", "consumer_group").agg(F.sum(lag).alias("lag"))


def propagation_latency(log: DataFrame) -> DataFrame:
    """Per mutation: latency to each node and to both, from write end and from publishing; a missing node is a timeout."""
    part = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(b))
    timeout = F.col("t_node1").isNull() | F.col("t_node2").isNull()
    both = F.greatest("t_node1", "t_node2")
    late = lambda b: F.when(~timeout, F.round(F.greatest(F.lit(0.0), both - F.col(b)), 6))
    node = lambda t: F.when(F.col(t).isNotNull(), F.round(part(t, "t_write_done"), 6))
    return log.select("document_id", node("t_node1").alias("node1"), node("t_node2").alias("node2"), late("t_write_done").alias("both_nodes"), late("t_published").alias("from_publish"), timeout.alias("timeout"))


def propagation_summary(log: DataFrame) -> DataFrame:
    """Mutations, timeouts, and quantiles of the latency to both nodes, in one row."""
    p = propagation_latency(log)
    picks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counted = p.agg(F.count(F.lit(1)).alias("mutations"), F.count(F.when(F.col("timeout"), 1)).alias("timeouts"), F.max("both_nodes").alias("most"))
    stats = order_statistics(p, "both_nodes", (), picks).select(*[F.round(m, 6).alias(m) for m in picks])
    return counted.join(F.broadcast(stats), how="left")  # a row each


def content_key(content: str = "content") -> Column:
    """A digest that stands for a content in joins; an absent document (null) has one of its own."""
    return F.coalesce(F.sha2(F.col(content), 256), F.lit("-"))


def visibility_columns(first_seen: DataFrame, timeout_s: int, nodes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Latencies of writes from write_id, document_id and microseconds _t (write) and _seen0, _seen1, ...

    Node 0 is the topic. A write must be published within the timeout, and stand on each node
    within the timeout after that; error names what was missed.
    """
    limit = F.lit(timeout_s * 1_000_000)
    since = lambda to, t: F.when(to.isNotNull(), F.greatest(F.lit(0), to - t)).cast("long")
    published = F.when(F.col("_seen0") <= F.col("_t") + limit, F.col("_seen0"))
    df = first_seen.withColumn("_published", published)
    df = df.withColumns({f"_node{n}": F.when(F.col(f"_seen{n}") <= F.col("_published") + limit, F.col(f"_seen{n}")) for n in nodes})
    missed = F.concat_ws(", ", *[F.when(F.col(f"_node{n}").isNull(), F.lit(str(n))) for n in nodes])
    error = F.when(F.col("_published").isNull(), "not published").when(missed != "", F.concat(F.lit("missing on "), missed)).otherwise("")
    last = F.greatest(*[F.col(f"_node{n}") for n in nodes]) if len(nodes) > 1 else F.col(f"_node{nodes[0]}")
    df = df.withColumn("error", error).withColumn("_all", F.when(F.col("error") == "", last))
    return df.select(
        "write_id",
        "document_id",
        since(F.col("_published"), F.col("_t")).alias("publish_us"),
        *[since(F.col(f"_node{n}"), F.col("_t")).alias(f"node{n}_us") for n in nodes],
        since(F.col("_all"), F.col("_t")).alias("visible_us"),
        since(F.col("_all"), F.col("_published")).alias("from_publish_us"),
        "error",
    )


def write_visibility(writes: DataFrame, observations: DataFrame, timeout_s: int = 10, nodes: tuple[int, ...] = (1, 2), span_s: int = 600) -> DataFrame:
    """Per write, how long until the topic and each node first showed its content.

    writes: write_id (unique), document_id, content, t_write; observations: node_id (0 is the
    topic), document_id, content, t_seen. The first observation at or after the write with
    equal content counts; content null means an absent document. Writes without a time and
    observations without a time or document are left out; a write without a document is never seen.

    Both logs are cut into spans of time. The next observation is found inside a span by a
    running last value from the latest row back, beyond it by the first ones of later spans,
    so that no task sorts the whole log of a document.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = writes.schema["write_id"].dataType
    w = writes.select("write_id", F.col("document_id").cast("long").alias("document_id"), content_key().alias("_key"), at("t_write").alias("_t"), none("long").alias("_node"), F.lit(1).alias("_write"))
    o = observations.where("document_id is not null").select(none(kind).alias("write_id"), F.col("document_id").cast("long").alias("document_id"), content_key().alias("_key"), at("t_seen").alias("_t"), F.col("node_id").cast("long").alias("_node"), F.lit(0).alias("_write"))
    log = w.unionByName(o).where("_t is not null").withColumn("_span", F.floor(F.col("_t") / F.lit(span_s * 1_000_000)))
    watched = (0, *nodes)
    seen = {n: F.when((F.col("_write") == 0) & (F.col("_node") == n), F.col("_t")) for n in watched}
    key = ["document_id", "_key"]
    later = Window.partitionBy(*key).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = log.groupBy(*key, "_span").agg(*[F.min(seen[n]).alias(f"_first{n}") for n in watched])
    spans = spans.select(*key, "_span", *[F.last(f"_first{n}", True).over(later).alias(f"_later{n}") for n in watched])
    inside = Window.partitionBy(*key, "_span").orderBy(F.desc("_t"), "_write").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = log.withColumns({f"_near{n}": F.last(seen[n], True).over(inside) for n in watched}).where("_write = 1")
    found = asked.join(spans, [*key, "_span"], "left").withColumns({f"_seen{n}": F.coalesce(f"_near{n}", f"_later{n}") for n in watched})
    return visibility_columns(found, timeout_s, nodes)


def visibility_summary(visibility: DataFrame) -> DataFrame:
    """For each error, and none: writes, and quantiles of visible_us and from_publish_us."""
    picks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    visibility = stored(visibility, "visibility")  # read by the counts and both quantiles
    good = visibility.where("error = ''")
    out = visibility.groupBy("error").agg(F.count(F.lit(1)).alias("writes"), F.max("visible_us").alias("most_us"))
    for c, prefix in (("visible_us", "visible"), ("from_publish_us", "from_publish")):
        stats = order_statistics(good.withColumn(c, F.col(c).cast("double")), c, ("error",), picks)
        out = out.join(stats.select("error", *[F.round(m, 3).alias(f"{prefix}_{m}_us") for m in picks]), "error", "left")
    return out


def shard_routing(corpus: DataFrame, shards: int = 3) -> DataFrame:
    """Documents of each shard and their share against an even one."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    out = corpus.groupBy(F.pmod("document_id", F.lit(shards)).alias("shard_id")).agg(F.count(F.lit(1)).alias("documents"))
    total = F.sum("documents").over(Window.partitionBy())  # a row for each shard
    return out.select("shard_id", "documents", F.round(F.col("documents") * shards / total, 6).alias("skew"))


def replica_placement(shards: DataFrame, nodes: int = 3, replicas: int = 2) -> DataFrame:
    """shards (shard_id): rank r of a shard is on node (shard_id + r) % nodes; rank 0 is the primary."""
    if not 1 <= replicas <= nodes:
        raise ValueError("replicas must be between 1 and nodes")
    ranked = shards.select("shard_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica_rank"))
    return ranked.withColumn("node_id", F.pmod(F.col("shard_id") + F.col("replica_rank"), F.lit(nodes)))


def placement_violations(placement: DataFrame, shards: int = 3, nodes: int = 3, replicas: int = 2) -> DataFrame:
    """(rule, shard_id, node_id) for each broken rule of (shard_id, node_id) rows."""
    none = F.lit(None).cast("long")
    p = placement.select(F.col("shard_id").cast("long").alias("shard_id"), F.col("node_id").cast("long").alias("node_id"))
    row = lambda df, rule, s=None, n=None: df.select(F.lit(rule).alias("rule"), (F.col("shard_id") if s is None else s).alias("shard_id"), (F.col("node_id") if n is None else n).alias("node_id"))
    counts = p.groupBy("shard_id").agg(F.count(F.lit(1)).alias("k"))
    every = placement.sparkSession.range(shards).select(F.col("id").alias("shard_id"))
    return (
        row(p.where(~F.col("shard_id").between(0, shards - 1)).distinct(), "shard_out_of_range", n=none)
        .unionByName(row(p.where(~F.col("node_id").between(0, nodes - 1)), "node_out_of_range"))
        .unionByName(row(counts.where(F.col("k") != replicas), "replica_count", n=none))
        .unionByName(row(p.groupBy("shard_id", "node_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "duplicate_node"))
        .unionByName(row(every.join(p, "shard_id", "left_anti"), "shard_missing", n=none))
    )


def replica_audit(corpus: DataFrame, inventory: DataFrame, nodes: int = 3, replicas: int = 2) -> DataFrame:
    """Per node: copies expected, missing and unexpected, PASS or FAIL."""
    ranked = corpus.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("r"), "shard_id")
    expected = ranked.select("document_id", F.pmod(F.col("shard_id") + F.col("r"), F.lit(nodes)).cast("long").alias("node_id"), F.lit(True).alias("want"))
    held = inventory.select("document_id", F.col("node_id").cast("long").alias("node_id"), F.lit(True).alias("have"))
    both = expected.join(held, ["document_id", "node_id"], "full_outer")
    out = both.groupBy("node_id").agg(F.count("want").alias("expected"), F.count(F.when(F.col("have").isNull(), 1)).alias("missing"), F.count(F.when(F.col("want").isNull(), 1)).alias("unexpected"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("unexpected") == 0), "PASS").otherwise("FAIL"))


def replica_content_mismatch(inventory: DataFrame) -> DataFrame:
    """Documents whose copies differ, with the number of copies and of contents."""
    out = inventory.groupBy("document_id").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(F.sha2("content", 256)).alias("contents"))
    return out.where("contents > 1")


#: Buckets of ids that digests of replicas are summed by.
DIGEST_BUCKETS = 4096


def _prints(rows: DataFrame) -> DataFrame:
    """rows with `print`, the SHA-256 of id and content in hex, in place of content: null differs from an empty text."""
    text = F.concat_ws(":", F.col("document_id").cast("string"), F.coalesce(F.concat(F.lit("s"), "content"), F.lit("-")))
    return rows.withColumn("print", F.sha2(text, 256)).drop("content")


def _digests(copies: DataFrame, buckets: int) -> DataFrame:
    part = lambda k: F.conv(F.substring("print", k, 15), 16, 10).cast("decimal(20,0)")
    rows = copies.select("shard_id", F.col("node_id").cast("long").alias("node_id"), F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("bucket"), part(1).alias("a"), part(16).alias("b"))
    return rows.groupBy("shard_id", "node_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def replica_digests(copies: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(shard_id, node_id, bucket, n, digest) of copies (shard_id, node_id, document_id, content).

    A digest is the sum of the hashes of the bucket's rows, in any order; sums add up to digests of
    nodes and shards. Hashes are cut to 128 bits' worth in two numbers of 60 bits, summed as decimals.
    """
    return _digests(_prints(copies), buckets)


def _expected_copies(corpus: DataFrame, nodes: int, replicas: int) -> DataFrame:
    """(shard_id, node_id, document_id, print) as nodes should hold them; a text is hashed once, not for each copy."""
    ranks = _prints(corpus.select("document_id", "content", "shard_id")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return ranks.select("shard_id", F.pmod(F.col("shard_id") + F.col("r"), F.lit(nodes)).cast("long").alias("node_id"), "document_id", "print")


def differing_buckets(corpus: DataFrame, inventory: DataFrame, nodes: int = 3, replicas: int = 2, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(shard_id, node_id, bucket) in which what a node holds is not what it should hold, by digests alone."""
    want = _digests(_expected_copies(corpus, nodes, replicas), buckets)
    have = replica_digests(inventory, buckets).select("shard_id", "node_id", "bucket", *[F.col(c).alias(f"_{c}") for c in ("n", "a", "b")])
    both = want.join(have, ["shard_id", "node_id", "bucket"], "full_outer")
    same = (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    return both.where(~F.coalesce(same, F.lit(False))).select("shard_id", "node_id", "bucket")


def replica_differences(corpus: DataFrame, inventory: DataFrame, nodes: int = 3, replicas: int = 2, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(document_id, shard_id, node_id, difference): missing, unexpected or content.

    Digests of buckets are compared first; rows are joined only in those that differ, and
    carry the SHA-256 of their content, so no text is shuffled. An id held twice by a node
    is reported for each row that does not fit.
    """
    differ = differing_buckets(corpus, inventory, nodes, replicas, buckets)
    keys = ["shard_id", "node_id", "bucket"]
    at = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)))
    cells = lambda df, name: at(df).join(differ, keys, "left_semi").select("shard_id", "node_id", "document_id", F.unhex("print").alias(name))
    held = _prints(inventory.select("shard_id", F.col("node_id").cast("long").alias("node_id"), "document_id", "content"))
    both = cells(_expected_copies(corpus, nodes, replicas), "want").join(cells(held, "have"), ["shard_id", "node_id", "document_id"], "full_outer")
    what = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "content")
    return both.select("document_id", "shard_id", "node_id", what.alias("difference")).where("difference is not null")


def ambiguous_placement(corpus: DataFrame, inventory: DataFrame, nodes: int = 3) -> DataFrame:
    """Documents that the primaries of no shard or of several shards hold: (document_id, shards, problem).

    The primary of a shard is the node of its number. A document of zero shards can't be
    audited further, one of several is ambiguous.
    """
    primary = inventory.where(F.col("node_id") == F.pmod("shard_id", F.lit(nodes))).groupBy("document_id").agg(F.countDistinct("shard_id").alias("found"))
    ids = corpus.select("document_id").union(inventory.select("document_id")).distinct()
    out = ids.join(primary, "document_id", "left").withColumn("shards", F.coalesce("found", F.lit(0)))
    return out.where("shards <> 1").select("document_id", "shards", F.when(F.col("shards") == 0, "not_found").otherwise("ambiguous").alias("problem"))
