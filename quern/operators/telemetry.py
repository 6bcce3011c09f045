"""Reports over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _count(c) -> Column:
    return F.count(F.when(c, 1))


def _counters() -> list[Column]:
    search, write, bad = F.col("op") == "search", F.col("op") == "write", ~F.col("success")
    return [
        _count(search).alias("searches"),
        _count(search & bad).alias("search_errors"),
        _count(search & ~F.col("complete")).alias("search_incomplete"),
        _count(write).alias("writes"),
        _count(write & bad).alias("write_errors"),
    ]


def request_counters(log: DataFrame) -> DataFrame:
    return log.agg(*_counters())


def per_node_metrics(log: DataFrame) -> DataFrame:
    """Counters of each node; a retry is a 503 answer."""
    return log.groupBy("node_id").agg(*_counters(), _count(F.col("status_code") == 503).alias("retries"))


def failure_categories(log: DataFrame) -> DataFrame:
    """Failed requests by node, category and whether it is worth a retry."""
    failed = log.where(~F.col("success")).withColumn("category", X.failure_category(F.col("error_message")))
    return failed.withColumn("retryable", F.col("category").isin(*X.RETRYABLE)).groupBy("node_id", "category", "retryable").agg(F.count(F.lit(1)).alias("failures"))


def latency_last_n(log: DataFrame, n: int = 1000) -> DataFrame:
    """Average, p99 and number of the last n samples; p99 is the sorted sample at floor(0.99 * (n - 1))."""
    last = log.orderBy(F.desc("ts"), F.desc("request_id")).limit(n).select("latency_ms", "request_id")
    ranked = last.withColumn("r", F.row_number().over(Window.orderBy("latency_ms", "request_id"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    pick = F.floor(F.lit(0.99).cast("double") * (F.col("k") - 1)) + 1
    return ranked.agg(F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.max(F.when(F.col("r") == pick, F.col("latency_ms"))).alias("p99_ms"), F.count(F.lit(1)).alias("sample_count"))


#: Seconds of a log that are put in order together; a report over a longer log joins the edges of such ranges.
RANGE_SECONDS = 600


def _ranges(log: DataFrame, seconds: int) -> DataFrame:
    return log.withColumn("_range", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000 * seconds)))


def breaker_transitions(log: DataFrame, seconds: int = RANGE_SECONDS) -> DataFrame:
    """Per node, how often the breaker opened and how often it left Open; it starts Closed.

    Moves are counted inside ranges of time; those between two ranges come from their
    last and first states, a row for each node and range.
    """
    inside = Window.partitionBy("node_id", "_range").orderBy("ts", "request_id")
    opened = lambda now, before: (F.col(now) == "Open") & (F.col(before) != "Open")
    moved = _ranges(log, seconds).withColumn("before", F.lag("circuit_state").over(inside))
    at = F.struct("ts", "request_id")
    edges = moved.groupBy("node_id", "_range").agg(
        _count(opened("circuit_state", "before")).alias("o"), _count(opened("before", "circuit_state")).alias("c"), F.min_by("circuit_state", at).alias("first"), F.max_by("circuit_state", at).alias("last")
    )
    edges = edges.withColumn("before", F.lag("last", 1, "Closed").over(Window.partitionBy("node_id").orderBy("_range")))
    return edges.groupBy("node_id").agg(
        (F.sum("o") + _count(opened("first", "before"))).alias("open_events"), (F.sum("c") + _count(opened("before", "first"))).alias("close_events")
    )


def failure_trips(log: DataFrame, threshold: int = 5, seconds: int = RANGE_SECONDS) -> DataFrame:
    """Requests at which a node's run of failures reaches the threshold; a success ends the run.

    Runs are counted inside ranges of time; a run at the start of a range goes on from
    the failures that ended those before, a row for each node and range.
    """
    inside = Window.partitionBy("node_id", "_range").orderBy("ts", "request_id")
    island = F.sum(F.when(F.col("success"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = _ranges(log, seconds).select("node_id", "_range", "ts", "request_id", "success", island.alias("island"))
    tails = runs.groupBy("node_id", "_range", "island").agg(_count(~F.col("success")).alias("failed"))
    tails = tails.groupBy("node_id", "_range").agg(F.max_by("failed", "island").alias("tail"), (F.max("island") > 0).cast("int").alias("cut"))
    by_node = Window.partitionBy("node_id").orderBy("_range")
    tails = tails.withColumn("since", F.sum("cut").over(by_node))
    tails = tails.withColumn("carried", F.sum("tail").over(Window.partitionBy("node_id", "since").orderBy("_range")))
    carry = tails.select("node_id", "_range", F.lag("carried", 1, 0).over(by_node).alias("carry"))
    nth = F.row_number().over(Window.partitionBy("node_id", "_range", "island").orderBy("ts", "request_id"))
    failed = runs.where(~F.col("success")).withColumn("nth", nth).join(carry, ["node_id", "_range"])
    k = F.col("nth") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0)
    return failed.where(k == threshold).select("node_id", "request_id", "ts")


def order_statistics(df: DataFrame, value: str, keys: tuple[str, ...], picks: dict[str, float], floor: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles of a column: keys, and a column for each name in picks.

    A quantile q is interpolated at q * (n - 1), for names in floor taken at its floor.
    Null values don't count. Equal values are counted first and classed by magnitude
    (about 256 classes for each doubling); sums over the classes tell in which ones the
    wanted ranks lie, and only those are sorted, each for itself.
    """
    v = F.col("v")
    size = F.floor(F.least(F.log2(1 + F.abs(v)), F.lit(1e4)) * 256)
    part = F.when(F.isnan(v), F.lit(1 << 62)).otherwise(F.signum(v).cast("long") * size)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    values = df.where(F.col(value).isNotNull()).select(key.alias("_key"), F.col(value).cast("double").alias("v"))
    counts = values.groupBy("_key", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("part", part)
    parts = counts.groupBy("_key", "part").agg(F.sum("c").alias("c"))
    all_parts = Window.partitionBy("_key")
    parts = parts.withColumn("n", F.sum("c").over(all_parts)).withColumn("end", F.sum("c").over(all_parts.orderBy("part")))
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in picks.items()}
    # pos, and the two ranks it lies between
    want = F.array(*[F.struct(F.lit(m).alias("name"), (F.floor(x) if m in floor else x).cast("double").alias("pos"), up.alias("rank"), F.lit(i).alias("up")) for m, x in at.items() for i, up in enumerate((F.floor(x), F.floor(x) if m in floor else F.ceil(x)))])
    start = F.col("end") - F.col("c")
    here = parts.select("_key", "part", start.alias("start"), F.explode(F.filter(want, lambda w: (w["rank"] >= start) & (w["rank"] < F.col("end")))).alias("w"))
    wanted = here.groupBy("_key", "part", "start").agg(F.collect_list("w").alias("ws"))  # at most two entries for each pick
    upto = F.sum("c").over(Window.partitionBy("_key", "part").orderBy("v"))
    found = counts.join(wanted, ["_key", "part"]).withColumn("stop", F.col("start") + upto)
    found = found.select("_key", "v", F.explode(F.filter("ws", lambda w: (w["rank"] >= F.col("stop") - F.col("c")) & (w["rank"] < F.col("stop")))).alias("w"))

    def pick(name):
        mine = F.col("w.name") == name
        low, high = (F.max(F.when(mine & (F.col("w.up") == i), F.col("v"))) for i in (0, 1))
        pos = F.max(F.when(mine, F.col("w.pos")))
        return (F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))).alias(name)

    out = found.groupBy("_key").agg(*[pick(m) for m in picks])
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *picks)


PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def _with_percentiles(log: DataFrame, keys: tuple[str, ...], aggs: list[Column], picks: dict[str, float] = PERCENTILES, floor: tuple[str, ...] = ()) -> DataFrame:
    """aggs by keys over all rows, and quantiles of the latency of successful ones, in the order of names."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    counted = log.groupBy(key.alias("_key")).agg(*aggs) if keys else log.agg(*aggs).withColumn("_key", key)
    stats = order_statistics(log.where("success"), "latency_ms", keys, picks, floor)
    stats = stats.select(key.alias("_key"), *[F.round(m, 6).alias(m) if m not in floor else F.col(m) for m in picks])
    names = [c for c in counted.columns if c != "_key"]
    return counted.join(stats, "_key", "left").select(*[F.col(f"_key.{k}").alias(k) for k in keys], *names, *picks)


def latency_percentiles(log: DataFrame, *keys: str) -> DataFrame:
    """min, p50, p95, p99, mean and max of successful requests, interpolated on n - 1."""
    x = F.col("latency_ms")
    return _with_percentiles(log.where("success"), keys, [F.min(x).alias("min_ms"), F.round(F.avg(x), 6).alias("mean_ms"), F.max(x).alias("max_ms")])


#: Size of a sketch of latencies; a quantile's rank is off by less than about 0.4 % of the samples, rarely more.
SKETCH_SIZE = 800


def latency_sketches(log: DataFrame, seconds: int = 60, k: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable sketch of the latency of successful requests for each node and span of seconds.

    Null and NaN latencies and null times are left out. A sketch holds a few thousand
    values at most however many it stands for, so stored ones answer without the log.
    """
    good = log.where("success and ts is not null and latency_ms is not null and not isnan(latency_ms)")
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(seconds)) * F.lit(seconds)
    x = F.col("latency_ms").cast("double")
    return good.groupBy("node_id", span.cast("long").alias("span")).agg(F.count(F.lit(1)).alias("samples"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, keys: tuple[str, ...] = (), picks: dict[str, float] = PERCENTILES, k: int = SKETCH_SIZE) -> DataFrame:
    """samples, min, max and approximate quantiles over any union of stored sketches, by keys; no row without sketches."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("samples").cast("long").alias("samples"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sketch")
    )
    return merged.where("samples > 0").select(*keys, "samples", "min_ms", "max_ms", *[F.kll_sketch_get_quantile_double("_sketch", F.lit(q)).alias(m) for m, q in picks.items()])


def sketch_rank_errors(log: DataFrame, quantiles: DataFrame, keys: tuple[str, ...], picks: dict[str, float] = PERCENTILES) -> DataFrame:
    """How far the rank of each approximate quantile is from the asked one, as a share of the samples; 0 where it is hit.

    Equal samples share a span of ranks; a quantile inside the span is hit.
    """
    x = F.col("latency_ms")
    both = log.where("success and latency_ms is not null and not isnan(latency_ms)").select(*keys, "latency_ms").join(quantiles.select(*keys, *picks), list(keys))
    counts = [F.count(F.when(x < F.col(m), 1)).alias(f"_below_{m}") for m in picks] + [F.count(F.when(x <= F.col(m), 1)).alias(f"_upto_{m}") for m in picks]
    n = F.count(F.lit(1))
    out = both.groupBy(*keys).agg(n.alias("samples"), *counts)
    off = lambda m, q: F.greatest(F.lit(0.0), F.col(f"_below_{m}") / F.col("samples") - q, q - F.col(f"_upto_{m}") / F.col("samples"))
    return out.select(*keys, "samples", *[off(m, q).alias(m) for m, q in picks.items()])


def _summary() -> list[Column]:
    good = F.when(F.col("success"), F.col("latency_ms"))
    # microseconds as integers, so that both engines divide the same numbers
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(1e6)
    return [
        F.count(F.lit(1)).alias("requests"),
        _count(F.col("success")).alias("successful"),
        _count(~F.col("success")).alias("errors"),
        F.round(F.avg(good), 6).alias("mean_ms"),
        F.round(F.try_divide(F.count(F.lit(1)).cast("double"), span), 9).alias("throughput_rps"),
    ]


def run_summary(log: DataFrame) -> DataFrame:
    """For each replication factor and concurrency: counts, percentiles, requests per second of wall clock."""
    return _with_percentiles(log, ("rf", "concurrency"), _summary())


def mixed_workload_breakdown(log: DataFrame) -> DataFrame:
    """run_summary for each concurrency, over all operations (op null) and for each."""
    each = _with_percentiles(log, ("concurrency", "op"), _summary())
    return _with_percentiles(log, ("concurrency",), _summary()).withColumn("op", F.lit(None).cast("string")).unionByName(each)


def replication_overhead(log: DataFrame) -> DataFrame:
    """Factor 3 against 1 at the same concurrency, in per cent; null without the other side or on a base of 0."""
    runs = run_summary(log)
    cols = ["p50_ms", "p95_ms", "p99_ms", "throughput_rps"]
    base = runs.where("rf = 1").select("concurrency", *[F.col(c).alias(f"b_{c}") for c in cols])
    both = runs.where("rf in (1, 3)").join(base, "concurrency", "left")

    def over(c, sign):
        part = F.when(F.col(f"b_{c}") > 0, F.round(sign * (F.col(c) - F.col(f"b_{c}")) / F.col(f"b_{c}") * 100.0, 4))
        return F.when(F.col("rf") == 1, F.lit(0.0)).otherwise(part)

    return both.select("rf", "concurrency", "requests", "successful", "errors", *[over(c, 1.0).alias(f"{c[:3]}_overhead_percent") for c in cols[:3]], over("throughput_rps", -1.0).alias("throughput_impact_percent"))


def load_shed_report(log: DataFrame) -> DataFrame:
    """For each concurrency: accepted, shed (429), other errors, and latencies of accepted requests.

    p50 is the median; p95 and p99 are the sorted samples at floor(q * (n - 1)).
    """
    shed = _count(F.col("status_code") == 429)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("total_requests"),
        _count(F.col("success")).alias("accepted"),
        shed.alias("rejected_429"),
        _count(~F.col("success") & (F.col("status_code") != 429)).alias("other_errors"),
        F.round(shed / n * 100.0, 2).alias("rejected_percent"),
    ]
    picks = {"accepted_p50_ms": 0.5, "accepted_p95_ms": 0.95, "accepted_p99_ms": 0.99}
    return _with_percentiles(log, ("concurrency",), aggs, picks, floor=("accepted_p95_ms", "accepted_p99_ms"))


COUNTERS = ("searches", "search_errors", "search_incomplete", "writes", "write_errors")


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before of each counter of two one-row snapshots; 0 if either is null."""
    unpivot = lambda df, v: df.unpivot([], [F.col(c) for c in COUNTERS], "metric", v)
    both = unpivot(before, "b").join(unpivot(after, "a"), "metric")
    return both.select("metric", F.coalesce(F.col("a") - F.col("b"), F.lit(0)).alias("delta"))


def recovery_check(log: DataFrame, start: int, end: int) -> DataFrame:
    """Failed writes before, in and after an outage [start, end) of request ids, and whether the figures agree."""
    failed = (F.col("op") == "write") & ~F.col("success")
    at = F.col("request_id")
    out = log.agg(_count(failed & (at < start)).alias("baseline_failed"), _count(failed & (at >= start) & (at < end)).alias("outage_failed"), _count(failed & (at >= end)).alias("recovery_failed"), _count(failed).alias("final_failed"))
    return out.withColumn("recovered", F.col("recovery_failed") == 0).withColumn("consistent", F.col("final_failed") == F.col("baseline_failed") + F.col("outage_failed"))


def read_failovers(log: DataFrame, placement: DataFrame) -> DataFrame:
    """Reads of each shard that a replica other than the primary served. log: shard_id, node_id."""
    ranks = placement.select("shard_id", "node_id", "replica_rank")
    served = log.where("op = 'search'").join(ranks, ["shard_id", "node_id"])
    return served.groupBy("shard_id").agg(F.count(F.lit(1)).alias("reads"), _count(F.col("replica_rank") > 0).alias("failovers"))


def interval_samples(log: DataFrame, seconds: int = 10, last: int = 500, span: int = 4_000) -> DataFrame:
    """For each interval: requests, running totals, and p50 and p99 of the last samples so far.

    Intervals with requests only. Rows are numbered in order and dealt by spans of them;
    a span also gets the last - 1 rows before it, so that its windows need no other.
    """
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000 * seconds)).cast("long").alias("interval")
    marked = log.select(t, "ts", "request_id", "latency_ms", "success", "status_code")
    sums = marked.groupBy("interval").agg(F.count(F.lit(1)).alias("requests"), _count(F.col("success")).alias("a"), _count(F.col("status_code") == 429).alias("r"), _count(~F.col("success") & (F.col("status_code") != 429)).alias("e"))
    before = Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)  # a row for each interval
    starts = sums.select(F.col("interval").alias("i"), "requests", F.coalesce(F.sum("requests").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("interval").orderBy("ts", "request_id")
    placed = marked.withColumn("nth", F.row_number().over(inside)).join(starts, F.col("interval") == F.col("i"))
    place = F.col("start") + F.col("nth") - 1
    placed = placed.select("interval", place.alias("place"), F.when(F.col("success"), F.col("latency_ms")).alias("sample"), (F.col("nth") == F.col("requests")).alias("end"))
    own = F.floor(F.col("place") / span)
    spans = F.sequence(own, F.floor((F.col("place") + last - 1) / span))
    # a row brings a list of `last`, so spans are kept apart though they are short
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("*", own.alias("own"), F.explode(spans).alias("span")).repartition(tasks, "span")
    recent = F.collect_list("sample").over(Window.partitionBy("span").orderBy("place").rowsBetween(-(last - 1), 0))
    ends = dealt.withColumn("recent", recent).where("end and own = span")
    ends = ends.withColumn("recent", F.sort_array("recent"))
    n = F.size("recent")
    mid = lambda k: F.element_at("recent", k.cast("int"))
    p50 = F.when(n > 0, (mid(F.floor((n + 1) / 2)) + mid(F.floor((n + 2) / 2))) / 2).otherwise(0.0)
    p99 = F.when(n >= 10, mid(F.floor(F.lit(0.99).cast("double") * (n - 1)) + 1)).otherwise(p50)
    ends = ends.select("interval", F.round(p50, 6).alias("recent_p50_ms"), F.round(p99, 6).alias("recent_p99_ms"))
    running = Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)  # a row for each interval
    out = sums.join(ends, "interval")
    return out.select(
        "interval", "requests", *[F.sum(c).over(running).alias(f"cumulative_{n}") for c, n in (("a", "accepted"), ("r", "rejected"), ("e", "errors"))], "recent_p50_ms", "recent_p99_ms"
    )
