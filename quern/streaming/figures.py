"""Live figures of running streams: observed counts and offsets of each batch, kept as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import audit as D

FIGURES = "query_id string, run_id string, query string, batch long, observation string, figure string, value long"
OFFSETS = "query_id string, run_id string, query string, batch long, source int, part int, log_start_offset long, current_offset long, log_end_offset long"

DELIVERY = "delivery"
COUNTS = ("published", "delivered", "acknowledged", "retried", "dead_lettered")


def observe_delivery(made: DataFrame, topics: Sequence[str]) -> DataFrame:
    """streaming.mutations.delivery_attempts with counts of each batch observed, for each of topics and for all others together.

    Counts of batches add up to those of the whole: a first attempt publishes a message,
    every attempt delivers, every later one is a retry.
    """
    state = F.col("state")
    hits = {"published": F.col("attempt") == 1, "delivered": F.lit(True), "acknowledged": state == "Acknowledged", "retried": F.col("attempt") > 1, "dead_lettered": state == "DeadLetter"}

    def counts(of: Column, ending: str) -> list[Column]:
        return [F.count(F.when(of & hits[c], 1)).alias(c + ending) for c in COUNTS]

    named = F.coalesce(F.col("topic").isin(*topics), F.lit(False))
    return made.observe(DELIVERY, *[c for t in topics for c in counts(F.col("topic") == t, f"/{t}")], *counts(~named, ""))


def _ends(offset: object) -> dict[int, int]:
    """Offsets by partition of what a source reports: {"ends": {part: offset}}, or {topic: {part: offset}}; none of other forms."""
    found = offset if isinstance(offset, dict) else {}
    maps = [found["ends"]] if "ends" in found else [m for m in found.values() if isinstance(m, dict)]
    return {int(p): int(n) for m in maps for p, n in m.items()}


class FigureTables(StreamingQueryListener):
    """Keeps the figures of named queries under path, figures/ and offsets/, a row for each figure or partition of a batch.

    Rows come from the driver after each batch, as many as figures and partitions. A batch
    that ran again after a restart has rows of both runs and is counted once. Add it by
    spark.streams.addListener before queries start; figures of a batch are lost if the
    driver dies between the batch and the report of it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.name:
            return
        batch = (str(p.id), str(p.runId), p.name, p.batchId)
        figures = [(*batch, name, k, v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()]
        offsets = []
        for i, s in enumerate(json.loads(p.json)["sources"]):
            low, at, high = (_ends(s.get(k)) for k in ("startOffset", "endOffset", "latestOffset"))
            offsets += [(*batch, i, part, low.get(part, 0), at.get(part), max(at.get(part, 0), high.get(part, 0))) for part in sorted(at.keys() | high.keys())]
        for name, rows, schema in (("figures", figures, FIGURES), ("offsets", offsets, OFFSETS)):
            if rows:
                self._spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self._path}/{name}")


def _last_run(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of each key, that with the greatest value, as a batch counts the same or more when it is run again."""
    w = Window.partitionBy("query_id", "batch", *keys).orderBy(F.desc_nulls_last("value"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live_broker_stats(figures: DataFrame, query: str) -> DataFrame:
    """outbox.broker_stats from observed figures of a query: counts so far by topic, those of unnamed topics under null."""
    mine = figures.where((F.col("query") == query) & (F.col("observation") == DELIVERY))
    parts = _last_run(mine, "figure").select(F.split("figure", "/", 2).alias("f"), "value")
    topic, kind = F.get("f", F.lit(1)), F.get("f", F.lit(0))
    sums = parts.groupBy(topic.alias("topic")).agg(*[F.coalesce(F.sum(F.when(kind == c, F.col("value"))), F.lit(0)).alias(c) for c in COUNTS])
    return sums.where("published > 0").withColumn("depth", F.col("published") - F.col("acknowledged") - F.col("dead_lettered"))


def live_samples(offsets: DataFrame) -> DataFrame:
    """Samples as audit.consumer_lag takes them: a batch is a sample, a query is a consumer group."""
    one = _last_run(offsets.withColumn("value", F.col("current_offset")), "source", "part")
    return one.select(F.col("batch").alias("sample_index"), F.col("query").alias("consumer_group"), "part", "log_start_offset", "current_offset", "log_end_offset")


def live_lag(offsets: DataFrame) -> DataFrame:
    """The lag of each query after each batch: what stood in its topics and was not read."""
    return D.consumer_lag(live_samples(offsets))


def lag_now(offsets: DataFrame, ends: dict[str, int]) -> DataFrame:
    """The lag of each query behind the ends of its topic (TopicLog.ends), from the last batch it reported."""
    last = Window.partitionBy("consumer_group").orderBy(F.desc("sample_index"))
    newest = live_samples(offsets).withColumn("_r", F.rank().over(last)).where("_r = 1").select("sample_index", "consumer_group", "part", "current_offset")
    # a partition that is new since the last batch has no position
    parts = [F.struct(F.lit(int(p)).alias("part"), F.lit(0).cast("long").alias("log_start_offset"), F.lit(n).cast("long").alias("log_end_offset")) for p, n in ends.items()]
    groups = newest.select("sample_index", "consumer_group").distinct().select("*", F.inline(F.array(*parts)))
    return D.consumer_lag(groups.join(newest, ["sample_index", "consumer_group", "part"], "left"))
