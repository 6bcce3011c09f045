"""The outbox table of events to deliver, and delivery over an attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("PENDING", "DISPATCHING", "PUBLISHED", "FAILED")


#: Rows of one event's log that are folded in a row of their own.
FOLD_RANGE = 1_000


def _moved(status: Column, action: Column) -> Column:
    """The status after an action."""
    return (
        F.when((action == "mark_dispatching") & (status == "PENDING"), "DISPATCHING")
        .when((action == "mark_published") & (status == "DISPATCHING"), "PUBLISHED")
        .when((action == "mark_failed") & (status == "DISPATCHING"), "FAILED")
        .when((action == "requeue") & (status == "FAILED"), "PENDING")
        .otherwise(status)
    )


def replay_transitions(log: DataFrame, fold_range: int = FOLD_RANGE) -> DataFrame:
    """Final state of each event from log (outbox_id, seq, action): status, attempt_count, retried.

    All start PENDING. PENDING goes to DISPATCHING, that to PUBLISHED or FAILED, FAILED
    back to PENDING by requeue, which counts as retried; an attempt counts in any state;
    anything else changes nothing. seq is an integer without ties in an event's log.

    A log is folded by ranges of seq. Of each range it is kept where every status leads
    and how many requeues that takes; such maps are joined range by range, and again by
    ranges of ranges, so no row holds more than fold_range entries below the last level.
    """
    k = "_range"

    def fold(x, a):
        now = _moved(x["status"], a["action"])
        again = (a["action"] == "requeue") & (x["status"] == "FAILED")
        return F.struct(now.alias("status"), (x["retried"] + again.cast("long")).alias("retried"))

    def start(status):
        return F.struct(F.lit(status).alias("status"), F.lit(0).cast("long").alias("retried"))

    ranged = log.select("outbox_id", "seq", "action", F.floor(F.col("seq") / F.lit(fold_range)).alias(k))
    steps = F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("steps")
    maps = ranged.groupBy("outbox_id", k).agg(steps, F.count(F.when(F.col("action") == "record_attempt", 1)).alias("attempt_count"))
    maps = maps.select("outbox_id", k, "attempt_count", *[F.aggregate("steps", start(s), fold).alias(s) for s in STATUSES])

    def joined(x, m):
        to = F.coalesce(*[F.when(x["status"] == s, m[s]) for s in STATUSES])
        return F.struct(to["status"].alias("status"), (x["retried"] + to["retried"]).alias("retried"))

    for level in (F.floor(F.col(k) / F.lit(fold_range)), F.floor(F.col(k) / F.lit(fold_range)), F.lit(0)):
        inner = F.sort_array(F.collect_list(F.struct(k, *STATUSES))).alias("maps")
        maps = maps.groupBy("outbox_id", level.alias("_up")).agg(inner, F.sum("attempt_count").alias("attempt_count"))
        maps = maps.select("outbox_id", F.col("_up").alias(k), "attempt_count", *[F.aggregate("maps", start(s), joined).alias(s) for s in STATUSES])
    return maps.select("outbox_id", "PENDING.status", "attempt_count", "PENDING.retried")


def by_status(outbox: DataFrame, status: str) -> DataFrame:
    return outbox.where(F.col("status") == status)


def by_topic(outbox: DataFrame, topic: str, status: str) -> DataFrame:
    return outbox.where((F.col("topic") == topic) & (F.col("status") == status))


def stats(outbox: DataFrame) -> DataFrame:
    """Total and count of each status, and the attempts beyond the first."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in STATUSES]
    return outbox.agg(F.count(F.lit(1)).alias("total"), *counts, F.coalesce(F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retried"))


def recover(outbox: DataFrame) -> DataFrame:
    """After a restart, events in flight are pending again."""
    return outbox.withColumn("status", F.when(F.col("status") == "DISPATCHING", "PENDING").otherwise(F.col("status")))


def next_id(outbox: DataFrame, meta: int = 0) -> DataFrame:
    return outbox.agg(F.greatest(F.lit(meta), F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def replay_failed(outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with FAILED events pending again, the events to send)."""
    failed = F.col("status") == "FAILED"
    table = outbox.withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))
    return table, outbox.where(failed).withColumn("status", F.lit("PENDING"))


def _attempts(log: DataFrame) -> DataFrame:
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy("message_id").orderBy("seq")))


def dispatch_outcome(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per message: PUBLISHED at its first success within max_retries + 1 attempts, else FAILED if all are used, else PENDING."""
    most = max_retries + 1
    used = _attempts(log).where(F.col("attempt") <= most)
    out = used.groupBy("message_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("hit"), F.count(F.lit(1)).alias("n"))
    last = F.coalesce("hit", "n")
    status = F.when(F.col("hit").isNotNull(), "PUBLISHED").when(F.col("n") >= most, "FAILED").otherwise("PENDING")
    return out.select(
        "message_id",
        status.alias("status"),
        last.cast("long").alias("attempts"),
        (last - 1).cast("long").alias("retried"),
        (last - F.when(F.col("hit").isNotNull(), 1).otherwise(0)).cast("long").alias("broker_errors"),
        F.when(status == "FAILED", "broker rejected").otherwise("").alias("error_message"),
    )


def dedup_messages(log: DataFrame, key: str = "message_id", order: str = "seq") -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("_n", first).where("_n = 1").drop("_n")


def dead_letters(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Messages whose first max_attempts deliveries all failed."""
    used = _attempts(log).where(F.col("attempt") <= max_attempts)
    out = used.groupBy("message_id", "topic").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("ok").alias("ok"))
    return out.where((F.col("attempts") >= max_attempts) & ~F.col("ok")).select("message_id", "topic", "attempts")


def assign_offsets(log: DataFrame, topic: str = "topic", order: str = "seq") -> DataFrame:
    """Offsets from 0 in arrival order, for each topic.

    Arrival numbers are cut into ranges, counted, and numbered inside their range, so a
    busy topic is not sorted by one task.
    """
    ranged = log.withColumn("_range", F.floor(F.col(order) / F.lit(100_000)))
    by_topic_ = Window.partitionBy(topic).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(topic, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(by_topic_), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(topic, "_range").orderBy(order))
    out = ranged.withColumn("_nth", nth).join(starts, [topic, "_range"])
    return out.withColumn("log_offset", (F.col("_start") + F.col("_nth") - 1).cast("long")).drop("_range", "_nth", "_start")


def broker_stats(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Per topic: published, delivered, acknowledged, retried, dead_lettered and depth (still waiting)."""
    used = _attempts(log).where(F.col("attempt") <= max_attempts)
    per = used.groupBy("topic", "message_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("hit"), F.count(F.lit(1)).alias("n"))
    tries = F.coalesce("hit", "n")
    dead = F.col("hit").isNull() & (F.col("n") >= max_attempts)
    return per.groupBy("topic").agg(
        F.count(F.lit(1)).alias("published"),
        F.sum(tries).cast("long").alias("delivered"),
        F.count("hit").alias("acknowledged"),
        F.sum(tries - 1).cast("long").alias("retried"),
        F.count(F.when(dead, 1)).alias("dead_lettered"),
        F.count(F.when(F.col("hit").isNull() & ~dead, 1)).alias("depth"),
    )


def in_order_check(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before, by key and arrival order."""
    w = Window.partitionBy(key).orderBy(order, value)
    return log.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous")).select(key, order, value, "previous")
