"""Streaming consumers of the mutation topic, with state by document or message.

The checkpoint of a query takes the place of committed offsets: a batch counts once its
state and output are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import audit as D
from ..operators import index as I
from ..operators import mutations as M

OUTCOMES = "document_id long, log_offset long, event_id long, event_type string, outcome string, content string"


def _blank(content: str | None) -> bool:
    return not (content or "").strip(" \t\n\r")


def step(state: str | None, event_type: str, content: str) -> tuple[str | None, str]:
    """(content after, outcome) of one event on a document's content, None if absent."""
    if event_type == "document_removed":
        return None, "Skipped" if state is None else "Applied"
    if event_type == "document_indexed":
        if state is not None:
            return state, "Skipped" if state == content else "Failed"
        return (None, "Failed") if _blank(content) else (content, "Applied")
    if state is None:
        return None, "Failed"
    if state == content:
        return state, "Skipped"
    return (state, "Failed") if _blank(content) else (content, "Applied")


class _Apply(StatefulProcessor):
    """Keeps the content of a document and applies its events in the order of the log.

    Offsets at or below the last one applied are deliveries made again and are left out.
    A call sorts one document's events of a batch; the source's limit of rows or files in
    a batch bounds them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "content string, log_offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("log_offset", kind="stable")
        content, last = self._state.get() if self._state.exists() else (None, -1)
        out = []
        for offset, event_id, kind, new in zip(events.log_offset, events.event_id, events.event_type, events.content, strict=True):
            if offset > last:
                content, outcome = step(content, kind, new)
                out.append((int(key[0]), int(offset), int(event_id), kind, outcome, content))
                last = int(offset)
        self._state.update((content, last))
        yield pd.DataFrame(out, columns=["document_id", "log_offset", "event_id", "event_type", "outcome", "content"])

    def close(self) -> None:
        pass


def index_mutations(source: DataFrame, own_node: int = 0, hosted=(0, 1)) -> DataFrame:
    """Outcomes of a stream of (topic, payload, offset), each with the document's content after it.

    A batch's rows of a document meet in one call. A failed event is an outcome, not a
    halt of the stream. The row of a document with the largest offset is its state.
    """
    events = M.candidates(source.withColumnRenamed("offset", "log_offset"), own_node, hosted)
    return events.groupBy("document_id").transformWithStateInPandas(_Apply(), OUTCOMES, "Append", "None")


def _runs(n: int, fan: int) -> list[tuple[int, int]]:
    """The runs (first batch, end) that hold n batches: the digits of n to the base fan, largest runs first."""
    size = 1
    while size * fan <= n:
        size *= fan
    out, first = [], 0
    while size:
        for _ in range((n - first) // size):
            out.append((first, first + size))
            first += size
        size //= fan
    return out


class KeptIndex:
    """Documents and postings of a stream, in runs of batches that are merged level by level.

    A batch is a run of its own; each fan runs of a size become one, so n batches are read
    from at most fan * (1 + log n) runs and a change is rewritten about log n times. Which
    runs count follows from n alone, and n is the newest name under path/head, written after
    the runs: what a crash leaves half done is not read, and is overwritten by the same batch
    delivered again. Runs stay for `keep` further batches, for readers that began before.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, keep: int = 8):
        if fan < 2 or keep < 1:
            raise ValueError("fan must be at least 2 and keep at least 1")
        self._spark, self._path, self._fan, self._keep = spark, path.rstrip("/"), fan, keep

    def _at(self, name: str):
        jvm = self._spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")
        return where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def batches(self) -> int:
        """How many batches are held."""
        return int((self._names("head") or ["0"])[-1])

    def _tables(self, runs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        names = [f"{first:012d}-{end:012d}" for first, end in runs]
        read = lambda kind, schema: self._spark.read.schema(schema).parquet(*[f"{self._path}/{kind}/{n}" for n in names])
        docs = read("documents", "document_id long, log_offset long, content string")
        return docs, read("postings", "term string, document_id long, tf long, log_offset long")

    def _newest(self, docs: DataFrame) -> DataFrame:
        return docs.groupBy("document_id").agg(F.max("log_offset").alias("log_offset"), F.max_by(F.struct("content"), "log_offset").alias("s")).select("document_id", "log_offset", "s.content")

    def _write(self, docs: DataFrame, postings, first: int, end: int) -> None:
        name = f"{first:012d}-{end:012d}"
        docs.write.mode("overwrite").parquet(f"{self._path}/documents/{name}")
        written = self._spark.read.schema(docs.schema).parquet(f"{self._path}/documents/{name}")
        postings(written).write.mode("overwrite").parquet(f"{self._path}/postings/{name}")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch of outcomes of index_mutations; batches come in order, the last one perhaps again."""
        n = batch_id + 1
        if n <= self.batches():
            return
        self._write(self._newest(batch), lambda docs: I.build_postings(docs.where("content is not null"), "log_offset"), batch_id, n)
        size = self._fan
        while n % size == 0:
            parts = [(first, first + size // self._fan) for first in range(n - size, n, size // self._fan)]
            docs, postings = self._tables(parts)
            docs = self._newest(docs)
            # nothing older is left that a removal could hide
            docs = docs.where("content is not null") if n == size else docs
            self._write(docs, lambda d, p=postings: p.join(d.select("document_id", "log_offset"), ["document_id", "log_offset"], "left_semi"), n - size, n)
            size *= self._fan
        fs, where = self._at(f"head/{n:012d}")
        fs.create(where, True).close()
        self._clear(n)

    def _clear(self, n: int) -> None:
        held = {f"{first:012d}-{end:012d}" for m in range(max(1, n - self._keep), n + 1) for first, end in _runs(m, self._fan)}
        for kind in ("documents", "postings"):
            for name in self._names(kind):
                if name not in held:
                    fs, where = self._at(f"{kind}/{name}")
                    fs.delete(where, True)
        for name in self._names("head")[:-1]:
            fs, where = self._at(f"head/{name}")
            fs.delete(where, True)

    def _live(self) -> tuple[DataFrame, DataFrame]:
        if n := self.batches():
            docs, postings = self._tables(_runs(n, self._fan))
            return self._newest(docs), postings
        empty = lambda schema: self._spark.createDataFrame([], schema)
        return empty("document_id long, log_offset long, content string"), empty("term string, document_id long, tf long, log_offset long")

    def documents(self) -> DataFrame:
        """(document_id, content)"""
        return self._live()[0].where("content is not null").select("document_id", "content")

    def postings(self) -> DataFrame:
        """(term, document_id, tf): postings of each document's last change."""
        docs, postings = self._live()
        return postings.join(docs.select("document_id", "log_offset"), ["document_id", "log_offset"], "left_semi").select("term", "document_id", "tf")


def keep_index(outcomes: DataFrame, path: str, checkpoint: str, fan: int = 8):
    """Start a query that keeps documents and postings under path from index_mutations."""
    return subscribe(outcomes, KeptIndex(outcomes.sparkSession, path, fan).add, checkpoint)


def kept_documents(spark: SparkSession, path: str, fan: int = 8) -> DataFrame:
    """(document_id, content) as keep_index left them."""
    return KeptIndex(spark, path, fan).documents()


def kept_postings(spark: SparkSession, path: str, fan: int = 8) -> DataFrame:
    """(term, document_id, tf) as keep_index left them."""
    return KeptIndex(spark, path, fan).postings()


def dedup_messages(source: DataFrame, id_column: str = "event_id", time_column: str = "ts", horizon: str = "10 minutes") -> DataFrame:
    """Rows whose id was not seen within the horizon; state older than that is dropped."""
    timed = source.withColumn(time_column, F.col(time_column).cast("timestamp"))
    return timed.withWatermark(time_column, horizon).dropDuplicatesWithinWatermark([id_column])


class _Deliver(StatefulProcessor):
    """Counts failed deliveries of a message until it is acknowledged or dead.

    A count is dropped once the watermark is a horizon past the message's last attempt.
    With every, each attempt that counts is a row, with its topic and whatever its state.
    """

    def __init__(self, most: int, keep_ms: int, every: bool = False):
        self._most, self._keep_ms, self._every = most, keep_ms, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._tries = handle.getValueState("tries", "n long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tries, until = self._tries.get() if self._tries.exists() else (0, 0)
        before, out = until, []
        for seq, ok, at, topic in sorted((r for f in rows for r in zip(f.seq, f.ok, f.ms, f.topic, strict=True)), key=lambda r: r[0]):
            until = max(until, int(at) + self._keep_ms)
            if tries < 0 or tries >= self._most:
                continue
            tries += 1
            if ok:
                out.append((topic, int(key[0]), int(seq), tries, "Acknowledged"))
                tries = -1
            elif tries >= self._most:
                out.append((topic, int(key[0]), int(seq), tries, "DeadLetter"))
            elif self._every:
                out.append((topic, int(key[0]), int(seq), tries, "Retry"))
        self._tries.update((tries, until))
        if until > before:
            self._handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["topic", "message_id", "seq", "attempt", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a message that was tried again has a later timer too
        if self._tries.exists() and self._tries.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self._tries.clear()
        return iter(())

    def close(self) -> None:
        pass


def _delivered(attempts: DataFrame, most: int, horizon: str, keep_hours: float, every: bool) -> DataFrame:
    schema = "topic string, message_id long, seq long, attempt long, state string"
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", horizon)
    timed = timed.select("message_id", "seq", "ok", "ts", F.unix_millis("ts").alias("ms"), F.col("topic") if every else F.lit(None).cast("string").alias("topic"))
    return timed.groupBy("message_id").transformWithStateInPandas(_Deliver(most, int(keep_hours * 3_600_000), every), schema, "Append", "EventTime")


def deliver(attempts: DataFrame, max_attempts: int = 3, horizon: str = "7 days", keep_hours: float = 168.0) -> DataFrame:
    """Final states of messages from a stream of attempts (message_id, seq, ok, ts).

    Attempts later than the horizon are dropped. A message is forgotten keep_hours after
    its last attempt, in the time of the stream; an attempt after that counts as a new one.
    """
    out = _delivered(attempts, max_attempts, horizon, keep_hours, False)
    return out.select("message_id", "seq", F.col("attempt").alias("attempts"), "state")


def delivery_attempts(attempts: DataFrame, max_attempts: int = 3, horizon: str = "7 days", keep_hours: float = 168.0) -> DataFrame:
    """Each attempt of a stream (topic, message_id, seq, ok, ts) that counts: its number, and Acknowledged, DeadLetter or Retry.

    Attempts after a message's end don't count; horizon and keep_hours are as in deliver.
    """
    return _delivered(attempts, max_attempts, horizon, keep_hours, True)


def split_dead_letters(delivered: DataFrame, good_path: str, dead_path: str, checkpoint: str):
    """Start a query that writes acknowledged and dead messages to two tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is written again overwrites its own folder
        for state, path in (("Acknowledged", good_path), ("DeadLetter", dead_path)):
            batch.where(F.col("state") == state).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return delivered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def subscribe(source: DataFrame, handler, checkpoint: str):
    """Start a query that calls handler(batch, batch_id) for each batch of a stream."""
    return source.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_metrics(log: DataFrame, seconds: int = 10, lateness: str = "1 minute") -> DataFrame:
    """Counts of requests by node in tumbling windows; rows later than the lateness are dropped."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", f"{seconds} seconds"), "node_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("success"), 1)).alias("accepted"), F.count(F.when(F.col("status_code") == 429, 1)).alias("rejected"), F.avg("latency_ms").alias("mean_ms")
    )


class _Totals(StatefulProcessor):
    """Running counts of a node and its last samples."""

    def __init__(self, last: int):
        self._last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "counts array<long>, recent array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, recent = self._state.get() if self._state.exists() else ([0, 0, 0, 0], [])
        log = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        good, shed = log.success.astype(bool), log.status_code == 429
        more = (len(log), good.sum(), shed.sum(), (~good & ~shed).sum())
        counts = [int(c + m) for c, m in zip(counts, more, strict=True)]
        recent = [float(x) for x in ([*recent, *log.latency_ms[good]])[-self._last :]]
        self._state.update((counts, recent))
        s = sorted(recent)
        p50 = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else 0.0
        p99 = s[int(0.99 * (len(s) - 1))] if len(s) >= 10 else p50
        yield pd.DataFrame([(key[0], *counts, p50, p99)], columns=["node_id", "requests", "accepted", "rejected", "errors", "recent_p50_ms", "recent_p99_ms"])

    def close(self) -> None:
        pass


def running_metrics(log: DataFrame, last: int = 500) -> DataFrame:
    """After each batch, totals so far of each node with new requests, and p50 and p99 of its last good samples.

    A node's state is four counts and at most last samples.
    """
    schema = "node_id long, requests long, accepted long, rejected long, errors long, recent_p50_ms double, recent_p99_ms double"
    needed = log.select("node_id", "ts", "request_id", "success", "status_code", "latency_ms")
    return needed.groupBy("node_id").transformWithStateInPandas(_Totals(last), schema, "Update", "None")


def write_visibility(writes: DataFrame, observations: DataFrame, timeout_s: int = 10, nodes: tuple[int, ...] = (1, 2), lateness: str = "10 seconds") -> DataFrame:
    """audit.write_visibility over two streams; a write's row comes once the watermark is past its last moment.

    Rows later than the lateness are dropped. State holds a write, or an observation, as a
    digest of its content for about twice the timeout; a node that never showed the
    write is in the outer row of the join.
    """
    moment = lambda c: F.col(c).cast("timestamp").alias(c)
    w = writes.select("write_id", F.col("document_id").cast("long").alias("document_id"), D.content_key().alias("_key"), moment("t_write")).where("t_write is not null")
    o = observations.select(F.col("document_id").cast("long").alias("_document"), D.content_key().alias("_seen_key"), "node_id", moment("t_seen")).where("t_seen is not null and _document is not null")
    in_time = F.col("t_seen").between(F.col("t_write"), F.col("t_write") + F.expr(f"interval {2 * timeout_s} seconds"))
    same = (F.col("document_id") == F.col("_document")) & (F.col("_key") == F.col("_seen_key"))
    both = w.withWatermark("t_write", lateness).join(o.withWatermark("t_seen", lateness), same & in_time, "leftOuter")
    first = [F.min(F.when(F.col("node_id") == n, F.unix_micros("t_seen"))).alias(f"_seen{n}") for n in (0, *nodes)]
    found = both.groupBy("write_id", "document_id", "t_write").agg(*first)
    return D.visibility_columns(found.withColumn("_t", F.unix_micros("t_write")), timeout_s, nodes)
