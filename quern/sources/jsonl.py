"""JSON-lines sources and sinks, report files, and the message-log connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import topic

MUTATIONS = "documents.mutations"
OUTBOX_STATUSES = ("PENDING", "DISPATCHING", "PUBLISHED", "FAILED")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, with keys that restore their order over files and splits."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return raw.withColumn("_line", F.monotonically_increasing_id()).where(F.col("value").rlike(r"\S"))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json("value"), f"$.{name}", kind)


def _first_of_each(good: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("_file", "_block", "_line")
    return good.withColumn("_n", F.row_number().over(order)).where("_n = 1")


def load_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of {"id", "content"} lines.

    Rejected are bad JSON, an id that is missing or no unsigned integer, content that is
    missing or no string, and repeated ids: the first line wins.
    """
    lines = _lines(spark, path)
    checked = lines.withColumn("reason", X.ingest_error(F.col("value")))
    good = checked.where("reason is null").withColumns({"document_id": _field("id", "bigint"), "content": _field("content", "string")})
    order = Window.partitionBy("document_id").orderBy("_file", "_block", "_line")
    good = good.withColumn("_n", F.row_number().over(order))
    bad = checked.where("reason is not null").select("value", "reason")
    again = good.where("_n > 1").select("value", F.lit("duplicate id").alias("reason"))
    return good.where("_n = 1").select("document_id", "content"), bad.unionByName(again)


def save_documents(documents: DataFrame, path: str) -> None:
    """Lines {"id", "content"} in the order of ids, over the names of the part files."""
    documents.select(F.col("document_id").alias("id"), "content").orderBy("id").write.mode("overwrite").json(path)


def load_outbox(spark: SparkSession, path: str) -> DataFrame:
    """Outbox rows; id, topic and status are required, the rest have defaults, the first id wins.

    An unknown status counts as PENDING.
    """
    body = F.col("value")
    text = lambda n: F.coalesce(F.when(X.json_kind(body, n) == "STRING", _field(n, "string")), F.lit(""))
    number = lambda n: F.coalesce(F.when(X.json_kind(body, n) == "BIGINT", _field(n, "bigint")), F.lit(0))
    is_text = lambda n: F.coalesce(X.json_kind(body, n) == "STRING", F.lit(False))
    lines = _lines(spark, path).where(X.is_unsigned(body, "id") & is_text("topic") & is_text("status"))
    status = _field("status", "string")
    rows = lines.withColumns(
        {
            "id": _field("id", "bigint"),
            "topic": _field("topic", "string"),
            "key": text("key"),
            "payload": text("payload"),
            "status": F.when(status.isin(*OUTBOX_STATUSES), status).otherwise("PENDING"),
            "attempt_count": number("attempt_count"),
            "created_at_ns": number("created_at_ns"),
            "updated_at_ns": number("updated_at_ns"),
            "error_message": text("error_message"),
        }
    )
    return _first_of_each(rows, "id").select("id", "topic", "key", "payload", "status", "attempt_count", "created_at_ns", "updated_at_ns", "error_message")


def save_outbox(outbox: DataFrame, path: str) -> None:
    """The rows in the order of ids under path/events, and one row of counters under path/meta."""
    outbox.orderBy("id").write.mode("overwrite").json(f"{path}/events")
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in OUTBOX_STATUSES]
    outbox.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"), F.count(F.lit(1)).alias("total"), *counts).write.mode("overwrite").json(f"{path}/meta")


def write_report_csv(report: DataFrame, path: str) -> None:
    """CSV with a header; columns stand in the order of the report."""
    report.write.mode("overwrite").option("header", True).csv(path)


def mutation_source(spark: SparkSession, options: dict[str, str] | None = None, format: str = "kafka", path: str | None = None) -> DataFrame:
    """A stream of (topic, payload, offset) of the mutation topic, from its beginning.

    Each node reads the whole topic under its own checkpoint. format "kafka" needs the
    connector's jar; "topic_log" reads a topic of sources.topic; "json" reads files of
    {"topic", "value", "offset"} lines.
    """
    options = options or {}
    if format == topic.FORMAT:
        spark.dataSource.register(topic.TopicSource)
        raw = spark.readStream.format(format).options(**options).load(path)
        return raw.select(F.lit(MUTATIONS).alias("topic"), F.col("value").alias("payload"), "offset", "partition")
    if format == "kafka":
        raw = spark.readStream.format("kafka").options(**{"subscribe": MUTATIONS, "startingOffsets": "earliest"} | options).load()
        return raw.select("topic", F.col("value").cast("string").alias("payload"), "offset", "partition")
    raw = spark.readStream.schema("topic string, value string, offset long, partition int").options(**options).format(format).load(path)
    return raw.select("topic", F.col("value").alias("payload"), "offset", "partition")


def mutation_sink(events: DataFrame, checkpoint: str, options: dict[str, str] | None = None, format: str = "kafka", path: str | None = None):
    """A started stream writer of (document_id, payload), keyed by document.

    A topic_log is dealt into the option partitions, 3 if not given; the stream is known to it by its checkpoint.
    """
    options = dict(options or {})
    out = events.select(F.col("document_id").cast("string").alias("key"), F.col("payload").alias("value"), F.lit(MUTATIONS).alias("topic"))
    if format == topic.FORMAT:
        events.sparkSession.dataSource.register(topic.TopicSource)
        out = topic.records(events, "document_id", "payload", int(options.pop("partitions", 3)))
        options.setdefault("writer", checkpoint)
    writer = out.writeStream.format(format).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True)
    return writer.start(path) if path else writer.start()
