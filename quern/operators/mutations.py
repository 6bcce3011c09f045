"""Document mutations in batches, and the change log applied in order for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

TOPIC = "documents.mutations"
TYPES = ("document_indexed", "document_updated", "document_removed")
#: Operations numbered by one task when event ids are given.
NUMBER_RANGE = 100_000


def _exists(operations: DataFrame, corpus: DataFrame) -> DataFrame:
    held = corpus.select("document_id", F.lit(True).alias("held"))
    return operations.join(held, "document_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def _message(what: str) -> Column:
    return F.concat(F.lit("Document with id "), F.col("document_id").cast("string"), F.lit(f" {what}"))


def ingest_documents(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Outcomes of inserts (seq, document_id, content): created, conflict or invalid.

    Blank content is rejected first; of several inserts of an id the first by seq wins.
    """
    nth = Window.partitionBy("document_id", "is_blank").orderBy("seq")
    ops = _exists(batch.withColumn("is_blank", X.blank(F.col("content"))), corpus).withColumn("nth", F.row_number().over(nth))
    status = F.when(F.col("is_blank"), "invalid").when(F.col("held") | (F.col("nth") > 1), "conflict").otherwise("created")
    ops = ops.withColumn("status", status)
    message = F.when(status == "invalid", X.MSG_BLANK).when(status == "conflict", _message("already exists")).otherwise("")
    done = F.when(status == "created", X.terms_indexed(F.col("content"))).otherwise(F.lit(0))
    return ops.select("seq", "document_id", "status", message.alias("message"), done.cast("long").alias("terms_indexed"), "content")


def ingested_table(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """The documents after ingest_documents."""
    new = ingest_documents(batch, corpus).where("status = 'created'").select("document_id", "content")
    return corpus.select("document_id", "content").unionByName(new)


def update_documents(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Outcomes of replacements: updated, not_found or invalid. Never creates; equal content succeeds."""
    ops = _exists(batch.withColumn("is_blank", X.blank(F.col("content"))), corpus)
    status = F.when(F.col("is_blank"), "invalid").when(~F.col("held"), "not_found").otherwise("updated")
    message = F.when(status == "invalid", X.MSG_BLANK).when(status == "not_found", _message("not found")).otherwise("")
    done = F.when(status == "updated", X.terms_indexed(F.col("content"))).otherwise(F.lit(0))
    return ops.select("seq", "document_id", status.alias("status"), message.alias("message"), done.cast("long").alias("terms_indexed"), "content")


def updated_table(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """The documents after update_documents: the last update of each id by seq."""
    last = update_documents(batch, corpus).where("status = 'updated'").groupBy("document_id").agg(F.max_by("content", "seq").alias("new"))
    return corpus.join(last, "document_id", "left").select("document_id", F.coalesce("new", "content").alias("content"))


def delete_documents(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Outcomes of removals (seq, document_id): deleted or not_found; the second removal of an id finds none."""
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))
    ops = _exists(batch.withColumn("nth", nth), corpus)
    status = F.when(F.col("held") & (F.col("nth") == 1), "deleted").otherwise("not_found")
    message = F.when(status == "not_found", _message("not found")).otherwise("")
    return ops.select("seq", "document_id", status.alias("status"), message.alias("message"))


def deleted_table(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    return corpus.select("document_id", "content").join(batch.select("document_id"), "document_id", "left_anti")


def number_rows(df: DataFrame, order: str, base: int = 1) -> DataFrame:
    """df with event_id, ascending by a non-negative order column without ties.

    Rows are counted by ranges of the order column; a range's number is the sum of those
    before, so no task sees more than NUMBER_RANGE rows.
    """
    part = F.floor(F.col(order) / F.lit(NUMBER_RANGE)).alias("_range")
    ranged = df.withColumn("_range", part)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    out = ranged.withColumn("_nth", nth).join(starts, "_range")
    return out.withColumn("event_id", (F.col("_start") + F.col("_nth") - 1 + base).cast("long")).drop("_range", "_nth", "_start")


def emit_mutation_events(outcomes: DataFrame, event_type: str = "document_indexed", node_id: int = 0, shards: int = 3, base: int = 1) -> DataFrame:
    """One event for each successful operation, ids ascending by seq: event_id, document_id, payload."""
    done = outcomes.where(F.col("status").isin("created", "updated", "deleted"))
    content = F.lit(None).cast("string") if event_type == "document_removed" else F.col("content")
    numbered = number_rows(done, "seq", base)
    payload = X.encode_event(F.col("event_id"), F.lit(event_type), F.col("document_id"), F.pmod("document_id", F.lit(shards)), F.lit(node_id), content)
    return numbered.select("event_id", "document_id", payload.alias("payload"))


def replicated_write_outcome(results: DataFrame) -> DataFrame:
    """results (op_id, replica_rank, ok, message, terms_indexed): success only if all replicas succeed."""
    first = F.min(F.when(~F.col("ok"), F.col("replica_rank"))).over(Window.partitionBy("op_id"))
    ranked = results.withColumn("_first", first)
    good = F.when(F.col("ok") & (F.col("_first").isNull() | (F.col("replica_rank") < F.col("_first"))), F.col("replica_rank"))
    return ranked.groupBy("op_id").agg(
        F.bool_and("ok").alias("success"),
        F.coalesce(F.min_by("message", F.when(~F.col("ok"), F.col("replica_rank"))), F.lit("")).alias("error_message"),
        F.coalesce(F.max_by("terms_indexed", good), F.lit(0)).cast("long").alias("terms_indexed"),
    )


def classify_mutation_events(log: DataFrame, own_node: int = 0, hosted=(0, 1)) -> DataFrame:
    """log (topic, payload and more) with the event's fields as e and its class.

    skipped, malformed, self_skipped or candidate, by the first rule that holds.
    """
    e = X.decode_event(F.col("payload"))
    out = log.withColumn("e", e)
    kind = (
        F.when(F.col("topic") != TOPIC, "skipped")
        .when(F.col("e.event_type").isNull(), "malformed")
        .when(~F.col("e.event_type").isin(*TYPES), "skipped")
        .when(F.col("e.event_id").isNull() | F.col("e.document_id").isNull() | F.col("e.shard_id").isNull(), "malformed")
        .when(F.coalesce("e.source_node_id", F.lit(0)) == own_node, "self_skipped")
        .when(~F.col("e.shard_id").isin(*hosted), "skipped")
        .otherwise("candidate")
    )
    return out.withColumn("class", kind)


def candidates(log: DataFrame, own_node: int = 0, hosted=(0, 1)) -> DataFrame:
    """The events to apply: log_offset, event_id, document_id, event_type, content.

    log_offset is the place in the log. All events of a document stand in one partition
    of the topic, so offsets put them in order; event ids come from many writers and don't.
    """
    found = classify_mutation_events(log, own_node, hosted).where("class = 'candidate'")
    return found.select("log_offset", F.col("e.event_id").alias("event_id"), F.col("e.document_id").alias("document_id"), F.col("e.event_type").alias("event_type"), F.coalesce("e.document_content", F.lit("")).alias("content"))


def apply_mutations(events: DataFrame) -> DataFrame:
    """Outcome of each event in the order of log_offset, from an empty table.

    Removals cut a document's log into stretches that begin without it. In a stretch the
    first non-blank index event brings it in, and its content is that or the last
    non-blank update since. So each event's state is a window over rows before it, and a
    long history of one document is sorted and spilled like any window, never held.
    Columns added: outcome (Applied, Skipped, Failed) and content_after (null: absent).
    """
    by_doc = Window.partitionBy("document_id").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, -1)
    removal = F.col("event_type") == "document_removed"
    ev = events.withColumn("_stretch", F.coalesce(F.sum(F.when(removal, 1).otherwise(0)).over(by_doc), F.lit(0)))
    before = Window.partitionBy("document_id", "_stretch").orderBy("log_offset").rowsBetween(Window.unboundedPreceding, -1)
    solid = ~X.blank(F.col("content"))
    index, update = (F.col("event_type") == "document_indexed") & solid, (F.col("event_type") == "document_updated") & solid
    ev = ev.withColumn("_present", F.coalesce(F.max(F.when(index, True)).over(before), F.lit(False)))
    sets = (index & ~F.col("_present")) | (update & F.col("_present"))
    ev = ev.withColumn("_sets", sets).withColumn("_before", F.last(F.when(F.col("_sets"), F.col("content")), ignorenulls=True).over(before))
    same = F.col("content") == F.col("_before")
    outcome = (
        F.when(removal, F.when(F.col("_present"), "Applied").otherwise("Skipped"))
        .when(F.col("event_type") == "document_indexed", F.when(F.col("_present"), F.when(same, "Skipped").otherwise("Failed")).when(solid, "Applied").otherwise("Failed"))
        .otherwise(F.when(~F.col("_present"), "Failed").when(same, "Skipped").when(solid, "Applied").otherwise("Failed"))
    )
    after = F.when(removal, F.lit(None).cast("string")).when(F.col("_sets"), F.col("content")).otherwise(F.col("_before"))
    return ev.select("log_offset", "event_id", "document_id", "event_type", outcome.alias("outcome"), after.alias("content_after"))


def materialize_documents(events: DataFrame) -> DataFrame:
    """Documents after the log."""
    last = apply_mutations(events).groupBy("document_id").agg(F.max_by(F.struct("content_after"), "log_offset").alias("s"))
    return last.where("s.content_after is not null").select("document_id", F.col("s.content_after").alias("content"))


def apply_stats(log: DataFrame, own_node: int = 0, hosted=(0, 1)) -> DataFrame:
    """One row of counters. Self-skips also count as skipped; other topics count nowhere."""
    on_topic = classify_mutation_events(log.where(F.col("topic") == TOPIC), own_node, hosted)
    count = lambda c: F.count(F.when(c, 1))
    kinds = on_topic.agg(
        F.count(F.lit(1)).alias("received"),
        count(F.col("class").isin("skipped", "self_skipped")).alias("_skipped"),
        count(F.col("class") == "self_skipped").alias("self_skipped"),
        count(F.col("class") == "malformed").alias("malformed"),
    )
    applied = F.col("outcome") == "Applied"
    done = apply_mutations(candidates(log, own_node, hosted)).agg(
        count(applied).alias("processed"),
        count(F.col("outcome") == "Failed").alias("failed"),
        count(F.col("outcome") == "Skipped").alias("_noop"),
        *[count(applied & (F.col("event_type") == t)).alias(n) for t, n in zip(TYPES, ("index_operations", "update_operations", "remove_operations"), strict=True)],
    )
    both = kinds.crossJoin(F.broadcast(done))  # a row each
    return both.select("received", "processed", "failed", (F.col("_skipped") + F.col("_noop")).alias("skipped"), "self_skipped", "malformed", "index_operations", "update_operations", "remove_operations")


def latest_state(events: DataFrame) -> DataFrame:
    """The last writer wins: documents by their last event, absent if that is a removal."""
    last = events.groupBy("document_id").agg(F.max_by(F.struct("event_type", "content"), "log_offset").alias("s"))
    return last.where("s.event_type <> 'document_removed'").select("document_id", F.col("s.content").alias("content"))


#: Places of `seq` that one range of a mixed batch spans.
FOLD_RANGE = 10_000


def mixed_writes(batch: DataFrame, corpus: DataFrame, span: int = FOLD_RANGE) -> DataFrame:
    """Outcomes of writes (seq, document_id, kind, content) of kinds insert, update and delete, each seeing those before it.

    seq is unique and not negative. An insert leaves an id present, a delete absent, all others
    as it was, so what an operation finds is left by the last one that sets it: within
    its range of seq, else in a range before, else in the corpus. Ranges of an id are
    joined at their edges, so no task holds all writes of one id. Status: created,
    conflict, updated (equal content too), deleted, not_found, invalid (blank content,
    or an unknown kind, which is told as blank is).
    """
    blank = F.col("kind").isin("insert", "update") & X.blank(F.col("content"))
    known = F.coalesce(F.col("kind").isin("insert", "update", "delete"), F.lit(False))
    ops = batch.select("seq", "document_id", "kind", "content", (blank | ~known).alias("is_blank"), F.floor(F.col("seq") / span).alias("_range"))
    leaves = F.when(~F.col("is_blank") & (F.col("kind") == "insert"), True).when(F.col("kind") == "delete", False)
    ops = ops.withColumn("_leaves", leaves)
    before = Window.partitionBy("document_id", "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ops = ops.withColumn("_local", F.last("_leaves", ignorenulls=True).over(before))
    edges = ops.groupBy("document_id", "_range").agg(F.max_by("_leaves", F.when(F.col("_leaves").isNotNull(), F.col("seq"))).alias("_edge"))
    held = corpus.select("document_id", F.lit(True).alias("_held"))
    ranges = Window.partitionBy("document_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.join(held, "document_id", "left")  # a row for each range of an id
    edges = edges.select("document_id", "_range", F.coalesce(F.last("_edge", ignorenulls=True).over(ranges), "_held", F.lit(False)).alias("_found"))
    ops = ops.join(edges, ["document_id", "_range"]).withColumn("present", F.coalesce("_local", "_found"))
    status = (
        F.when(F.col("is_blank"), "invalid")
        .when(F.col("kind") == "insert", F.when(F.col("present"), "conflict").otherwise("created"))
        .when(~F.col("present"), "not_found")
        .when(F.col("kind") == "update", "updated")
        .otherwise("deleted")
    )
    ops = ops.withColumn("status", status)
    message = F.when(F.col("status") == "invalid", X.MSG_BLANK).when(F.col("status") == "conflict", _message("already exists")).when(F.col("status") == "not_found", _message("not found")).otherwise("")
    done = F.when(F.col("status").isin("created", "updated"), X.terms_indexed(F.col("content"))).otherwise(F.lit(0))
    return ops.select("seq", "document_id", "kind", "status", message.alias("message"), done.cast("long").alias("terms_indexed"), "content")


def mixed_table(batch: DataFrame, corpus: DataFrame, span: int = FOLD_RANGE) -> DataFrame:
    """The documents after mixed_writes: what the last write that succeeded left of each id."""
    done = mixed_writes(batch, corpus, span).where(F.col("status").isin("created", "updated", "deleted"))
    content = F.when(F.col("status") != "deleted", F.col("content"))
    last = done.groupBy("document_id").agg(F.max_by(F.struct(content.alias("new")), "seq").alias("last")).select("document_id", "last.new", F.lit(True).alias("touched"))
    both = corpus.select("document_id", "content").join(last, "document_id", "full_outer")
    return both.select("document_id", F.when(F.col("touched"), F.col("new")).otherwise(F.col("content")).alias("content"), "touched", "new").where("touched is null or new is not null").select("document_id", "content")
