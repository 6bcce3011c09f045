"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are dealt by (source, range of the key), so that a
source of any size is spread over thousands of ranges; sums per range give each range's
offset, a window inside a range gives each row's offset, and the source is cut
at its exact budget. A budget above a source's size repeats the source in epochs.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, read_table

#: Hexadecimal digits of the key that name its range: 4096 ranges of a source. A range is
#: sorted by one task at a time.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets from a table (source, source_size) with one row for each source.

    Sources stand in the order of their code points, null last, and take the weights in
    turn. Together they get share times all sizes; none gets more than cap times its own
    size, what is above is shared out again by weight. That ends at one level: each
    target is least(cap * size, level * weight). The level is found by going through the
    sources in the order of cap * size / weight, in one task: a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("weight"))
    rising = Window.orderBy("_r", "_n")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("_left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_wleft"))
        .withColumn("_i", F.row_number().over(rising))
    )
    level = F.min_by(F.when(F.col("_level") <= F.col("_r"), F.col("_level")), F.when(F.col("_level") <= F.col("_r"), F.col("_i"))).over(everything)
    ranked = ranked.withColumn("_at", level)
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", carry: tuple[str, ...] = ()) -> DataFrame:
    """Return doc_id, source, size, source_size, target and taken for each row of docs.

    taken is the number of words of the row that the mix holds, repeats counted. Rows of
    a source are taken in the order of md5(seed:doc_id); ties (repeated ids) by size. A
    null text has size 0 and is taken 0 times; a null source is a source of its own; an
    empty table gives an empty result. A text of any length is one size. Columns named in
    carry come along, others are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    ).withColumns(
        {
            "_src": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")),
            "_range": F.substring("_key", 1, RANGE_DIGITS),
        }
    )
    if not carry:  # narrow rows: texts are counted once
        rows = materialize(rows, "sizes")
    ranges = rows.groupBy("_src", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    by_source = Window.partitionBy("_src")
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum("_sum").over(by_source.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = ranges.groupBy("_src").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, cap).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("_src"), "source_size", "target"
    )
    plan = ranges.select("_src", "_range", "_offset").join(targets, "_src")
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["_src", "_range"])
    budget = F.floor("target").cast("long")
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.expr("floor(target) div source_size") * F.col("size")
        + F.greatest(F.lit(0), F.least(F.col("size"), budget % F.col("source_size") - F.col("_offset") - F.col("_before")))
    )
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s0),
s2 AS (SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(2 AS DOUBLE) * source_size AS c FROM s1),
s3 AS (SELECT *, c / w AS r FROM s2),
s4 AS (SELECT *, (CAST(1.5 AS DOUBLE) * (sum(source_size) OVER ()) - coalesce(sum(c) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv,
         row_number() OVER (ORDER BY r, n) AS i FROM s3),
lev AS (SELECT min_by(lv, i) AS lstar FROM s4 WHERE lv <= r),
t AS (SELECT source, source_size, CASE WHEN lstar IS NULL THEN c ELSE least(c, lstar * w) END AS target FROM s4, lev),
p AS (SELECT d.*, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
    + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - pre)) END AS BIGINT) AS taken
FROM p
"""
