"""A stored index of posting blocks, and exact top-k search that leaves blocks out by their maxima.

Documents are dealt into small ranges of similar length. A block holds the postings of one
term in one range, with their number and largest tf. The table is bucketed by range: all
blocks of a range lie in one bucket, so sums over the terms of a document or a range need no shuffle,
and a common term lies in all buckets alike. Inside a bucket rows ascend by term, so a
filter on terms reads few row groups. df of the terms and n are stored beside.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import new_path, stored
from . import index as I
from . import search as S

#: Documents of a range, on average; ranges that the first pass may read for each request, above what its limit needs.
RANGE_DOCS, SPARE_RANGES = 128, 2
#: Length classes of one doubling of the number of bytes.
CLASSES = 4
#: Bytes of blocks that one bucket file should hold, and the bytes that a document's postings are taken for.
BUCKET_BYTES, DOC_BYTES = 256 << 20, 4096
#: Pairs of requests and ranges that are broadcast.
BROADCAST_PAIRS = 1_000_000
#: Slack of a bound against sums in another order.
SLACK = 1 + 1e-9


@dataclass(frozen=True)
class BlockIndex:
    """Names of the stored tables: blocks (term, range, n, max_tf, postings), terms (term, df); n documents."""

    spark: SparkSession
    blocks: str
    terms: str
    n: int

    def read_blocks(self, terms: list[str] | None = None) -> DataFrame:
        found = self.spark.table(self.blocks)
        return found if terms is None else found.where(F.col("term").isin(*terms) if terms else F.lit(False))

    def read_terms(self, terms: list[str] | None = None) -> DataFrame:
        found = self.spark.table(self.terms)
        return found if terms is None else found.where(F.col("term").isin(*terms) if terms else F.lit(False))

    def drop(self) -> None:
        for name in (self.blocks, self.terms):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_ranges(corpus: DataFrame) -> DataFrame:
    """corpus with `range`: a class of lengths and, inside it, one of as many parts as it has RANGE_DOCS documents."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))  # bytes tell the length as well as tokens do, and cost nothing
    classed = corpus.select("document_id", "content", F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES).cast("long").alias("_class"))
    # a row for each class: at most CLASSES times 31
    parts = corpus.sparkSession.createDataFrame([(r[0], max(1, -(-r[1] // RANGE_DOCS))) for r in classed.groupBy("_class").count().collect()], "_class long, _parts long")
    dealt = classed.join(F.broadcast(parts), "_class")
    return dealt.select("document_id", "content", (F.col("_class") * F.lit(1 << 48) + F.pmod(F.xxhash64("document_id"), F.col("_parts"))).alias("range"))


def write_index(corpus: DataFrame, name: str | None = None) -> BlockIndex:
    """Store the index of (document_id, content) as tables name_blocks and name_terms in the shared folder."""
    spark = corpus.sparkSession
    name = name or f"quern_{uuid.uuid4().hex[:12]}"
    n = corpus.count()
    buckets = max(1, min(8192, max(n * DOC_BYTES // BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    postings = I.build_postings(with_ranges(corpus), "range")
    blocks = (
        postings.repartition(buckets, "range")
        .groupBy("range", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.sort_array(F.collect_list(F.struct("document_id", "tf"))).alias("postings"))
    )
    index = BlockIndex(spark, f"{name}_blocks", f"{name}_terms", n)
    blocks.write.bucketBy(buckets, "range").sortBy("term").option("path", new_path(spark, "blocks")).saveAsTable(index.blocks)
    terms = spark.table(index.blocks).groupBy("term").agg(F.sum("n").alias("df"))
    terms.repartitionByRange(max(1, buckets // 16), "term").sortWithinPartitions("term").write.option("path", new_path(spark, "terms")).saveAsTable(index.terms)
    return index


def read_postings(index: BlockIndex, *terms: str) -> DataFrame:
    """(term, document_id, tf), of all terms or of the given ones."""
    rows = index.read_blocks(list(terms) if terms else None).select("term", F.explode("postings").alias("p"))
    return rows.select("term", "p.document_id", "p.tf")


def weights(index: BlockIndex) -> DataFrame:
    """tf-idf weights from the stored tables; statistics are joined to blocks, which are then unfolded in place."""
    stats = index.read_terms().select("term", "df", F.log(F.lit(index.n) / F.col("df")).alias("idf"))
    rows = I.join_terms(index.read_blocks().select("term", "postings"), stats, index.n)
    return rows.select("term", "idf", F.explode("postings").alias("p")).select("term", "p.document_id", (F.col("p.tf") * F.col("idf")).alias("weight"))


def _asked(requests: DataFrame, index: BlockIndex) -> tuple[DataFrame, list[str] | None, int | None]:
    """A row for each term of each valid request that has postings (query_id, mode, n_terms, lim, term, idf); the terms and the largest limit.

    A batch of at most FILTER_TERMS rows is looked up by one filter and held as a local table; a larger one
    stays a table of its own, without list and limit.
    """
    asked = S.query_table(requests).where("error is null").select("query_id", "mode", "n_terms", "lim", F.explode("terms").alias("term"))
    rows = asked.limit(S.FILTER_TERMS + 1).toPandas()  # bounded
    if len(rows) > S.FILTER_TERMS:
        stats = index.read_terms().select("term", F.log(F.lit(index.n) / F.col("df")).alias("idf"))
        return stored(asked.join(stats, "term"), "asked"), None, None
    terms = sorted(set(rows.term))
    stats = index.read_terms(terms).select("term", F.log(F.lit(index.n) / F.col("df")).alias("idf")).toPandas()
    found = rows.merge(stats, on="term")[["query_id", "mode", "n_terms", "lim", "term", "idf"]]
    schema = T.StructType([*asked.schema.fields, T.StructField("idf", T.DoubleType())])
    return requests.sparkSession.createDataFrame(pa.Table.from_pandas(found, schema=to_arrow_schema(schema), preserve_index=False), schema), terms, int(rows.lim.max()) if len(rows) else 0


def bound_ranges(asked: DataFrame, index: BlockIndex, terms: list[str] | None) -> DataFrame:
    """(query_id, range, lim, bound, docs): the most that a document of the range can score, and how many documents it surely has at hand.

    Only ranges that can hold a hit are listed: all terms of an "and" request have a block there.
    Postings are not read, but their numbers and maxima.
    """
    heads = index.read_blocks(terms).select("term", "range", "n", "max_tf").join(F.broadcast(asked), "term")
    found = heads.groupBy("query_id", "range").agg(
        (F.sum(F.col("max_tf") * F.col("idf")) * SLACK).alias("bound"),
        F.max("n").alias("docs"),
        F.count(F.lit(1)).alias("k"),
        F.first("mode").alias("mode"),
        F.first("n_terms").alias("n_terms"),
        F.first("lim").alias("lim"),
    )
    return found.where("mode <> 'and' or k = n_terms").select("query_id", "range", "lim", "bound", "docs")


def score_ranges(asked: DataFrame, index: BlockIndex, wanted: DataFrame, terms: list[str] | None) -> DataFrame:
    """All hits (query_id, document_id, score) in the wanted (query_id, range)."""
    rows = index.read_blocks(terms).select("term", "range", "postings").join(F.broadcast(asked), "term")
    pairs = wanted.select("query_id", "range")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    rows = rows.join(F.broadcast(pairs) if few else pairs, ["query_id", "range"], "left_semi")
    hits = rows.select("query_id", "range", "mode", "n_terms", "term", "idf", F.explode("postings").alias("p"))
    grouped = hits.groupBy("query_id", "range", "p.document_id").agg(
        F.collect_list(F.struct("term", (F.col("p.tf") * F.col("idf")).alias("value"))).alias("parts"), F.first("mode").alias("mode"), F.first("n_terms").alias("n_terms")
    )
    grouped = grouped.where((F.col("mode") != "and") | (F.size("parts") == F.col("n_terms")))
    return grouped.select("query_id", "document_id", S._sum_in_order(F.col("parts")).alias("score"))


def plan_ranges(ranges: DataFrame) -> DataFrame:
    """ranges with `first`: whether the first pass reads them, those of the highest bounds that hold limit documents."""
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range").rowsBetween(Window.unboundedPreceding, -1)
    before, nth = F.coalesce(F.sum("docs").over(falling), F.lit(0)), F.count(F.lit(1)).over(falling)
    return ranges.withColumn("_before", before).withColumn("_nth", nth).withColumn("first", (F.col("_before") < F.col("lim")) | (F.col("_nth") < SPARE_RANGES)).drop("_before", "_nth")


def search_blocks(requests: DataFrame, index: BlockIndex) -> tuple[DataFrame, DataFrame]:
    """The hits of search_batch, and (query_id, range, bound, pass) for each range that was listed: 1, 2, or null if it was left out.

    The first pass scores the most promising ranges of each request, which gives a k-th
    score; the second scores the others whose bound reaches it. A range below can't change the result, as every
    document in it scores less than the k-th.
    """
    asked, terms, most = _asked(requests, index)
    ranges = stored(plan_ranges(bound_ranges(asked, index, terms)), "ranges")
    limits = requests.select("query_id", "lim")
    near = stored(S.best_hits(score_ranges(asked, index, ranges.where("first"), terms), limits, most), "near")
    floor = near.join(limits, "query_id").where("rank = lim").select("query_id", F.col("score").alias("floor"))
    judged = ranges.join(floor, "query_id", "left").withColumn("pass", F.when(F.col("first"), 1).when(F.coalesce(F.col("bound") >= F.col("floor"), F.lit(True)), 2))
    far = score_ranges(asked, index, judged.where("pass = 2"), terms)
    hits = S.best_hits(near.select("query_id", "document_id", "score").unionByName(far), limits, most)
    return hits, judged.select("query_id", "range", "bound", "pass")
