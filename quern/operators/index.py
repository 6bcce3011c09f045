"""Postings in long form: building, lookups, statistics, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.storage import stored


def build_postings(corpus: DataFrame, *keep: str, terms: list[str] | None = None) -> DataFrame:
    """(term, document_id, tf) of (document_id, content), and further columns of the corpus to keep.

    All tokens of a document stand in its row, so they are sorted there and each run of
    equal ones becomes a posting: nothing is shuffled. A document id stands once. With
    terms, only postings of these: other tokens go before the sort.
    """
    found = X.tokens(F.col("content"))
    if terms is not None:
        found = F.filter(found, lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    tokens = corpus.select("document_id", *keep, F.sort_array(found).alias("tokens"))
    at = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))
    ends = F.filter(at, lambda i: (i == F.size("tokens") - 1) | (F.get("tokens", i) != F.get("tokens", i + 1)))
    runs = tokens.select("document_id", *keep, "tokens", ends.alias("ends"))
    before = F.coalesce(F.get("ends", F.col("k") - 1), F.lit(-1))
    # the outer form, as the other would bring a filter on the ends, for which each step is done again below
    rows = runs.select("document_id", *keep, "tokens", "ends", F.posexplode_outer("ends").alias("k", "e")).where("e is not null")
    return rows.select(F.get("tokens", F.col("e")).alias("term"), "document_id", (F.col("e") - before).cast("long").alias("tf"), *keep)


def postings_lists(postings: DataFrame) -> DataFrame:
    """One row for each term with its list by document. For export: a common term makes a long row."""
    return postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("document_id", "tf"))).alias("postings"))


def postings_lookup(postings: DataFrame, *terms: str) -> DataFrame:
    return postings.where(F.col("term").isin(*terms))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(corpus: DataFrame) -> DataFrame:
    """One row with n, documents without tokens included."""
    return corpus.agg(F.count(F.lit(1)).alias("n"))


def idf(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf), idf = ln(n / df)."""
    df = document_frequency(postings).crossJoin(F.broadcast(corpus_size(corpus)))  # one row
    return df.select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct()


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Documents, distinct terms, tokens, documents without tokens, in one row."""
    n = F.size(X.tokens(F.col("content")))
    docs = corpus.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("tokens"), F.count(F.when(n == 0, 1)).alias("empty_documents"))
    terms = vocabulary(build_postings(corpus)).agg(F.count(F.lit(1)).alias("terms"))
    return docs.crossJoin(F.broadcast(terms))


def forward_index(postings: DataFrame) -> DataFrame:
    return postings.groupBy("document_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def remove_from_index(postings: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings without the documents of removed (document_id)."""
    return postings.join(removed.select("document_id"), "document_id", "left_anti").select("term", "document_id", "tf")


def update_index(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of changed (document_id, content) in place of the old; only changed texts are read."""
    return remove_from_index(postings, changed).unionByName(build_postings(changed).select("term", "document_id", "tf"))


#: Terms of which a statistics table is broadcast; one with more is shuffled, with its hot terms apart.
BROADCAST_TERMS = 1_000_000


def join_terms(postings: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """postings with the columns of stats (term, df, ...), a row for each term; n: documents.

    Postings stay where they are if the statistics, which are counted, are small. Else
    they meet by term, but those of terms in more than a thousandth of the documents
    stay, as such terms are few: postings have at most as many terms above a share as a
    document has tokens, on average, times its inverse.
    """
    if stats.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return postings.join(F.broadcast(stats), "term")
    hot = stats.where(F.col("df") > max(2000, n // 1000))
    fast = postings.join(F.broadcast(hot), "term")
    slow = postings.join(F.broadcast(hot.select("term")), "term", "left_anti").join(stats, "term")
    return fast.unionByName(slow)


def tfidf_weights(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, document_id, weight), weight = tf * ln(n / df). Postings are written once: statistics and each way of the join read them."""
    postings = stored(postings.select("term", "document_id", "tf"), "postings")
    df = stored(document_frequency(postings), "df")
    n = corpus.count()
    weights = join_terms(postings, df.withColumn("idf", F.log(F.lit(n) / F.col("df"))), n)
    return weights.select("term", "document_id", (F.col("tf") * F.col("idf")).alias("weight"))


def write_postings(postings: DataFrame, path: str, files: int = 32) -> None:
    """Store postings so that a filter on term reads few row groups."""
    out = postings.repartitionByRange(files, "term").sortWithinPartitions("term", "document_id")
    out.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def read_postings(spark: SparkSession, path: str, *terms: str) -> DataFrame:
    """Stored postings, of the given terms if there are any: only their row groups are read."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("term").isin(*terms)) if terms else stored
