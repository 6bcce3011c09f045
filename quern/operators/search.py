"""Boolean and ranked retrieval, one query at a time or many in one job.

Scores add tf * ln(n / df) in ascending order of the terms, so ties and ranks do not
depend on how rows were shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.storage import stored
from . import index as I


def query_terms(query: str) -> list[str]:
    """Sorted distinct terms of a query string."""
    import re

    return sorted({t.lower() for t in re.findall("[A-Za-z0-9]+", query)})


def check_mode(mode: str) -> str:
    """and or or; an empty mode is or, any other a ValueError."""
    if mode not in ("", "and", "or"):
        raise ValueError(X.MSG_MODE)
    return mode or "or"


def intersect(postings: DataFrame, a: str, b: str) -> DataFrame:
    left = postings.where(F.col("term") == a).select("document_id")
    return left.intersect(postings.where(F.col("term") == b).select("document_id"))


def union(postings: DataFrame, a: str, b: str) -> DataFrame:
    return postings.where(F.col("term").isin(a, b)).select("document_id").distinct()


def boolean_query(postings: DataFrame, query: str, mode: str = "or") -> DataFrame:
    """Documents that hold all ("and") or any ("or") of the query's terms."""
    check_mode(mode)
    terms = query_terms(query)
    hits = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    counted = hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))
    return (counted.where(F.col("k") == len(terms)) if mode == "and" else counted).select("document_id")


#: Distinct terms of a batch that are passed to scans as a filter, and the largest limit that a scan keeps by itself.
FILTER_TERMS, SCAN_LIMIT = 5000, 1000


def query_table(requests: DataFrame) -> DataFrame:
    """requests (query_id, query, mode, lim) with error, terms and n_terms; an empty mode is "or", others are errors."""
    mode = F.when(F.coalesce("mode", F.lit("")) == "", "or").otherwise(F.col("mode"))
    blank = F.coalesce(X.trim_query(F.col("query")), F.lit("")) == ""
    error = F.when(~mode.isin("and", "or"), X.MSG_MODE).when(blank | F.coalesce(F.col("lim") < 1, F.lit(True)), X.MSG_REQUEST)
    out = requests.withColumn("mode", mode).withColumn("error", error)
    return out.withColumn("terms", X.distinct_terms(F.col("query"))).withColumn("n_terms", F.size("terms"))


def _sum_in_order(parts: Column) -> Column:
    """The sum of (term, value) structs in the order of their terms."""
    return F.aggregate(F.sort_array(parts), F.lit(0.0), lambda a, x: a + x["value"])


def asked_terms(requests: DataFrame) -> list[str] | None:
    """The distinct terms of valid requests, or None if there are more than a filter can hold."""
    terms = query_table(requests).where("error is null").select(F.explode("terms").alias("term")).distinct()
    found = [r.term for r in terms.limit(FILTER_TERMS + 1).collect()]  # bounded
    return sorted(found) if len(found) <= FILTER_TERMS else None


def asked_postings(requests: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """The postings that a batch asks for, written once: hits and their statistics share them."""
    terms = asked_terms(requests)
    postings = I.build_postings(corpus, *keep, terms=terms)
    if terms is None:
        wanted = query_table(requests).where("error is null").select(F.explode("terms").alias("term")).distinct()
        postings = postings.join(wanted, "term", "left_semi")
    return stored(postings, "asked")


def score_batch(requests: DataFrame, postings: DataFrame, n_docs: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """All hits (query_id, document_id, score) of valid requests, before limits.

    Only postings of asked terms go on; a group holds one row for each term of a query.
    df: (term, df), if it does not come from the same postings.
    """
    asked = query_table(requests).where("error is null").select("query_id", "mode", "n_terms", F.explode("terms").alias("term"))
    terms = asked_terms(requests)
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi") if terms is None else postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    df = I.document_frequency(postings) if df is None else df
    stats = df.crossJoin(F.broadcast(n_docs)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))  # one row
    asked = asked.join(stats, "term")
    # asked has a row for each term of each request; with few terms of few requests it is small
    few = terms is not None and requests.limit(FILTER_TERMS + 1).count() <= FILTER_TERMS
    hits = postings.join(F.broadcast(asked) if few else asked, "term").withColumn("value", F.col("tf") * F.col("idf"))
    grouped = hits.groupBy("query_id", "document_id").agg(
        F.collect_list(F.struct("term", "value")).alias("parts"), F.first("mode").alias("mode"), F.first("n_terms").alias("n_terms")
    )
    grouped = grouped.where((F.col("mode") != "and") | (F.size("parts") == F.col("n_terms")))
    return grouped.select("query_id", "document_id", _sum_in_order(F.col("parts")).alias("score"))


def best_hits(scored: DataFrame, requests: DataFrame, most: int | None = None) -> DataFrame:
    """The first lim of (query_id, document_id, score) for each request, with rank.

    Every task keeps only as many hits of a request as the largest limit before it
    shuffles; beyond SCAN_LIMIT that is done by 64 parts of the documents. most: the
    largest limit, if it is known.
    """
    most = requests.agg(F.max("lim")).first()[0] or 0 if most is None else most  # one number
    order = (F.desc("score"), "document_id")
    if most > SCAN_LIMIT:
        part = F.pmod(F.xxhash64("document_id"), F.lit(64))
        near = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order)))
        scored = near.where(F.col("_rank") <= most).drop("_rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    limits = requests.select("query_id", "lim")
    ranked = ranked.where(F.col("rank") <= F.lit(int(most))).join(limits, "query_id").where("rank <= lim")
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "document_id", "score")


def search_batch(requests: DataFrame, postings: DataFrame, n_docs: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """The first lim hits of each request: query_id, rank, document_id, score."""
    return best_hits(score_batch(requests, postings, n_docs, df), requests)


def search_totals(requests: DataFrame, postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """A row for each request, with the number of hits before the limit."""
    hits = score_batch(requests, postings, n_docs).groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    out = query_table(requests).join(hits, "query_id", "left")
    return out.select(
        "query_id",
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.col("error").isNotNull().alias("is_error"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        F.lit(True).alias("complete"),
    )


def search(corpus: DataFrame, query: str, mode: str = "or", limit: int = 10, postings: DataFrame | None = None) -> DataFrame:
    """Ranked hits of one query; limit None gives all. Raises ValueError for an invalid request."""
    mode = check_mode(mode)
    if not query.strip(" \t\n\r") or (limit is not None and limit < 1):
        raise ValueError(X.MSG_REQUEST)
    terms = query_terms(query)
    if not terms:
        return corpus.limit(0).select("document_id", F.lit(0.0).alias("score"))
    hits = stored(I.build_postings(corpus, terms=terms), "hits") if postings is None else postings.where(F.col("term").isin(*terms))
    # one row of statistics, of fixed width
    stats = I.document_frequency(hits).agg(*[F.sum(F.when(F.col("term") == t, F.col("df"))).alias(f"df{i}") for i, t in enumerate(terms)])
    per_doc = hits.groupBy("document_id").agg(*[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)])
    if mode == "and":
        for i in range(len(terms)):
            per_doc = per_doc.where(F.col(f"tf{i}").isNotNull())
    both = per_doc.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(I.corpus_size(corpus)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.coalesce(F.col(f"tf{i}") * F.log(F.col("n") / F.col(f"df{i}")), F.lit(0.0))
    out = both.select("document_id", score.alias("score")).orderBy(F.desc("score"), "document_id")
    return out if limit is None else out.limit(limit)


def sharded_search(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Statistics by shard, summed to global ones, then one ranking: equal to search_batch for any sharding."""
    postings = asked_postings(requests, corpus, "shard_id")
    per_shard = postings.groupBy("shard_id", "term").agg(F.count(F.lit(1)).alias("df"))
    df = per_shard.groupBy("term").agg(F.sum("df").alias("df"))
    n = corpus.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"))
    return search_batch(requests, postings.drop("shard_id"), n, df)


def select_replicas(health: DataFrame) -> DataFrame:
    """For each shard the first replica in rank order that answers count, pinned for the query; null if none."""
    healthy = F.when(F.col("count_ok"), F.col("replica_rank"))
    return health.groupBy("shard_id").agg(
        F.min_by("node_id", healthy).alias("node_id"),
        F.min_by("node_id", "replica_rank").alias("primary_node_id"),
        F.min(healthy).alias("pinned_rank"),
    )


def live_shards(health: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shards whose documents are counted, and shards whose pinned replica can be searched."""
    pinned = select_replicas(health).where("node_id is not null").select("shard_id", F.col("pinned_rank").alias("replica_rank"))
    searched = pinned.join(health.where("search_ok"), ["shard_id", "replica_rank"], "left_semi").select("shard_id")
    return pinned.select("shard_id"), searched


def _in_shards(corpus: DataFrame, shards: DataFrame) -> DataFrame:
    """corpus rows of shards (shard_id), which are a handful by design: dealt by shard, texts would fill as few tasks."""
    return corpus.join(F.broadcast(shards), "shard_id", "left_semi")


def partial_search(requests: DataFrame, corpus: DataFrame, health: DataFrame) -> DataFrame:
    """search_batch over what is reachable, with complete; n and df may come from different shards."""
    counted, searched = live_shards(health)
    n = _in_shards(corpus, counted).agg(F.count(F.lit(1)).alias("n"))
    postings = asked_postings(requests, _in_shards(corpus, searched))
    shards = health.select("shard_id").distinct().agg(F.count(F.lit(1)).alias("k"))
    whole = searched.agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(shards)).select((F.col("s") == F.col("k")).alias("complete"))
    return search_batch(requests, postings, n).crossJoin(F.broadcast(whole))


def failure_rows(requests: DataFrame, corpus: DataFrame, health: DataFrame) -> DataFrame:
    """count_failure for each dead shard, search_failure for each term and shard that can't be searched.

    An "and" query stops at its first term without a posting, whose failures still count.
    Without any counted document no term is looked up.
    """
    counted, searched = live_shards(health)
    primary = select_replicas(health).select("shard_id", F.col("primary_node_id").alias("node_id"))
    valid = query_table(requests).where("error is null and n_terms > 0").select("query_id", "mode", "terms")
    dead = primary.join(counted, "shard_id", "left_anti")  # shards are a handful by design
    count_rows = valid.select("query_id").crossJoin(F.broadcast(dead)).select("query_id", "node_id", "shard_id", F.lit("count_failure").alias("category"), F.lit("").alias("term"))
    asked = valid.select("query_id", "mode", F.explode("terms").alias("term"))
    postings = I.build_postings(_in_shards(corpus, searched), terms=asked_terms(requests))
    found = postings.join(asked.select("term").distinct(), "term", "left_semi").select("term").distinct().withColumn("found", F.lit(True))
    asked = asked.join(found, "term", "left")
    stop = asked.where("mode = 'and' and found is null").groupBy("query_id").agg(F.min("term").alias("stop"))
    reached = asked.join(stop, "query_id", "left").where("stop is null or term <= stop")
    n = _in_shards(corpus, counted).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    unsearched = primary.join(searched, "shard_id", "left_anti")
    search_rows = reached.crossJoin(F.broadcast(unsearched)).crossJoin(F.broadcast(n)).select("query_id", "node_id", "shard_id", F.lit("search_failure").alias("category"), "term")
    return count_rows.unionByName(search_rows)


def get_documents(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """ids (document_id) with found and content."""
    held = corpus.select("document_id", "content", F.lit(True).alias("held"))
    return ids.join(held, "document_id", "left").select("document_id", F.coalesce("held", F.lit(False)).alias("found"), "content")


def total_document_count(inventory: DataFrame) -> DataFrame:
    """Documents over all shards; copies on several nodes count once."""
    per_shard = inventory.groupBy("shard_id").agg(F.countDistinct("document_id").alias("n"))
    return per_shard.agg(F.sum("n").alias("total"))
