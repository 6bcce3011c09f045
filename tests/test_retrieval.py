"""Retrieval from blocks and bitmaps, modes, and the plans that they must keep."""

import re

import pytest
from pyspark.sql import functions as F
from quern import registry
from quern.functions import text as X
from quern.operators import bitmaps as BM
from quern.operators import blocks as B
from quern.operators import index as I
from quern.operators import search as S
from quern.plans.views import view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    """Documents of very unequal length, so that bounds differ."""
    rows = [(k, " ".join(["apple" if k % 4 else "plum"] * (k % 40 + 1) + [f"w{k % 17}"] * (k % 3) + ["pear"] * (k % 5 == 0))) for k in range(4000)]
    return spark.createDataFrame(rows, "document_id long, content string")


@pytest.fixture(scope="module")
def small_index(small):
    index = B.write_index(small)
    yield index
    index.drop()


def requests(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "query_id int, query string, mode string, lim int")


ASKED = [("apple", "or", 5), ("apple pear", "and", 7), ("w3 pear", "or", 20), ("w3 w4", "and", 5), ("nothing", "or", 5), ("apple", "xor", 5), ("apple", None, 3), ("  ", "or", 5), ("apple", "or", 0), ("apple", "or", 5000)]


def test_blocks_equal_batch(spark, small, small_index):
    asked = requests(spark, *ASKED)
    want = S.search_batch(asked, I.build_postings(small), I.corpus_size(small)).collect()
    hits, _ = B.search_blocks(asked, small_index)
    assert sorted(hits.collect()) == sorted(want)
    assert {r.query_id for r in want} == {0, 1, 2, 6, 9}


def test_blocks_are_left_out(spark, small_index):
    """Ranges that can't reach the k-th score are not scored, and those scored hold every hit."""
    hits, judged = B.search_blocks(requests(spark, ("pear w3", "or", 3), ("apple", "and", 4)), small_index)
    seen = {(r["query_id"], r["pass"]): r["count"] for r in judged.groupBy("query_id", "pass").count().collect()}
    assert all(seen[q, None] > 0 for q in (0, 1))
    assert hits.count() == 7
    floor = {q: min(r.score for r in hits.collect() if r.query_id == q) for q in (0, 1)}
    assert all(r.bound < floor[r.query_id] for r in judged.where("pass is null").collect())


def test_many_terms_and_large_limits(spark, small, small_index, monkeypatch):
    """Beyond the bounds of filters and broadcasts the rows are the same."""
    asked = requests(spark, *ASKED)
    want = sorted(S.search_batch(asked, I.build_postings(small), I.corpus_size(small)).collect())
    monkeypatch.setattr(S, "FILTER_TERMS", 2)
    monkeypatch.setattr(S, "SCAN_LIMIT", 4)
    monkeypatch.setattr(B, "BROADCAST_PAIRS", 1)
    assert sorted(B.search_blocks(asked, small_index)[0].collect()) == want
    assert sorted(S.search_batch(asked, S.asked_postings(asked, small), I.corpus_size(small)).collect()) == want


def test_stored_plans(spark, small, small_index):
    weights = plan(B.weights(small_index))
    assert "Exchange hashpartitioning" not in weights
    scan = plan(B.read_postings(small_index, "pear"))
    assert "EqualTo(term,pear)" in scan or "In(term" in scan
    asked, terms, most = B._asked(requests(spark, ("apple pear", "or", 5)), small_index)
    bounds = plan(B.bound_ranges(asked, small_index, terms))
    assert "Exchange hashpartitioning" not in bounds and "postings#" not in bounds.split("FileScan")[-1].split("]")[0]
    assert sorted(B.read_postings(small_index).collect()) == sorted(I.build_postings(small).select("term", "document_id", "tf").collect())


def test_weights_with_large_vocabulary(spark, small, monkeypatch):
    want = sorted((r.term, r.document_id, round(r.weight, 9)) for r in I.tfidf_weights(I.build_postings(small), small).collect())
    monkeypatch.setattr(I, "BROADCAST_TERMS", 1)
    assert sorted((r.term, r.document_id, round(r.weight, 9)) for r in I.tfidf_weights(I.build_postings(small), small).collect()) == want


def test_top_k_is_cut_before_the_shuffle(spark, small):
    asked = requests(spark, ("apple", "or", 5))
    assert plan(S.search_batch(asked, S.asked_postings(asked, small), I.corpus_size(small))).count("WindowGroupLimit") == 2


def test_terms_go_into_the_build(spark, small):
    some = I.build_postings(small, terms=["pear", "w3"])
    assert sorted(some.collect()) == sorted(I.build_postings(small).where("term in ('pear', 'w3')").collect())
    assert I.build_postings(small, terms=[]).count() == 0


def test_unknown_modes_are_errors(spark, small):
    for f in (lambda m: S.search(small, "apple", m), lambda m: S.boolean_query(I.build_postings(small), "apple", m), lambda m: BM.boolean_bitmaps(None, "apple", m)):
        for mode in ("xor", "AND", "Or"):
            with pytest.raises(ValueError, match="Invalid mode"):
                f(mode)
    totals = S.search_totals(requests(spark, ("apple pear", "AND", 5), ("apple", "", 5)), I.build_postings(small), I.corpus_size(small)).collect()
    assert [(r.is_error, r.total, r.error_message) for r in sorted(totals)] == [(True, 0, "Invalid mode: must be 'and' or 'or'"), (False, 3000, "")]


def test_bitmaps(spark):
    ids = [0, 1, 2, 32767, 32768, 32769, 65536, 65537, 10**12]
    postings = spark.createDataFrame([("a", i, 1) for i in ids] + [("b", i, 1) for i in ids[::2]] + [("c", 5, 1), ("d", -40000, 1)], "term string, document_id long, tf long")
    bits = BM.build_bitmaps(postings)
    rows = lambda q, m: sorted(r.document_id for r in BM.boolean_bitmaps(bits, q, m).collect())
    assert rows("a", "or") == ids and rows("d", "or") == [-40000]
    assert rows("a b", "and") == ids[::2] and rows("a c", "and") == [] and rows("a c", "or") == sorted([*ids, 5])
    assert rows("zz", "or") == [] and rows("a zz", "and") == [] and rows("!", "or") == []
    assert [BM.count_matches(bits, "a c", m).first().total for m in ("or", "and")] == [10, 0]


def test_queries_have_rows_of_each_kind(spark, sf_dir):
    kinds = lambda name, column: {r[0] for r in registry.queries()[name](spark, sf_dir).select(column).distinct().collect()}
    assert kinds("search_failure_rows", "category") == {"count_failure", "search_failure"}
    assert kinds("partial_availability_search", "complete") == {False}
    assert kinds("mixed_writes", "status") == {"created", "conflict", "updated", "deleted", "not_found", "invalid"}
    assert kinds("replica_differences", "difference") == {"missing", "unexpected", "content"}
    assert kinds("ambiguous_placement", "problem") == {"not_found", "ambiguous"}
    assert registry.queries()["in_order_check"](spark, sf_dir.replace("0.001", "0.01")).count() > 0  # ids clash from 1000 events on
    full = registry.queries()["search_batch"](spark, sf_dir).count()
    assert registry.queries()["partial_availability_search"](spark, sf_dir).count() < full


def test_requests_are_whole_texts(spark, sf_dir):
    texts = {r.text for r in view(spark, sf_dir, "documents").collect()}
    assert all(r.query in texts for r in view(spark, sf_dir, "query_batch").where("query_id > 100").collect())


def test_texts_are_not_dealt_by_shard(spark, small):
    """Shards are a handful, and are broadcast even where their size is not known."""
    corpus = small.withColumn("shard_id", F.col("document_id") % 3)
    health = spark.createDataFrame([(0, 0, 0, True, True), (1, 0, 1, False, False), (2, 0, 2, True, False)], "shard_id long, replica_rank int, node_id int, count_ok boolean, search_ok boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.failure_rows(requests(spark, ("apple pear", "or", 5)), corpus, health)
        assert not re.search(r"SortMergeJoin \[shard_id#\d+L?\], \[shard_id#\d+L?\], LeftSemi", plan(out))
        assert out.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_taken_apart_once(small):
    """Weights and each way of their join read written postings; ranges of the index need no tokens."""
    assert "regexp_extract_all" not in plan(I.tfidf_weights(I.build_postings(small), small))
    assert "regexp_extract_all" not in plan(B.with_ranges(small))


def test_tokens_are_lower_cased_as_runs(spark):
    """Characters whose lower case is or has an ASCII letter stay outside of runs."""
    texts = ["a\u0130B \u212aelvin 3\u212a", "\u00c4Pfel \u03a3A \ufb01N", "", None, "The THE the"]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")
    got = {r.document_id: r.t for r in df.select("document_id", X.tokens(F.col("content")).alias("t")).collect()}
    assert got == {i: [t.lower() for t in re.findall("[A-Za-z0-9]+", x or "")] for i, x in enumerate(texts)}
    assert "lambda" not in plan(df.select(X.tokens(F.col("content"))))
