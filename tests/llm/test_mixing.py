import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def level_by_rounds(sizes, weights=(5, 2, 1)):
    """Share by weight; what is above a limit is shared again, until nothing is."""
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total, part = sum(w[k] for k in open_), left
        left = 0.0
        for k in sorted(open_, key=str):
            target[k] += part * w[k] / total
        for k in list(open_):
            if target[k] > 2 * sizes[k]:
                left += target[k] - 2 * sizes[k]
                target[k] = 2 * sizes[k]
                open_.discard(k)
    return target


@pytest.mark.parametrize("case", [{"a": 100, "b": 50, "c": 10}, {"a": 5, "b": 5000, None: 3, "z": 800}, {"a": 0, "b": 10}, {"a": 7}])
def test_targets_by_rounds(spark, case):
    df = spark.createDataFrame(list(case.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = level_by_rounds(case)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_cut_is_exact_and_repeats(spark, sf_dir):
    df = mixing.op7_mix_sources(spark, sf_dir).cache()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    per = df.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.sum("size").alias("s"), F.first("source_size").alias("z")).collect()
    assert all(r.t == int(r.target) and r.s == r.z for r in per)
    assert df.where("taken > 2 * size or taken < 0").count() == 0
    assert sorted(df.collect()) == sorted(mixing.op7_mix_sources(spark, sf_dir).collect())


def test_nulls_ties_empty(spark):
    df = spark.createDataFrame([(1, None, None, 9), (None, " a b ", None, 9), (2, "x y z", "s", 9), (2, "x y z", "s", 9), (3, "", "t", 9)], "doc_id long, text string, source string, size int")
    rows = mixing.mix_sources(df).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 3, 3]
    assert sum(r.taken for r in rows) in (11, 12)
    assert mixing.mix_sources(df.limit(0)).count() == 0
