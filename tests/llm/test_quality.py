import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality as q


class Brute:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        top = Counter(x[i : i + q.ORDER] for x in map(q.normalised, texts) for i in range(len(x) - q.ORDER + 1))
        self.counts = {q.ORDER: top}
        for k in range(q.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {}
        for k, c in self.counts.items():
            n = [sum(v == j for v in c.values()) for j in range(6)]
            d = []
            for j, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
                x = None
                if n[1] and n[j]:
                    x = j - (j + 1) * (n[1] / (n[1] + 2 * n[2])) * n[j + 1] / n[j]
                d.append(x if x is not None and 0 < x < j else usual)
            self.d[k] = d
        self.total, self.mass = defaultdict(float), defaultdict(float)
        for k, c in self.counts.items():
            for g, v in c.items():
                self.total[k, g[:-1]] += v
                self.mass[k, g[:-1]] += self.d[k][min(v, 3) - 1]

    def p(self, g):
        k = len(g)
        lower = self.p(g[1:]) if k > 1 else 1 / 0x110000
        t = self.total.get((k, g[:-1]))
        if not t:
            return lower
        v = self.counts[k].get(g, 0)
        kept = v - self.d[k][min(v, 3) - 1] if v else 0
        return (kept + self.mass[k, g[:-1]] * lower) / t

    def perplexity(self, text):
        x = q.normalised(text)
        n = len(x) - q.ORDER + 1
        return math.exp(-sum(math.log(self.p(x[i : i + q.ORDER])) for i in range(n)) / n)


TRUSTED = ["the cat sat on the mat", "a cat and a dog, 12 cats", "the dog ran  to the man", "thé ça va"]


def test_same_as_dictionaries(spark):
    docs = [(i, "en", t) for i, t in enumerate(["the cat", "a man and a dog ran", "zzz qqq", "x", "THE 99 dogs\n\nsat", "日本 the", "the cat " * 300])]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    trusted = spark.createDataFrame([("en", t) for t in TRUSTED] + [("de", "ganz anders")], "lang string, text string")
    brute = Brute(TRUSTED)
    got = {r.doc_id: r for r in q.perplexities(df, trusted, block_chars=60).collect()}
    for i, _, t in docs:
        assert math.isclose(got[i].perplexity, brute.perplexity(t), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    brute = Brute(TRUSTED)
    for context in ("the", "zzz", " ca"):
        seen = {g[-1] for g in brute.counts[1]}
        rest = (0x110000 - len(seen)) * brute.p(context + "\U0001f600")
        assert math.isclose(sum(brute.p(context + c) for c in seen) + rest, 1, rel_tol=1e-9)


def test_keeps_clean_and_drops_noise(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    df = q.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").cache()
    clean, bad = df.where("quality = 1 and toxic = 0"), df.where("quality = 0")
    assert clean.where("keep").count() > 0.97 * clean.count()
    assert bad.where("not keep").count() > 0.6 * bad.count()


def test_worst_stretch_same_as_loop():
    costs = [np.random.default_rng(k).random(n) for k, n in enumerate((1, q.STRETCH - 1, q.STRETCH, 3 * q.STRETCH, 2))]
    got = q.worst_stretches(np.concatenate(costs), np.repeat(np.arange(len(costs)), [len(c) for c in costs]))
    for c, w in zip(costs, got, strict=True):
        ways = [c[i : i + q.STRETCH].mean() for i in range(len(c) - q.STRETCH + 1)]
        assert math.isclose(w, max(ways), rel_tol=1e-9) if ways else math.isnan(w)


def test_drops_nine_tenths_of_junk_in_each_language(spark):
    d = "/root/testdata/sf0.1"
    df = q.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").cache()
    bad = df.where("quality = 0").groupBy("lang").agg(F.avg(F.expr("int(not keep)")).alias("dropped")).collect()
    assert len(bad) == 4 and all(r.dropped > 0.9 for r in bad), bad
    clean = df.where("quality = 1 and toxic = 0")
    assert clean.where("keep").count() > 0.975 * clean.count()


def test_short_odd_texts_and_bad_stretches(spark):
    """Short trusted texts of high perplexity don't widen the bar of long ones; a bad stretch isn't hidden by good text."""
    good = ["the cat sat on the mat and the dog ran to the man " * 8 + w for w in ("a", "the cat", "dog", "man")] * 100
    docs = [(i, "en", t) for i, t in enumerate(good)] + [(i, "en", "Zq x") for i in range(400, 404)]
    junk = [(1000, "en", good[0] * 40 + "%#q)ZX7~" * 40), (1001, "en", "the cat sat %#q)ZX7~ " * 40)]
    frame = spark.createDataFrame(docs + junk, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    keep = {r.doc_id: r.keep for r in q.classify(frame, labels).collect()}
    assert not keep[1000] and not keep[1001] and sum(keep[i] for i in range(400)) > 390


def test_bars_are_of_all_trusted_rows_above_the_bound(spark):
    r = np.random.default_rng(5)
    words = ["the", "cat", "sat", "mat", "dog", "ran", "man", "12", "zq", "xy!"]
    docs = [(i, "en", " ".join(r.choice(words, 20))) for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    for rows in (40, 80):
        n_over = q.classify(frame, labels, trusted_rows=rows).where("not keep").count()
        # a fiftieth of some 950 rows, less what shares the step of the bar
        assert 15 <= n_over <= 20


def test_model_counts_all_trusted_rows_but_the_held_out(spark, monkeypatch):
    class Stop(Exception):
        pass

    def seen(docs, trusted):
        raise Stop(trusted.count())

    docs = spark.range(24_000).selectExpr("id AS doc_id", "'en' AS lang", "'the cat' AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    want = docs.where(F.expr(f"crc32(string(doc_id)) % {q.HELD_OUT} <> 0")).count()
    monkeypatch.setattr(q, "perplexities", seen)
    for ids in (10**6, 1):
        monkeypatch.setattr(q, "BROADCAST_IDS", ids, raising=False)
        try:
            q.classify(docs, labels)
        except Stop as e:
            assert e.args == (want,)


def test_nulls_blank_repeats_empty(spark):
    docs = spark.createDataFrame([(1, "en", "the cat", 5), (2, None, "the cat", 5), (3, "en", None, 5), (4, "en", " \n", 5), (None, "en", "the cat", 5), (1, "en", "the cat", 5), (9, "xx", "the cat", 5)], "doc_id long, lang string, text string, n int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (9, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = q.classify(docs, labels).collect()
    assert len(rows) == 7
    by = {(r.doc_id, r.lang): r for r in rows}
    assert not by[3, "en"].keep and not by[4, "en"].keep and by[4, "en"].perplexity is None
    assert by[9, "xx"].keep and by[9, "xx"].perplexity is None and by[2, None].keep
    assert q.classify(docs.limit(0), labels).count() == 0
    assert q.classify(docs, labels.limit(0)).where("keep").count() == 5


def test_very_many_different_characters():
    """More characters than 16 bits number: n-grams are those of the plain way."""
    rng = np.random.default_rng(8)
    text = q.normalised("".join(chr(0x10000 + i) for i in rng.permutation(70_000)) + "abcabc")
    codes, own, alphabet = q.gram_codes([text, q.normalised("xy")])
    grams = q.gram_strings(codes, alphabet)
    want = [text[i : i + q.ORDER] for i in range(len(text) - q.ORDER + 1)]
    assert grams[: len(want)] == want and grams[len(want) :] == [q.START * 3 + "x", q.START * 2 + "xy"]
    assert own.tolist() == [0] * len(want) + [1, 1]
