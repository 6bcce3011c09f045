import itertools

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid


def segmentations(word, pieces, prob, unknown):
    """(pieces, probability) of each segmentation of a word."""
    n = len(word)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[start:i])
                start = i
        ids = [pieces.get(x, unknown if len(x) == 1 else 0) for x in parts]
        yield ids, float(np.prod([prob[i] for i in ids]))


def small():
    pieces = {x: i + 1 for i, x in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba"])}
    prob = np.random.default_rng(1).random((len(pieces) + 2, 2))
    prob[0] = 0
    return pieces, langid.PieceTable(pieces), prob


def test_forward_sums_all_segmentations():
    pieces, table, prob = small()
    words = ["abab", "baab", "azab", "a", "abbaabababab"]
    got = langid.word_scores(words, table, prob)
    for w, row in zip(words, got, strict=True):
        for lang in range(2):
            assert np.isclose(row[lang], np.log(sum(p for _, p in segmentations("▁" + w, pieces, prob[:, lang], table.unknown))), rtol=1e-5)


def test_long_words_are_scored_and_counted(monkeypatch):
    pieces, table, prob = small()
    words = ["ab" * 2500, "z" * 400, "ba"]
    whole, counts = langid.word_scores(words, table, prob), langid.expected_counts(words, np.ones(3), table, prob[:, 1])
    assert np.isclose(whole[1, 0], np.log(prob[pieces["▁"], 0]) + 400 * np.log(prob[table.unknown, 0]), rtol=1e-5)
    assert np.isclose(counts[table.unknown], 400)
    # each letter stands in just one piece of a segmentation
    sizes = np.array([0, *(len(x) for x in pieces), 1])
    assert np.isclose((counts * sizes).sum(), sum(len(w) + 1 for w in words))
    monkeypatch.setattr(langid, "WIDTH", 7)
    monkeypatch.setattr(langid, "BATCH_LETTERS", 50)
    assert np.allclose(langid.word_scores(words, table, prob), whole, rtol=1e-6)
    assert np.allclose(langid.expected_counts(words, np.ones(3), table, prob[:, 1]), counts)


def test_expected_counts_against_all_segmentations():
    pieces, table, prob = small()
    words, weights = ["abab", "baazb", "a"], np.array([2.0, 1.0, 5.0])
    want = np.zeros(table.unknown + 1)
    for w, n in zip(words, weights, strict=True):
        found = list(segmentations("▁" + w, pieces, prob[:, 0], table.unknown))
        whole = sum(p for _, p in found)
        for ids, p in found:
            np.add.at(want, ids, n * p / whole if whole else 0)
    want[0] = 0
    assert np.allclose(langid.expected_counts(words, weights, table, prob[:, 0]), want)


def test_many_words_in_one_task_long_ones_too(spark):
    """More words than an Arrow batch holds, and long ones, train as they do one by one."""
    rng = np.random.default_rng(3)
    text = {lang: " ".join("".join(rng.choice(list(abc), rng.integers(3, 9))) for _ in range(14_000)) for lang, abc in (("aa", "abcdefgh"), ("bb", "klmnopqr"))}
    long_text = " ".join("".join(rng.choice(list("漢字語文書"), n)) for n in (25, 90, 700, 5000))
    rows = [(1, text["aa"], "aa"), (2, text["bb"], "bb"), (3, long_text, "cc"), (4, None, "cc"), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    langs, prob = langid.train(df)
    assert langs == ["aa", "bb", "cc"]
    table, start = langid.load_table("piece_bpe_32k.model"), np.full(len(prob), 1.0 / len(prob))
    start[0] = 0
    for i, lang in enumerate(langs):
        p = start
        words = [w for _, t, x in rows if x == lang and t for w in t.split()]
        for _ in range(langid.EM_ROUNDS):
            fresh = langid.SMOOTH + langid.expected_counts(words, np.ones(len(words)), table, p)
            fresh[0] = 0
            p = fresh / fresh.sum()
        assert np.allclose(prob[:, i], p)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, (langs, prob)).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("aa", "bb", "cc", "und")


def test_predictions_against_single_words(spark, sf_dir):
    """The whole query on a small table: each text's score is the sum over its words, one at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, prob = langid.train(docs.where(~langid.held_out()))
    table = langid.load_table("piece_bpe_32k.model")
    known: dict = {}

    def score(w):
        if w not in known:
            known[w] = langid.word_scores([w], table, prob)[0].astype(float)
        return known[w]

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.op9_language_id(spark, sf_dir).collect():
        words = langid.WORDS.findall((texts[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        z = sum(map(score, words)) / np.sqrt(len(words))
        z = np.exp(z - z.max())
        assert r.lang_pred == langs[int(z.argmax())] and np.isclose(r.score, z.max() / z.sum(), rtol=1e-3)


def test_stray_and_repeated_labels(spark):
    df = spark.createDataFrame([(i, "the cat sat", "en") for i in range(4)] + [(10 + i, "x", f"stray{i}") for i in range(30)] + [(1, "the cat sat", "en")] * 2, "doc_id long, text string, lang string")
    langs, prob = langid.train(df, most_langs=3)
    assert langs == ["en", "stray0", "stray1"] and prob.shape[1] == 3
    assert langid.predict(df, (langs, prob)).count() == 36


def test_held_out_accuracy_and_determinism(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").cache()
    n, right = df.count(), df.where("lang = lang_pred").count()
    assert n > 200 and right / n > 0.97
    assert df.where("score < 0 or score > 1 or score is null").count() == 0


def test_nulls_no_letters_empty_training(spark):
    df = spark.createDataFrame([(1, None, "en", 0), (2, "", "en", 0), (3, "12 !?", None, 0), (4, "the cat", "en", 0), (None, "x" * 5000, "de", 0), (5, "le chat", "fr", 0), (6, "² ½", "fr", 0), (7, "漢" * 24 + " " + "語" * 90, None, 0)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.predict(df, langid.train(df.limit(0)))
    assert none.where(F.col("lang_pred") == "und").count() == 8
    assert langid.predict(df.limit(0), langid.train(df)).count() == 0
