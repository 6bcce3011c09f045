import re

import numpy as np
import pytest

from quern.llm import jaccard as jc


def word_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [word_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if b and 100 * a >= 80 * b:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    hot = " ".join(rng.choice(words, 30))
    base, out = [list(rng.choice(words, int(rng.integers(3, 90)))) for _ in range(n // 6)], []
    for _ in range(n):
        w = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = str(rng.choice(words))
        t = " ".join(w)
        out.append(t.upper() if rng.random() < 0.1 else t + "  \n" + hot if rng.random() < 0.3 else t)
    return out


def test_shingles_are_those_of_words():
    for t in ["", " ", "a", "A b\tC", " a b c d e", "x  y\nz\x0bq r s t", "é Ä b c d e f", "a b c d e a b c d e a b c d e", "w" * 70000 + " b c d e f", "a\xa0b c d e f g"]:
        assert len(jc.shingles(t)) == len(word_sets(t)), t
    assert (jc.shingles("THE Cat sat on it") == jc.shingles(" the  cat\tsat on\nit ")).all()
    assert jc.set_key(jc.shingles("a b")) != jc.set_key(jc.shingles("ab"))
    assert (jc.shingles("Ä b c d e") != jc.shingles("ä b c d e")).all()


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = [s for s in (jc.shingles(t) for t in near_copies(rng, 150)) if len(s)]
    sizes = np.array([len(s) for s in sets])
    link = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    want, got = jc.Forest(len(sets)), jc.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if link(i, j):
                want.join(i, j)
    for c, own in jc.size_classes(sizes):
        bits = np.stack([jc.shortened(jc.signature(sets[i], 1 << 14), jc.width(c, 2)) for i in own])
        jc.SignatureTree(sizes, bits.view(np.uint64), own).links(got, link, step=64)
    assert got.labels().tolist() == want.labels().tolist()


def test_prefixes_of_links_meet():
    rng = np.random.default_rng(9)
    for n in (1, 2, 4, 5, 9, 40, 333):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone in range(n):
            y = x[gone:]
            if 100 * len(y) >= 80 * len(x):
                for common in (np.empty(0, np.uint64), np.sort(rng.choice(x, n // 2, replace=False))):
                    assert np.intersect1d(jc.prefix(x, common), jc.prefix(y, common)).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (98, 100), (7, 7), (200, 201), (5, 6), (300, 3)]
    got = {r.node: r.root for r in jc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in [*range(1, 41), 300]} | {98: 98, 99: 98, 100: 98, 200: 200, 201: 200}
    assert jc.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("limits", [(20_000, 4_000), (5, 3)])
def test_against_brute_force(spark, limits):
    texts = near_copies(np.random.default_rng(11), 240) + ["", None, " \t", "a", "A", "a b", "x " * 50]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(tuple(r) for r in jc.jaccard_components(df, *limits).collect())
    assert got == brute(rows)


def test_query_on_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jc.op6_jaccard_join(spark, sf_dir).collect()) == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v w"), (9, "q r s t u v w"), (None, "lonely words here now ok"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_components(df).collect()}
    assert got == {(None, 2, 4), (4, 2, 4), (4, 3, 4), (9, 3, 4), (None, 1, None), (5, 0, 5)}
    assert jc.jaccard_components(df.limit(0)).count() == 0


def test_long_words_of_two_letters_stay_apart(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64 whatever its base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    words = [w[:n] for n in (1024, 2048) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    words += [word[k:] + word[:k] for k in (1, 8, 16)] + ["ab" * 1024, "ba" * 1024, "a" * 2047 + "b", "b" + "a" * 2047, "a" * 16, "a" * 8, "aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa"]
    assert len(set(words)) == len(words) == len({int(jc.shingles(w)[0]) for w in words})
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jc.jaccard_components(docs).collect())
    assert jc.shingles("A" + word).tolist() == jc.shingles(" a" + word.upper() + "\n").tolist()
