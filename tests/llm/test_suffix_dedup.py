import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import suffix_dedup as sd


def brute(texts, length):
    """(removed, spans, kept) of each text by counting all strings of the length."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.r_[False, gone[: len(t)], False].astype(int))
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((int(gone.sum()), int((edges == 1).sum()), kept))
    return out


def made(rng, n=40):
    alphabet = b"abcdefgh \n"
    word = lambda k: bytes(rng.choice(list(alphabet), k).astype(np.uint8))
    parts = [word(int(rng.integers(150, 700))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = b"".join(parts[int(rng.integers(6))][int(rng.integers(0, 100)) :] if rng.random() < 0.5 else word(int(rng.integers(0, 400))) for _ in range(int(rng.integers(0, 5))))
        texts.append(t)
    return [*texts, texts[0], b"", b"a" * 900, b"ab" * 300, b"a" * 199, word(200), parts[0]]


def test_cover_has_every_difference():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    assert (sd._shifts() >= 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_marks_in_a_block(seed):
    rng = np.random.default_rng(seed)
    base = bytes(rng.choice(list(b"ab"), 1500).astype(np.uint8))
    texts = []
    for _ in range(60):
        a = int(rng.integers(0, 1100))
        t = bytearray(base[a : a + int(rng.integers(200, 369))])
        if rng.random() < 0.6:
            t[int(rng.integers(len(t)))] ^= 1
        texts.append(bytes(t))
    counts = [len(t) - 199 for t in texts]
    seen = Counter(t[i : i + 200] for t, c in zip(texts, counts, strict=True) for i in range(c))
    got = sd.mark_repeats(texts, counts)
    for t, m in zip(texts, got, strict=True):
        assert m.tolist() == [seen[t[i : i + 200]] > 1 for i in range(len(m))]


def test_runs_cover_all_windows_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 101, 5000).astype(np.uint8)) + b"z" * 1000
    monkeypatch.setattr(sd, "PIECE", 700)
    s, n, _ = sd.anchor_runs(data)
    assert s[0] == 0 and (s[1:] == (s + n)[:-1]).all() and s[-1] + n[-1] == len(data) - 199


@pytest.mark.parametrize("wide", [20_000, 1])
def test_against_brute_force(spark, wide):
    texts = made(np.random.default_rng(7))
    df = spark.createDataFrame([(i, t.decode(), 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    keyed = df.selectExpr("coalesce(doc_id, 0) key", "xxhash64(text) tk", "doc_id", "text")
    spans = {(r.key, r.tk): r.spans for r in sd.repeated_spans(keyed.select("key", "tk", "text"), block_bytes=3000, wide=wide).collect()}
    keys = {r.doc_id: (r.key, r.tk) for r in keyed.collect()}
    for i, (t, want) in enumerate(zip(texts, brute(texts, 200), strict=True)):
        kept, n = sd._cut(t, spans.get(keys[i], []))
        assert (len(t) - len(kept), n, kept) == want, i


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.text or "").encode() for r in docs], 200)
    got = {r.doc_id: r for r in sd.op5_suffix_dedup(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, (gone, spans, kept) in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d.text.encode()), gone, spans, hashlib.sha256(kept).hexdigest())


def test_nulls_repeats_accents_empty(spark):
    long = "é" * 150
    rows = [(1, None), (None, long), (2, ""), (3, "x" + long), (5, "q" * 100), (5, "q" * 100), (6, "w" * 250), (7, "".join(map(chr, range(300, 500)))), (7, "".join(map(chr, range(300, 500))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_passages(df).collect())
    want = sorted((i or -1, len((t or "").encode()), w[0], w[1], w[2]) for (i, t), w in zip(rows, brute([(t or "").encode() for _, t in rows], 200), strict=True))
    assert got == want
    assert sd.dedup_passages(df.limit(0)).count() == 0


def test_hot_anchors_repeated_rows_and_clashing_columns(spark, monkeypatch):
    """Anchors in very many texts take the broadcast way and give the same spans."""
    from quern.llm import common

    rng = random.Random(5)
    shared = bytes(rng.choices(range(97, 123), k=400)).decode()
    texts = [f"{i} " * 40 + shared[: 200 + i % 150] + f" {i}" * 40 for i in range(60)] + [shared] * 5 + ["x" * 150, None, ""]
    rows = [(i if i % 7 else None, t, i, 1, "s") for i, t in enumerate(texts)] + [(3, texts[3], 0, 0, "r"), (3, "other " * 50 + shared, 0, 0, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, tk int, spans string")
    want = sorted(len(t[1] or "") - gone for t, (gone, _, _) in zip(rows, brute([(t[1] or "").encode() for t in rows], 200), strict=True))
    plain = sorted(r.n_bytes - r.n_removed for r in sd.dedup_passages(df).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    hot = sd.dedup_passages(df)
    assert sorted(r.n_bytes - r.n_removed for r in hot.collect()) == plain == want
    assert hot.columns[:5] == df.columns


def test_very_long_text(spark):
    text = " ".join(f"w{i * i % 1_000_003}" for i in range(300_000))
    df = spark.createDataFrame([(1, text + " one"), (2, "two " + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.dedup_passages(df).collect()}
    assert got[1].n_removed == got[2].n_removed == len(text)
    assert got[1].n_spans == got[2].n_spans == 1
