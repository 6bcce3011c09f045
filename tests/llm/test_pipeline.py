import hashlib
import struct

import public_tokenizers
from test_jaccard import brute as components
from test_suffix_dedup import brute as cut
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quern.llm import langid, mixing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}

    guess = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.where(~langid.held_out()))).collect()}
    first = cp.language_id(spark, docs, sf_dir).cache()
    want = {i: g.lang_pred for i, g in guess.items() if g.lang_pred != "und" and g.score >= cp.MIN_SCORE}
    assert {r.doc_id: r.lang for r in first.collect()} == want and len(want) > 0.95 * len(start)

    second = cp.near_duplicates(spark, first, sf_dir).cache()
    plain = components([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(r.doc_id for r in second.collect()) == sorted(d for d, _, c in plain if d == c)

    third = cp.repeated_passages(spark, second, sf_dir).cache()
    before = second.collect()
    plain = {r.doc_id: (gone, kept.decode("utf-8", "ignore")) for r, (gone, _, kept) in zip(before, cut([(r.text or "").encode() for r in before], 200), strict=True)}
    assert {r.doc_id: r.text for r in third.collect()} == {i: t for i, (gone, t) in plain.items() if not gone or t.strip()}

    fourth = cp.mix_to_targets(spark, third, sf_dir).cache()
    taken = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in mixing.mix_sources(third).collect()}
    copies = {}
    for r in fourth.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in taken.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in fourth.collect()}
    last = cp.encode(spark, fourth, sf_dir).collect()
    assert len(last) == fourth.count()
    for r in last:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for part in (first, second, third, fourth):
        assert part.columns == docs.columns
    assert rows(cp.run(spark, sf_dir)) == sorted((tuple(r) for r in last), key=repr)


def test_odd_rows(spark):
    text = "the cat sat on the mat and the dog ran home"
    df = spark.createDataFrame([(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text + " again", "en", "a", 1), (4, "words " * 3000, "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0
    assert {r.doc_id for r in cp.language_id(spark, df, "").collect()} == {1, None, 4}
    assert sorted((r.doc_id is None, r.doc_id) for r in cp.near_duplicates(spark, df, "").collect()) == [(False, 1), (False, 2), (False, 3), (False, 4)]  # the row without an id links with 1
    assert len(cp.repeated_passages(spark, df, "").collect()) == 5
    assert cp.mix_to_targets(spark, df, "").count() > 0
    assert cp.encode(spark, df, "").count() == 6


def test_repeated_ids_and_clashing_columns(spark):
    """Rows of one id with different texts are judged by their texts, each."""
    a = " ".join(f"alpha{i}" for i in range(60))
    near = a.replace("alpha59", "omega")
    b = " ".join(f"beta{i}" for i in range(60))
    c = " ".join(f"gamma{i}" for i in range(60))
    rows = [(1, a, "s"), (2, near, "s"), (2, b, "s"), (3, c, "s"), (3, c + " more", "t"), (3, c, "r"), (None, near, "s"), (None, "one two three", "s"), (None, "one two three", "t"), (4, None, "s"), (4, None, "s"), (4, "", "s"), (5, "", "s")]
    df = spark.createDataFrame([(d, t, "en", s, 1, 7, 8, 9, 10) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, group int, _n int, taken int, size int")
    kept = cp.near_duplicates(spark, df, "")
    assert list(kept.columns) == list(cp.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    third = min([(3, c), (3, c + " more")], key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    assert got == sorted([(1, a), (2, b), third, (None, "one two three"), (4, None), (4, ""), (5, "")], key=repr)
    mixed = cp.mix_to_targets(spark, df, "")
    want = {}
    for r in mixing.mix_sources(df, carry=("text",)).collect():
        key = (r.doc_id, r.text, r.source)
        want[key] = want.get(key, 0) + (r.taken // r["size"] if r["size"] else 0)
    found = {}
    for r in mixed.collect():
        key = (r.doc_id, r.text, r.source)
        found[key] = found.get(key, 0) + 1
    assert found == {k: n for k, n in want.items() if n} and found
    for _, stage in cp.STAGES:
        assert stage(spark, df, "").count() >= 0


def test_scratch_of_a_lazy_result_stays(spark, sf_dir):
    """A pipeline run deletes its own tables only."""
    lazy = mixing.op7_mix_sources(spark, sf_dir)
    cp.run(spark, sf_dir)
    assert lazy.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(ref() is not None for ref, _ in cp._scratch)


def test_results_of_earlier_stages_can_still_be_read(spark, sf_dir):
    """A result that is held keeps its scratch tables while later stages and whole runs go on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = cp.near_duplicates(spark, docs, sf_dir)
    cp.repeated_passages(spark, docs, sf_dir).count()
    first, second = cp.run(spark, sf_dir), cp.run(spark, sf_dir)
    assert 0 < held.count() <= docs.count()
    assert first.count() == second.count() > 0
    kept = [paths for ref, paths in cp._scratch if ref() is held]
    assert len(kept) == 1 and kept[0]
    del held
    cp._sweep(spark)
    assert not [p for ref, p in cp._scratch if p == kept[0]]


def test_stages_chained_before_anything_is_written(spark, sf_dir):
    """The third result reads the second one's scratch tables when the fourth stage starts, though nobody holds the second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert rows(docs) == rows(cp.run(spark, sf_dir))
    paths = next(paths for ref, paths in cp._scratch if ref() is docs)
    assert len(paths) > 2
    del docs
    cp._sweep(spark)
    assert not [p for _, kept in cp._scratch for p in kept if p in paths]


def test_stages_chained_on_derived_frames(spark):
    """A frame that was derived from a result keeps what it reads, though the result itself is gone."""
    text = "the cat sat on the mat and the dog ran home"
    shared = " ".join(f"alpha{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "a", 9), (2, text + " again", "en", "a", 9), (3, "one " + shared, "en", "b", 1), (4, "two other words and then " * 9 + shared, "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = df
    for _, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, "").where("doc_id > 0")
    got = rows(docs)
    held = [df]
    for _, stage in cp.STAGES[1:4]:
        held.append(stage(spark, held[-1], ""))
    assert got == rows(held[-1]) and got
