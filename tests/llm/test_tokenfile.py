import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import tokenfile as tf

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


@pytest.mark.parametrize("kind", ["skewed", "even", "constant", "cycle", "jumps"])
def test_blocks_round_trip(kind):
    rng = np.random.default_rng(4)
    n, steps = 9, 900
    x = {
        "skewed": lambda: rng.zipf(1.3, (n, steps)) % 49408,
        "even": lambda: rng.integers(0, 65536, (n, steps)),
        "constant": lambda: np.full((n, steps), 65535),
        "cycle": lambda: np.tile(np.arange(steps) % 7 * 257, (n, 1)),
        "jumps": lambda: np.where(rng.random((n, steps)) < 0.02, rng.integers(0, 65536, (n, steps)), 5),
    }[kind]().astype(np.uint16)
    codes = tf.encode_blocks(x)
    assert (tf.decode_blocks(codes, steps) == x).all()
    if kind in ("constant", "cycle"):
        assert sum(map(len, codes)) < x.nbytes / 8


def test_span_of_a_whole_word_range():
    """A span of 2**48 at a multiple of it must not become 0 when a word is shifted out."""
    low, span = np.array([0x1234FFFF00000000, 0x5 << 48], np.uint64), np.array([1 << 39, 1 << 48], np.uint64)
    for turn in range(8):
        move = tf._to_move(low, span)
        if not len(move):
            break
        low[move] <<= tf.WORD
        span[move] <<= tf.WORD
        assert (span > 0).all()
    assert turn < 7 and (span >= tf.BOTTOM).all()


def test_many_blocks_round_trip():
    """Repeated passages and stretches of one id, as in groups of copies, over very many blocks."""
    rng = np.random.default_rng(9)
    text = rng.zipf(1.2, 400) % 49408
    for trial in range(5):
        n, steps = 20_000, 40
        x = rng.integers(0, 65536, (n, steps)) if trial == 0 else rng.zipf(1.1 + 0.1 * trial, (n, steps)) % 65536
        copies = rng.integers(0, 280, n)
        own = rng.random(n) < 0.5
        x[own] = text[(copies[:, None] + np.arange(steps)) % 400][own]
        x[::7, 15:] = 65535
        x = x.astype(np.uint16)
        assert (tf.decode_blocks(tf.encode_blocks(x), steps) == x).all()


def test_the_mixture_is_a_distribution():
    """Intervals of all ids lie side by side, and places are found in them, also where both guesses agree or are learned."""
    rng = np.random.default_rng(2)
    model = tf.Mixer(3)
    for t in range(200):
        now = np.array([5, rng.integers(0, 65536), 257 * (t % 3)])
        model.predict()
        _, wide = model.interval(now, model.plain(now))
        model.update(now, wide)
        if t in (16, 100):
            model.renew()
    model.predict()
    ids = np.arange(65536)
    for lane in range(3):
        one = tf.Mixer(1)
        one.start = model.start.reshape(3, -1)[lane].copy()
        for name in ("id2", "id1", "w2", "w1", "w0"):
            setattr(one, name, getattr(model, name)[lane : lane + 1])
        one.rows = np.zeros(65536, np.int64)
        place, wide = one.interval(ids, one.plain(ids))
        assert place[0] == 0 and (place[1:] == place[:-1] + wide[:-1]).all() and place[-1] + wide[-1] == tf.ONE**3 and (wide > 0).all()
        one.rows = np.zeros(1, np.int64)
        for i in [0, 5, 65535, int(one.id2[0]), int(one.id1[0]), *rng.integers(0, 65536, 50).tolist()]:
            for v in (place[i], place[i] + wide[i] - 1):
                assert one.find(np.array([v]))[0][0] == i


def test_file_round_trip_and_damage():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, tf.BLOCK + 1000).astype(np.uint16)
    data = tf.pack([3, None, 2**62], [tf.BLOCK, 0, 1000], ids)
    docs, lengths, got = tf.unpack(data)
    assert docs == [3, None, 2**62] and lengths.tolist() == [tf.BLOCK, 0, 1000] and (got == ids).all()
    assert tf.unpack(tf.pack([], [], ids[:0]))[2].size == 0
    for at in range(0, len(data), 4999):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tf.unpack(bytes(bad))


def test_word_encoder_is_the_library(library):
    texts = ["", " ", "The  cat's\tsat!", "don't 'tis 's", "É́ ǅ İSTANBUL ΣΑΣ σας", "a\xa0b c", "123 45a", "<|endoftext|> x <|startoftext|>", "x\x1cy", "é ́e", "日本 語", "A" * 3000, "ﬁ №"]
    for t, raw in zip(texts, tf.load_encoder(NAME).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_query_on_whole_table(spark, sf_dir, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in tf.op8_token_files(spark, sf_dir).collect()}
    start = 0
    for d, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_nulls_ties_small_files_empty(spark, tmp_path):
    rows = [(5, "b"), (5, "a"), (None, "x y"), (1, None), (2, ""), (5, "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    (tmp_path / "t").mkdir()
    man = tf.write_tokens(df, f"file://{tmp_path}/t", file_ids=2)
    got = tf.read_tokens(spark, f"file://{tmp_path}/t", man, with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (1, 3, 1), (2, 4, 1), (5, 5, 2), (5, 7, 2), (5, 9, 2)]
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    (tmp_path / "e").mkdir()
    man = tf.write_tokens(df.limit(0), f"file://{tmp_path}/e")
    assert tf.read_tokens(spark, f"file://{tmp_path}/e", man).count() == 0


def prose(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    words = rng.zipf(1.3, (500, 4)) % 49408
    return words[rng.zipf(1.2, n // 4 + 1) % 500].ravel()[:n].astype(np.uint16)


@pytest.mark.parametrize("kind", ["prose", "even", "constant", "ascending", "ends"])
def test_blocks_that_share_tables_round_trip(kind):
    n = tf.BLOCK * tf.SHARING_BLOCKS + 5
    rng = np.random.default_rng(3)
    ids = {
        "prose": lambda: prose(n, 1),
        "even": lambda: rng.integers(0, 65536, n),
        "constant": lambda: np.full(n, 65535),
        "ascending": lambda: np.arange(n) * 7 % 65536,
        "ends": lambda: np.where(np.arange(n) < n - 1, rng.choice([0, 3, 65535], n), 9),
    }[kind]().astype(np.uint16)
    data = tf.pack([1], [n], ids)
    assert (tf.unpack(data)[2] == ids).all()
    tables = tf.FileTables.of(ids)
    again = tf.FileTables.from_bytes(tables.to_bytes())
    assert all((getattr(tables, k) == getattr(again, k)).all() for k in ("ids", "parts", "after", "place", "slots"))
    for at in range(0, len(data), max(1, len(data) // 20)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tf.unpack(bytes(bad))


def test_tables_name_the_most_frequent_successor():
    tables = tf.FileTables.of(np.array([7, 8, 7, 8, 7, 9, 7, 8, 5], np.uint16))
    after = dict(zip(tables.ids.tolist(), tables.after.tolist(), strict=True))
    assert after[7] >> 2 == 8 and after[9] >> 2 == 7 and after[9] & 3 == 3 and after[5] == 0


def test_a_shared_block_is_read_by_itself():
    ids = prose(tf.BLOCK * 20, 2).reshape(20, tf.BLOCK)
    tables = tf.FileTables.of(ids.ravel())
    codes = tf.encode_blocks(ids, tables)
    assert (tf.decode_blocks(codes[7:8], tf.BLOCK, tables) == ids[7]).all()


def test_cost_of_an_id():
    """Writing and reading 500,000 ids takes less than 2 us of a usual CPU for each."""
    ids, costs = prose(500_000, 5), []
    for _ in range(3):
        start = time.thread_time()
        sum(range(50_000))
        unit = (time.thread_time() - start) * 1000  # 1 on a usual CPU
        start = time.thread_time()
        assert (tf.unpack(tf.pack([1], [len(ids)], ids))[2] == ids).all()
        costs.append((time.thread_time() - start) * 1e6 / len(ids) / unit)
    assert min(costs) < 2


def test_only_odd_words_go_to_the_library(library):
    """New words of ASCII and Latin-1 letters are merged side by side, and equal the library's."""
    rng = random.Random(6)
    letters = "eeeetaoinshrdlucmfwypvbgkjqxzEA" + "".join(map(chr, range(0xC0, 0x100))).replace("×", "").replace("÷", "")
    words = ["".join(rng.choice(letters + "'.,-!%09<") for _ in range(rng.randint(1, 11))) for _ in range(20_000)]
    words += [a + b for a in ("it", "IT", "é", "7", "") for b in ("'s", "'S", "'ll", "'re'd", "''s", "<", "|<", "%%%.")]
    encoder, asked = tf.WordEncoder(public_tokenizers.path(NAME)), []

    class Counting:
        def encode_batch(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch(texts, **options)

    encoder.tokenizer = Counting()
    got = encoder.encode([" ".join(words), "日本 <|x", "z" * 30])
    want = [library.encode(t, add_special_tokens=False).ids for t in (" ".join(words), "日本 <|x", "z" * 30)]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert set(asked) <= {"日本", "<|x", "z" * 30, ""}


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(tf, "MEMO_SIZE", 3)
    monkeypatch.setattr(tf, "TEXT_BYTES", 8)
    encoder = tf.WordEncoder(public_tokenizers.path(NAME))
    texts = ["a b c d e", "f", "", "a b", "g h i j k l", "日", "a"]
    assert encoder.encode([]) == []
    array = pa.array(texts)
    ranges = list(tf._pieces(array))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(texts))) and len(ranges) > 2
    for a, b in ranges:
        ids, sizes = encoder.encode_array(array.slice(a, b - a))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[a:b]]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tf.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
