import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe

NASTY = [
    "", " ", "  ", "\n\n", "a", " a", "a ", "a  b", "foo\n\nbar", "foo \n bar", "foo\xa0 bar", "foo\xa0  bar", "à  b", "à b\xa0", "x\x1c y\x1fz", "don't we'll I'M",
    "tab\there", "mixed\r\n lines\r\n\r\n end  ", "x" * 3000, "ab" * 2000 + " " * 500 + "é" * 400, "日本語 テキスト　全角 空白", "emoji 👩‍👩‍👧 ok", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "<|endoftext| > x", "123456 7 890", "___ --- !!!  ???", "  lead", "trail \t", " wide  space", "q́ é", "\x00\x01 \x7f", "a\u0085b \u0085 c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.load_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def ids(own, text):
    raw = own.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_same_as_library_on_hard_texts(own, library):
    for x in NASTY:
        want = library.encode(x, add_special_tokens=False).ids
        assert ids(own, x) == want, x
        assert own.decode(own.encode(x)) == library.decode(want, skip_special_tokens=False)


def test_each_character_alone_and_between_words(own, library):
    chars = [chr(c) for c in [*range(0x2100), *range(0x2E80, 0x3100), *range(0xFE00, 0x10000, 7), *range(0x1F300, 0x1F700, 5)]]
    texts = [f"a{c} b {c}c  {c} 1{c}" for c in chars]
    for x, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(own, x) == e.ids, repr(x)


def test_query_matches_library_on_whole_table(spark, sf_dir, library):
    rows = bpe.op3_bpe_codec(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_clashing_columns_empty_table_and_decode(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z")], "doc_id long, text string, ids string")
    rows = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted((r.n_tokens, r.decoded_text) for r in rows) == [(0, ""), (0, ""), (2, "a b"), (2, "a b")]
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_memory_of_fragments_follows_its_bound():
    coder = bpe.ForcedBoundaryBPE(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    text = " ".join(f"{i:x}" for i in range(120_000))
    want = coder.encode(text)
    assert len(coder.memo) <= bpe.MEMO_SIZE
    coder.memo_size = bpe.OWN_MEMO_SIZE
    coder.memo.clear()
    assert coder.encode(text) == want and len(coder.memo) >= 120_000
