"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token is a forced boundary: no token,
and so no merge, can reach over it. The text is first cut where a forced boundary lies
between a visible character and white space, which the word pattern also never crosses;
a fragment is cut by the word pattern and again at its forced boundaries, and what is
left is merged by itself. Results are joined in order. Fragments recur, so each worker
remembers the ids of those it has met, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hold_memo, read_table

#: The longest fragment, in characters, and the number of fragments that a worker remembers: beside other operators, and by itself.
MEMO_CHARS, MEMO_SIZE, OWN_MEMO_SIZE = 48, 100_000, 1_000_000
SPACE = " \t\n\r\x0b\x0c"
#: White space outside ASCII, as the word pattern takes it.
ODD_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _byte_chars() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(chars[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        inside = {p for t in vocab for p in zip(t, t[1:])}
        self.free = [frozenset(b for b in range(256) if (a, b) not in inside) for a in range(256)]
        spaces = set(SPACE.encode())
        #: Last bytes of visible characters after which some white space is not forced.
        bound = sorted({a for a, b in inside if b in spaces and a not in spaces})
        if any(a < 128 for a in bound):
            raise ValueError("the vocabulary joins visible ASCII characters and white space")
        self.bound = frozenset(bound)
        self.words = regex.compile(pattern)
        self.fragments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.odd = re.compile(f"[{ODD_SPACE}]")
        self.splits = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self.memo_size = MEMO_SIZE

    def _cuts(self, text: str) -> list[str]:
        """Fragments of a text; their encodings in order are the text's."""
        parts = self.fragments.findall(text)
        if text.isascii():
            return parts
        if not self.odd.search(text) and not any(x.encode()[-1] in self.bound for x in parts):
            return parts
        out, held = [], ""
        for x in parts:
            held += x
            if not self.odd.match(x[-1]) and x.encode()[-1] not in self.bound:
                out.append(held)
                held = ""
        return [*out, held] if held else out

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        merge = self.merge
        if len(ids) <= 24:
            while len(ids) > 1:
                best, at = (1 << 30, 0), -1
                for i, pair in enumerate(zip(ids, ids[1:])):
                    got = merge.get(pair)
                    if got is not None and got[0] < best[0]:
                        best, at = got, i
                if at < 0:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(got[0], i, got[1], ids[i], ids[i + 1]) for i in range(n - 1) if (got := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k, m in ((left[i], i), (i, right[i])):
                if k >= 0 and m >= 0 and (got := merge.get((ids[k], ids[m]))):
                    heapq.heappush(heap, (got[0], k, got[1], ids[k], ids[m]))
        return [x for x in ids if x >= 0]

    def _fragment(self, text: str) -> bytes:
        out: list[int] = []
        for m in self.words.finditer(text):
            word = m[0].encode()
            start = 0
            for i in range(1, len(word)):
                if word[i] in self.free[word[i - 1]]:
                    out += self._merged([self.first[b] for b in word[start:i]])
                    start = i
            out += self._merged([self.first[b] for b in word[start:]])
        return b"".join(i.to_bytes(4, "little") for i in out)

    def _plain(self, text: str) -> bytes:
        memo, parts = self.memo, self._cuts(text)
        try:
            return b"".join([memo[x] for x in parts])
        except KeyError:
            pass
        out = []
        for x in parts:
            ids = memo.get(x)
            if ids is None:
                ids = self._fragment(x)
                if len(x) <= MEMO_CHARS:
                    if len(memo) >= self.memo_size:
                        memo.clear()
                    memo[x] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.splits is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.splits.split(text) if x)

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(4)
def load_bpe(path: str, pattern: str) -> ForcedBoundaryBPE:
    out = ForcedBoundaryBPE(path, pattern)
    give_back()
    return out


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", pattern: str | None = None, with_ids: bool = True, memo_size: int = MEMO_SIZE) -> DataFrame:
    """docs with n_tokens, ids (binary, little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

    A null text is an empty one and has no ids. Strings of special tokens in a text
    become those tokens. Rows stay in their partitions; other columns are kept, but
    columns of the names above are replaced. with_ids=False leaves the ids out. memo_size:
    the number of fragments that a worker remembers.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kept = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    def coded(texts: pd.Series) -> pd.DataFrame:
        import public_tokenizers

        hold_memo("bpe", load_bpe.cache_clear)  # what other stages hold goes before the vocabulary is read
        bpe = load_bpe(public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)
        bpe.memo_size = memo_size
        rows = []
        for x in texts:
            ids = bpe.encode(x or "")
            rows.append([len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest(), ids][: len(new)])
        return pd.DataFrame(rows, columns=new)

    return kept.withColumn("_coded", coded(F.col("text").cast("string"))).select(*kept.columns, *[F.col(f"_coded.{c}").alias(c) for c in new])


def decode_documents(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """docs with decoded_text from the column ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        import public_tokenizers

        bpe = load_bpe(public_tokenizers.path(name), public_tokenizers.PATTERN)
        return ids.map(lambda x: bpe.decode(bytes(x)) if x is not None else "")

    return docs.withColumn("decoded_text", decoded("ids"))


def op3_bpe_codec(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, with_ids=False, memo_size=OWN_MEMO_SIZE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
