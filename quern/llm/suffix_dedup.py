"""Removal of repeated passages with block-wise sorted suffixes.

1. Each window of `length` bytes is owned by one anchor, its least 32-byte string under
   a fixed hash. Equal windows have equal anchors at equal offsets, so windows need to be
   compared only under the same anchor. Consecutive windows of an anchor form a run, kept
   as a row (anchor hash, hash of the run's bytes, place). Runs are taken as equal by both
   hashes, 128 bits; texts are named by doc_id and a hash.
2. An anchor that occurs once ends there. Runs with equal bytes are repeats as a whole;
   only one run of each kind takes part in what follows.
3. The bytes of differing runs of an anchor meet in one block. A task builds one block
   at a time and sorts its suffixes bucket by bucket: by their first 73 bytes, and ties
   by the ranks of difference-cover samples. For any two suffixes some shift below 73
   brings both onto samples, so a tie of any length costs one comparison of ranks.
   Neighbours in that order that agree in `length` bytes are marked.
4. An anchor with very many differing runs is not brought into one block: its windows
   are dealt by their hash instead, so no group is unbounded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_memo, join_hot, materialize, read_table, shuffle_parts

LENGTH, ANCHOR = 200, 32
#: Window starts that are looked at together in a long text.
PIECE = 1 << 20
#: Bytes of a block, and differing runs of an anchor from which its windows are dealt by hash.
BLOCK_BYTES, WIDE = 2 << 20, 20_000
#: Suffixes of a bucket that are sorted together.
BUCKET = 1 << 18
#: A perfect difference set: every difference modulo PERIOD occurs between two members.
PERIOD, COVER = 73, (0, 1, 3, 7, 15, 31, 36, 54, 63)


@lru_cache(1)
def _tables():
    rng = np.random.default_rng(20240607)
    letters = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    n = PIECE + LENGTH * 4 + ANCHOR
    base = 0x9E3779B97F4A7C15 | 1
    power = np.full(n, base, np.uint64)
    power[0] = 1
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return letters, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def anchor_hashes(x: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of each string of `size` bytes."""
    letters, power, inverse = _tables()
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[x] * power[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * inverse[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(data: bytes, length: int = LENGTH):
    """(start, windows, anchor hash) of the runs of a text, as arrays."""
    starts, sizes, hashes = [], [], []
    low = np.uint64((1 << 21) - 1)
    for at in range(0, len(data) - length + 1, PIECE):
        x = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        h = anchor_hashes(x)
        m, w = len(h), length - ANCHOR + 1
        key = np.full(-(-m // w) * w, ~np.uint64(0), np.uint64)
        key[:m] = (h & ~low) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - length + 1
        pos = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
        s = np.r_[0, np.flatnonzero(pos[1:] != pos[:-1]) + 1]
        starts.append(s + at)
        sizes.append(np.diff(np.r_[s, n]))
        hashes.append(h[pos[s]])
    if not starts:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes).view(np.int64)


def _runs(length: int):
    def runs(frames):
        import xxhash

        hold_memo("suffixes", lambda: None)
        digest = xxhash.xxh3_64_intdigest
        for f in frames:
            out = []
            for key, tk, text in zip(f.key.to_numpy(), f.tk.to_numpy(), f.text, strict=True):
                data = text.encode()
                s, n, h = anchor_runs(data, length)
                if len(s):
                    ends = (s + n + (length - 1)).tolist()
                    th = np.fromiter((digest(data[a:b]) for a, b in zip(s.tolist(), ends, strict=True)), np.uint64, len(s)).view(np.int64)
                    out.append((np.full(len(s), key), np.full(len(s), tk), h, th, s, n))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("key", "tk", "h", "th", "start", "n"))})

    return runs


def _word(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number that sorts as they do."""
    views = np.lib.stride_tricks.sliding_window_view(x, 8)
    return np.ascontiguousarray(views[at]).view(">u8").ravel()


@lru_cache(1)
def _shifts() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in range(PERIOD - 1, -1, -1):
        hit = np.roll(inside, -d)
        out[np.ix_(hit, hit)] = d
    return out


def cover_ranks(x: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first `reach` bytes or more; -1 elsewhere."""
    n = len(x) - 4 * PERIOD - 16
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    keys = [_word(x, at + d) for d in range(0, PERIOD - 8, 8)] + [_word(x, at + PERIOD - 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.full(len(x) + reach + PERIOD, -1, np.int64)
    rank[at[order]] = np.cumsum(new)
    size = PERIOD
    while size < reach:
        pair = rank[at] * (len(at) + 2) + rank[at + size] + 1
        rank[at] = np.unique(pair, return_inverse=True)[1]
        size *= 2
    return rank


def _resolve(group: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order tied suffixes by cover ranks; group: ascending ids of ties. Returns positions in order."""
    shifts = _shifts()
    open_ = np.ones(len(pos), bool)
    while True:
        first = np.r_[True, group[1:] != group[:-1]]
        gid = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        sizes = np.diff(np.r_[at, len(group)])
        live = open_ & (sizes[gid] > 1)
        if not live.any():
            return pos
        pivot = pos[at + sizes // 2][gid]
        d = shifts[pos % PERIOD, pivot % PERIOD]
        cmp = np.where(live, np.sign(rank[pos + d] - rank[pivot + d]) + 1, 1)
        open_ &= cmp != 1
        order = np.lexsort((cmp, gid))
        group, pos, open_ = (gid * 3 + cmp)[order], pos[order], open_[order]


def mark_repeats(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first `counts` windows also start elsewhere in the block."""
    x = np.frombuffer(b"".join(texts) + bytes(8 * PERIOD), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    pos = np.concatenate([np.arange(o, o + c) for o, c in zip(offsets, counts, strict=False)]) if texts else np.empty(0, np.int64)
    marked = np.zeros(len(x), bool)
    rank = cover_ranks(x, length)
    word = _word(x, pos)
    order = np.argsort(word, kind="stable")
    pos, word = pos[order], word[order]
    edges = np.r_[0, np.flatnonzero(word[1:] != word[:-1]) + 1, len(pos)]
    start = 0
    while start < len(pos):  # one bucket at a time
        k = np.searchsorted(edges, start + BUCKET, side="right") - 1
        end = int(edges[k]) if edges[k] > start else int(edges[np.searchsorted(edges, start, side="right")])
        p, group = pos[start:end], np.cumsum(np.r_[True, word[start + 1 : end] != word[start : end - 1]])
        start = end
        for d in [*range(8, PERIOD - 8, 8), PERIOD - 8]:
            tied = np.r_[group[1:] == group[:-1], False]
            tied[1:] |= tied[:-1]
            p, group = p[tied], group[tied]
            if not len(p):
                break
            w = _word(x, p + d)
            o = np.lexsort((w, group))
            p, group, w = p[o], group[o], w[o]
            group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1])])
        tied = np.r_[group[1:] == group[:-1], False]
        tied[1:] |= tied[:-1].copy()
        p, group = p[tied], group[tied]
        if not len(p):
            continue
        p = _resolve(group, p, rank)
        a, b = p[:-1], p[1:]
        for d in [*range(0, length - 8, 8), length - 8]:
            same = _word(x, a + d) == _word(x, b + d)
            a, b = a[same], b[same]
        marked[a] = marked[b] = True
    return [marked[o : o + c] for o, c in zip(offsets, counts, strict=False)]


def _spans(mask: np.ndarray) -> list[list[int]]:
    """(first, end) of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


def _blocks(length: int, block_bytes: int):
    def blocks(frames):
        def done(rows):
            marks = mark_repeats([r[2] for r in rows], [r[3] for r in rows], length)
            found = [(r[0], r[1], _spans(m)) for r, m in zip(rows, marks, strict=True) if m.any()]
            return pd.DataFrame(found, columns=["h", "th", "spans"])

        held, size = [], 0
        for f in frames:
            for h, th, run, n in zip(f.h.tolist(), f.th.tolist(), f.run, f.n.tolist(), strict=True):
                if size >= block_bytes and held[-1][0] != h:
                    yield done(held)
                    held, size = [], 0
                held.append((h, th, bytes(run), n))
                size += len(held[-1][2])
        if held:
            yield done(held)

    return blocks


def _pieces(length: int):
    """All runs that are asked of a text, cut in one pass; repeated rows of a text stand together and count once."""

    def pieces(frames):
        last = None
        for f in frames:
            rows, size = [], 0
            for key, tk, text, *asked in zip(f.key.tolist(), f.tk.tolist(), f.text, f.h, f.th, f.wide, f.start, f.n, strict=True):
                if (key, tk) == last:
                    continue
                last, data = (key, tk), text.encode()
                for h, th, wide, start, n in zip(*(x.tolist() for x in asked), strict=True):
                    rows.append((h, th, wide, n, data[start : start + n + length - 1]))
                    size += len(rows[-1][4])
                    if size > BLOCK_BYTES:
                        yield pd.DataFrame(rows, columns=["h", "th", "wide", "n", "run"])
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["h", "th", "wide", "n", "run"])

    return pieces


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, wide: int = WIDE) -> DataFrame:
    """(key, tk, spans): byte intervals of each text (key, tk, text) that repeated strings cover.

    key and tk together name a text. Intervals of a text may overlap. Texts without
    repeats have no row.
    """
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= length).select("key", "tk", "text")
    runs = materialize(texts.mapInPandas(_runs(length), "key long, tk long, h long, th long, start int, n int"), "all-runs")
    kinds = runs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("th").alias("lo"), F.max("th").alias("hi")).where("c > 1")
    kinds = materialize(kinds.select("h", "c", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    total = kinds.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    shared = materialize(join_hot(runs, kinds, ["h"], "c", total).drop("c"), "runs")

    # one run of each kind of an anchor with several kinds
    ones = shared.where("mixed").groupBy("h", "th").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("key", "tk", "start", "n"), F.struct("key", "tk", "start")).alias("one"))
    ones = materialize(ones, "kinds")
    many = materialize(ones.groupBy("h").agg(F.count(F.lit(1)).alias("k")), "wide-anchors")
    asked = join_hot(ones, many, ["h"], "k", total).select("h", "th", (F.col("k") > wide).alias("wide"), "one.*")
    # a list for each text, no longer than the text
    asked = asked.groupBy("key", "tk").agg(F.collect_list(F.struct("h", "th", "wide", "start", "n")).alias("asked"))
    asked = asked.select(F.col("key").alias("key2"), F.col("tk").alias("tk2"), *[F.col(f"asked.{c}").alias(c) for c in ("h", "th", "wide", "start", "n")])
    held = texts.join(asked.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("tk") == F.col("tk2"))).select("key", "tk", "text", "h", "th", "wide", "start", "n")
    pieces = materialize(held.mapInPandas(_pieces(length), "h long, th long, wide boolean, n int, run binary"), "pieces")
    parts = shuffle_parts(spark)
    sorted_runs = pieces.where("not wide").select("h", "th", "n", "run").repartition(parts, "h").sortWithinPartitions("h", "th")
    found = sorted_runs.mapInPandas(_blocks(length, block_bytes), "h long, th long, spans array<array<int>>")
    windows = pieces.where("wide").select("h", "th", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "run")
    window = F.substring("run", F.col("i") + 1, length)
    windows = windows.select("h", "th", "i", F.sha2(window, 256).alias("w"))
    again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("w").alias("w2"))
    dealt = windows.join(again, F.col("w") == F.col("w2")).groupBy("h", "th").agg(F.collect_list(F.array("i", F.col("i") + 1)).alias("spans"))
    found = found.unionByName(dealt).select(F.col("h").alias("h2"), F.col("th").alias("th2"), "spans")
    whole = F.array(F.array(F.lit(0), F.col("one.n")))
    marks = ones.join(found, (F.col("h") == F.col("h2")) & (F.col("th") == F.col("th2")), "left")
    marks = marks.select("h", "th", "c", F.when(F.col("c") > 1, whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    marks = materialize(marks, "marks")

    mixed = join_hot(shared.where("mixed"), marks, ["h", "th"], "c", total).select("key", "tk", "start", "spans")
    plain = shared.where("not mixed").select("key", "tk", "start", F.array(F.array(F.lit(0), F.col("n"))).alias("spans"))
    moved = F.transform("spans", lambda s: F.array(F.col("start") + s[0], F.col("start") + s[1] + length - 1))
    return mixed.unionByName(plain).select("key", "tk", moved.alias("spans")).groupBy("key", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(data: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the intervals, and the number of maximal intervals."""
    out, end, count = [], 0, 0
    for a, b in sorted(map(tuple, spans)):
        if a > end or not count:
            out.append(data[end:a])
            count += 1
        end = max(end, b)
    out.append(data[end:])
    return b"".join(out), count


def dedup_passages(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed, n_spans.

    with_text gives kept_text instead of kept, without characters that are cut in part.

    Every byte is removed that a string of `length` bytes covers which also starts
    anywhere else in any text. Strings are judged on the input. A null text counts as
    empty; texts shorter than `length` are kept whole; repeated rows remove each other.
    A very long text is looked at in pieces and cut in one pass. Columns of these names
    are replaced, others kept.
    """
    kind = "kept_text string" if with_text else "kept binary"
    name = kind.split()[0]
    data = docs.drop(name, "n_bytes", "n_removed", "n_spans")
    keyed = data.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_tk": F.xxhash64(F.col("doc_id").isNull(), F.col("text"))})
    named = keyed.where("text is not null").select(F.col("_key").alias("key"), F.col("_tk").alias("tk"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(named, length).withColumnRenamed("spans", "_spans")

    @F.pandas_udf(f"{kind}, n_bytes long, n_removed long, n_spans long")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s in zip(texts, found, strict=True):
            raw = (text or "").encode()
            kept, n = _cut(raw, s) if s is not None else (raw, 0)
            rows.append((kept.decode("utf-8", "ignore") if with_text else kept, len(raw), len(raw) - len(kept), n))
        return pd.DataFrame(rows, columns=[name, "n_bytes", "n_removed", "n_spans"])

    spans = spans.withColumnsRenamed({"key": "_key2", "tk": "_tk2"})
    both = keyed.join(spans, (F.col("_key") == F.col("_key2")) & (F.col("_tk") == F.col("_tk2")), "left")
    both = both.withColumn("_cut", cut(F.col("text").cast("string"), "_spans"))
    return both.select(*data.columns, f"_cut.{name}", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
