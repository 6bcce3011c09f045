"""Token ids in compressed binary files: adaptive context mixing and range coding.

A file holds the ids of consecutive documents, an index of the documents, and blocks of
BLOCK ids. Each block starts anew from what the head of the file says, is coded by itself,
and has checksums of its code and of its ids.

Three models predict an id: the id that last followed the same two ids in the block (order
2), the one that most often follows the same id (order 1), and how often ids come (order 0).
A file of SHARING_BLOCKS or more has the last two in its head, counted over all of it; the
blocks of a smaller one learn them as they go (then order 1 is the id that followed last,
and order 0 the high byte, and the low byte given the class of the high one). The
distribution that drives the coder is their mixture: the order-0 distribution at its
weight, with the weights of the other two added at the ids that they name. Each block
learns the weights, for each state of confidence of the two and whether they agree, from
the share that each model had in the probability of what came. A 64-bit range coder codes
an id in one step. Blocks are independent, so a task codes all blocks of a file side by
side, one step of each at a time; short blocks let many share the cost of a step.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold_memo, make_folder, read_table, scratch_path

MAGIC = b"QTOK0003"
BLOCK = 1024
#: Ids of a file, about. A task begins a new file after the document that reaches it.
FILE_IDS = 6 << 20
END_ID = 2
#: Words, and bytes of words, that a worker remembers at most, beside those of the texts at hand.
MEMO_SIZE, MEMO_BYTES = 1_000_000, 64 << 20
#: Frequencies and weights are parts of ONE; weights are learned in parts of FINE.
ONE, BITS = 4096, 12
FINE, RATE = 1 << 16, 5
#: Blocks from which on a file has tables for all of them.
SHARING_BLOCKS = 16
#: Bytes of texts that are cut into words at once; a longer text is taken by itself.
TEXT_BYTES = 8 << 20
#: Slots for contexts, and classes of high bytes: each of the first by itself, one for the rest.
TABLE, CLASSES = 1024, 8
STATES = 32
#: Bits of the parts that the frequencies of a file are rounded to.
PARTS = 18
#: Shares from which on the id that follows most often has a confidence of 1, 2 and 3.
SURE = (0.1, 0.4, 0.8)
#: How the vocabulary cuts texts; WordEncoder follows it.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What an id adds to the slot of a context as its last one and, in order 2, as the one before.
HASH1, HASH2 = (np.arange(1 << 16, dtype=np.int64) * k >> 15 & TABLE - 1 for k in (0x9E3779B1, 0x85EBCA6B))
TOP, BOTTOM, WORD = np.uint64(48), np.uint64(1 << 40), np.uint64(16)


def renewed_at(t: int) -> bool:
    """Are the order-0 frequencies of a block taken anew at this step?"""
    return t >= 16 and (t % 512 == 0 or (t < 512 and t & (t - 1) == 0))


class Mixer:
    """Models of many blocks side by side; order 0 is learned in each block."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64)
        self.states_of = np.stack([self.base, lanes + self.base]) * STATES  # order 2, then order 1
        self.fine = np.full(2 * lanes * STATES, FINE // 8, np.int64)
        self.ctx, self.found = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int32)
        self.p1 = np.zeros(lanes, np.int64)
        self.hash2 = np.zeros(lanes, np.int64)
        self.slots_of = self.base * TABLE
        self.seen2 = np.zeros(lanes * TABLE, np.int32)  # id * 4 + confidence
        self.start_tables(lanes)

    def start_tables(self, lanes: int) -> None:
        self.seen1 = np.zeros(lanes * TABLE, np.int32)
        # one table for high bytes, then one of low bytes for each class
        self.counts = np.ones((lanes, 1 + CLASSES, 256), np.int32)
        self.rows = self.base * (1 + CLASSES)
        self.renew()

    def renew(self) -> None:
        c = self.counts
        f = 1 + c * (ONE - 256) // c.sum(axis=2, keepdims=True)
        f[:, :, 0] += ONE - f.sum(axis=2)
        start = np.zeros((*f.shape[:2], 257), np.int64)
        np.cumsum(f, axis=2, out=start[:, :, 1:])
        self.start, self.slots = start.reshape(-1), None

    def slot_table(self) -> np.ndarray:
        """The symbol of each of the ONE slots of each table, for decoding."""
        if self.slots is None:
            start = self.start.reshape(-1, 257)
            mark = np.zeros((len(start), ONE + 1), np.uint8)
            mark[np.arange(len(start))[:, None], start[:, 1:256]] = 1
            self.slots = np.cumsum(mark[:, :ONE], axis=1, dtype=np.uint8).reshape(-1)
        return self.slots

    def predict(self) -> None:
        """The two ids, their confidence, and the weights of the three models."""
        h = HASH1.take(self.p1, mode="clip")
        self.f2 = (h ^ self.hash2) + self.slots_of
        s, ctx = self.found, self.ctx
        self.seen2.take(self.f2, out=s[0], mode="clip")
        self.recall1(h, s[1])
        self.ids = s >> 2
        self.id2, self.id1 = self.ids
        self.sure = s & 3
        np.add(self.states_of, (self.sure[0] << 3) + (self.sure[1] << 1) + (self.id2 == self.id1), out=ctx)
        self.q = self.fine.take(ctx, mode="clip")
        # never 0, so that a model can come back; together below ONE
        self.w = (self.q >> 4) + 4
        self.w2, self.w1 = self.w
        self.w0 = ONE - self.w2 - self.w1

    def recall1(self, h: np.ndarray, out: np.ndarray) -> None:
        self.f1 = h + self.slots_of
        self.seen1.take(self.f1, out=out, mode="clip")

    def plain(self, ids: np.ndarray, lanes=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Place and width of ids in the order-0 distribution, in parts of ONE * ONE."""
        high, rows = ids >> 8, self.rows[lanes]
        at = rows * 257 + high
        place = self.start[at]
        wide = self.start[at + 1] - place
        at = (rows + 1 + np.minimum(high, CLASSES - 1)) * 257 + (ids & 255)
        low = self.start[at]
        return (place << BITS) + wide * low, wide * (self.start[at + 1] - low)

    def at_place(self, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ids of the lanes k at the places u of their order-0 distribution."""
        slots, rows = self.slot_table(), self.rows[k]
        high = slots[rows * ONE + (u >> BITS)].astype(np.int64)
        at = rows * 257 + high
        first = self.start[at]
        low = (u - (first << BITS)) // (self.start[at + 1] - first)
        return high * 256 + slots[(rows + 1 + np.minimum(high, CLASSES - 1)) * ONE + low]

    def interval(self, ids: np.ndarray, plain: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Place and width of ids in the mixture, in parts of ONE ** 3, from those in the order-0 distribution."""
        place, wide = plain
        place = self.w0 * place + (((self.id2 < ids) * self.w2 + (self.id1 < ids) * self.w1) << 2 * BITS)
        return place, self.w0 * wide + (((self.id2 == ids) * self.w2 + (self.id1 == ids) * self.w1) << 2 * BITS)

    def find(self, v: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The ids in whose interval the places v lie, and their place and width in the order-0 distribution."""
        n = len(v)
        place, wide = self.plain(np.concatenate([self.id2, self.id1]), np.concatenate([self.base, self.base]))
        w2, w1 = self.w2 << 2 * BITS, self.w1 << 2 * BITS
        same = self.id2 == self.id1
        from2 = self.w0 * place[:n] + (self.id1 < self.id2) * w1
        from1 = self.w0 * place[n:] + (self.id2 < self.id1) * w2
        over2 = v >= from2 + self.w0 * wide[:n] + w2 + same * w1
        over1 = v >= from1 + self.w0 * wide[n:] + w1 + same * w2
        in2 = (v >= from2) > over2
        out, place, wide = np.where(in2, self.id2, self.id1), np.where(in2, place[:n], place[n:]), np.where(in2, wide[:n], wide[n:])
        k = np.flatnonzero(((v >= from1) <= over1) > in2)
        if len(k):
            # below 2**53, and w0 is short: the quotient of floats is cut like that of integers
            u = ((v - over2 * w2 - over1 * w1).take(k) / self.w0.take(k)).astype(np.int64)
            out[k] = ids = self.at_place(u, k)
            place[k], wide[k] = self.plain(ids, k)
        return out, (place, wide)

    def update(self, ids: np.ndarray, wide: np.ndarray) -> None:
        """Learn from the ids that came, whose width in the mixture was wide."""
        hit = self.ids == ids
        # the share of a weight of 1 in what came, in parts of almost FINE: order 0 keeps the rest
        share = (((FINE - FINE // 128) << 2 * BITS) / wide).astype(np.int64)
        self.fine[self.ctx] = self.q + (hit * self.w * share - self.q >> RATE)
        now = ids.astype(np.int32) << 2
        self.seen2[self.f2] = np.where(hit[0], self.found[0] + (self.sure[0] < 3), now)
        self.hash2, self.p1 = HASH2.take(self.p1, mode="clip"), ids
        self.learn_tables(ids, hit, now)

    def learn_tables(self, ids: np.ndarray, hit: np.ndarray, now: np.ndarray) -> None:
        self.seen1[self.f1] = np.where(hit[1], self.found[1] + (self.sure[1] < 3), now)
        high = ids >> 8
        flat = self.counts.reshape(-1)
        flat[self.rows * 256 + high] += 24
        flat[(self.rows + 1 + np.minimum(high, CLASSES - 1)) * 256 + (ids & 255)] += 24


class FileTables:
    """What the blocks of a file have in common: how often each id comes, in parts of 1 << PARTS,
    and which id follows it most often, with a confidence of 0 to 3."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, after: np.ndarray):
        """ids: all that come, ascending; parts: theirs, which add up; after: id * 4 + confidence."""
        if int(parts.sum()) != 1 << PARTS or int(after.max()) >> 18:
            raise ValueError("the tables of the file are damaged")
        self.ids, self.parts, self.after = ids, parts, after
        self.wide = np.zeros(1 << 16, np.int64)
        self.wide[ids] = parts << 2 * BITS - PARTS
        self.place = np.cumsum(self.wide) - self.wide
        self.slots = np.repeat(ids.astype(np.uint16), parts)
        self.seen1 = np.zeros(1 << 16, np.int32)
        self.seen1[ids] = after

    @classmethod
    def of(cls, ids: np.ndarray) -> FileTables:
        """The tables of ids, of which there is at least one."""
        counts = np.bincount(ids)
        own = np.flatnonzero(counts)
        parts = 1 + counts[own] * ((1 << PARTS) - len(own)) // len(ids)
        parts[parts.argmax()] += (1 << PARTS) - parts.sum()
        pairs = ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:]
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] ^ np.uint32(1)))
        pairs, times = pairs[first], np.diff(first, append=len(pairs))
        before = pairs >> np.uint32(16)
        # of equally frequent ones the largest id
        best = np.zeros(1 << 16, np.int64)
        if len(pairs):
            group = np.flatnonzero(np.diff(before, prepend=before[:1] ^ np.uint32(1)))
            best[before[group]] = np.maximum.reduceat(times << 16 | pairs & np.uint32(0xFFFF), group)
        best = best[own]
        sure = np.searchsorted(SURE, (best >> 16) / counts[own], "right")
        return cls(own, parts, (best & 0xFFFF) << 2 | sure)

    def to_bytes(self) -> bytes:
        marks = np.zeros(1 << 16, np.uint8)
        marks[self.ids] = 1
        columns = np.stack([self.parts, self.after]).astype("<u4").view(np.uint8).reshape(-1, 4)
        return zlib.compress(np.packbits(marks).tobytes() + columns.T.tobytes(), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> FileTables:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        columns = np.ascontiguousarray(raw[8192:].reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
        return cls(np.flatnonzero(np.unpackbits(raw[:8192])), *columns)


class FileMixer(Mixer):
    """Models of many blocks side by side; order 0, and what order 1 expects, are of the file that they are in."""

    def __init__(self, lanes: int, tables: FileTables):
        self.tables = tables
        super().__init__(lanes)

    def start_tables(self, lanes: int) -> None:
        pass

    def renew(self) -> None:
        pass

    def recall1(self, h: np.ndarray, out: np.ndarray) -> None:
        self.tables.seen1.take(self.p1, out=out, mode="clip")

    def learn_tables(self, ids: np.ndarray, hit: np.ndarray, now: np.ndarray) -> None:
        pass

    def plain(self, ids: np.ndarray, lanes=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        return self.tables.place.take(ids, mode="clip"), self.tables.wide.take(ids, mode="clip")

    def at_place(self, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.tables.slots.take(u >> 2 * BITS - PARTS, mode="clip").astype(np.int64)


def _narrow(low, span, start, freq):
    r = span >> np.uint64(3 * BITS)
    low += r * start.view(np.uint64)
    np.multiply(r, freq.view(np.uint64), out=span)


def _to_move(low, span):
    """Lanes that must shift out a word, as their span is short; where it crosses a word's border it is cut."""
    move = np.flatnonzero(span < BOTTOM)
    if len(move):
        first, wide = low[move], span[move]
        cut = (first ^ (first + wide - np.uint64(1))) >> TOP != 0
        span[move] = np.where(cut, (~first + np.uint64(1)) & (BOTTOM - np.uint64(1)), wide)
    return move


def encode_blocks(ids: np.ndarray, tables: FileTables | None = None) -> list[bytes]:
    """Codes of the rows of ids (blocks, steps), all below 65536.

    Memory is about 10 kB a block, 50 kB without tables, beside the ids and the codes.
    """
    n, steps = ids.shape
    model = FileMixer(n, tables) if tables else Mixer(n)
    low, span = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0), np.uint64)
    out, at = np.zeros((n, steps + 1024), np.uint16), np.zeros(n, np.int64)
    columns = np.ascontiguousarray(ids.T)
    for t in range(steps):
        if renewed_at(t):
            model.renew()
        if t % 64 == 0 and at.max(initial=0) + 64 * 8 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], axis=1)
        now = columns[t].astype(np.int64)
        model.predict()
        place, wide = model.interval(now, model.plain(now))
        _narrow(low, span, place, wide)
        while len(move := _to_move(low, span)):
            first, to = low[move], at[move]
            out[move, to] = first >> TOP
            at[move] = to + 1
            low[move] = first << WORD
            span[move] = rest = span[move] << WORD
            if rest.min() >= BOTTOM:
                break
        model.update(now, wide)
    lanes = np.arange(n)
    for shift in (48, 32, 16, 0):
        out[lanes, at] = (low >> np.uint64(shift)).astype(np.uint16)
        at += 1
    return [out[i, : at[i]].astype("<u2").tobytes() for i in range(n)]


def decode_blocks(codes: list[bytes], steps: int = BLOCK, tables: FileTables | None = None) -> np.ndarray:
    """The ids (blocks, steps) of codes. Memory is about 10 kB a block, 90 kB without tables, beside both."""
    n = len(codes)
    model = FileMixer(n, tables) if tables else Mixer(n)
    words = np.zeros((n, max(map(len, codes)) // 2 + 8), np.uint16)
    for i, c in enumerate(codes):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    low, span, at = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0), np.uint64), np.full(n, 4, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(4):
        code = (code << WORD) | words[:, k].astype(np.uint64)
    out, most = np.zeros((steps, n), np.uint16), np.uint64((1 << 3 * BITS) - 1)
    for t in range(steps):
        if renewed_at(t):
            model.renew()
        model.predict()
        v = np.minimum((code - low) // (span >> np.uint64(3 * BITS)), most)
        now, plain = model.find(v.view(np.int64))
        place, wide = model.interval(now, plain)
        _narrow(low, span, place, wide)
        while len(move := _to_move(low, span)):
            to = at[move]
            code[move] = (code[move] << WORD) | words[move, np.minimum(to, words.shape[1] - 1)]
            at[move] = to + 1
            low[move] <<= WORD
            span[move] = rest = span[move] << WORD
            if rest.min() >= BOTTOM:
                break
        out[t] = now
        model.update(now, wide)
    return out.T


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file. Layout, little-endian: magic; documents, ids, blocks, bytes of the
    tables, 0 if blocks learn by themselves (uint64 each); doc ids (int64), null flags (uint8),
    lengths (uint32); for each block the code's length, the crc32 of the code and of the ids
    (uint32 each); tables; crc32 of all of that; the codes."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65535 don't fit this format")
    blocks = -(-len(ids) // BLOCK)
    tables = FileTables.of(ids.astype(np.uint16, copy=False)) if blocks >= SHARING_BLOCKS else None
    rows = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(blocks, BLOCK)
    codes = encode_blocks(rows, tables) if blocks else []
    raw = tables.to_bytes() if tables else b""
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), blocks, len(raw))
    head += np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(lengths, "<u4").tobytes()
    head += b"".join(struct.pack("<III", len(c), zlib.crc32(c), zlib.crc32(r.astype("<u2").tobytes())) for c, r in zip(codes, rows, strict=True)) + raw
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(codes)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids); raises ValueError if a checksum differs."""
    if data[:8] != MAGIC or len(data) < 44:
        raise ValueError("not a token file")
    docs, n, blocks, shared = struct.unpack_from("<QQQQ", data, 8)
    at = 40 + docs * 13 + blocks * 12 + shared
    if len(data) < at + 4 or struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("the head is damaged")
    own = np.frombuffer(data, "<i8", docs, 40)
    null = np.frombuffer(data, np.uint8, docs, 40 + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, 40 + 9 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u4", blocks * 3, 40 + 13 * docs).reshape(blocks, 3)
    tables = FileTables.from_bytes(data[at - shared : at]) if shared else None
    at += 4
    codes = []
    for i, (size, crc, _) in enumerate(index.tolist()):
        codes.append(data[at : at + size])
        at += size
        if zlib.crc32(codes[-1]) != crc:
            raise ValueError(f"the code of block {i} is damaged")
    rows = np.ascontiguousarray(decode_blocks(codes, BLOCK, tables), "<u2") if blocks else np.zeros((0, BLOCK), "<u2")
    for i, r in enumerate(rows):
        if zlib.crc32(r) != index[i, 2]:
            raise ValueError(f"the ids of block {i} differ")
    return [None if z else int(d) for d, z in zip(own.tolist(), null.tolist(), strict=True)], lengths, rows.ravel()[:n]


class Merges:
    """Byte-pair encoding of many short strings side by side, one merge of each at a time."""

    WIDTH, NONE = 24, 1 << 30

    def __init__(self, vocab: dict[str, int], merges: list):
        own = [n for n in range(256) if chr(n).isprintable() and n > 32 and n != 0xAD]
        letters = {n: chr(n) for n in own} | {n: chr(256 + k) for k, n in enumerate(n for n in range(256) if n not in own)}
        self.inner, self.last = (np.array([vocab[letters[n] + e] for n in range(256)], np.int32) for e in ("", "</w>"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        ranks, self.levels = np.arange(len(keys), dtype=np.int32), []
        # a pair whose slot is taken goes to the next table
        for bits in [18, 14, 12] + [10] * 20:
            if not len(keys):
                break
            factor, shift = np.uint32(0x9E3779B1 + 2 * 0x3C6EF372 * len(self.levels) & 0xFFFFFFFF), np.uint32(32 - bits)
            slot = (keys * factor) >> shift
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            table, rank = np.zeros(1 << bits, np.uint32), np.full(1 << bits, self.NONE, np.int32)
            table[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((factor, shift, table, rank))
            keys, ranks = keys[~first], ranks[~first]
        if len(keys):
            raise ValueError("merges do not fit their tables")

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where there is no merge, or one of them is -1."""
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32) & np.uint32(0xFFFF)
        out = np.full(keys.shape, self.NONE, np.int32)
        for factor, shift, table, rank in self.levels:
            at = (keys * factor) >> shift
            np.copyto(out, rank.take(at), where=table.take(at) == keys)
        out[(a < 0) | (b < 0)] = self.NONE
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings of 1 to WIDTH bytes, and how many are of each."""
        ids, counts = [], []
        for at in range(0, len(sizes), 4096):
            some = self._encode(data, starts[at : at + 4096], sizes[at : at + 4096])
            ids.append(some[some >= 0])
            counts.append((some >= 0).sum(axis=1))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _encode(self, data, starts, sizes):
        n, columns = len(sizes), np.arange(self.WIDTH)
        inside = columns < sizes[:, None]
        raw = data.take(starts[:, None] + columns, mode="clip")
        now = np.where(inside, self.inner[raw], -1)
        lanes = np.arange(n)
        now[lanes, sizes - 1] = self.last[raw[lanes, sizes - 1]]
        out = np.full((n, self.WIDTH), -1, np.int32)
        ranks = np.full((n, self.WIDTH), self.NONE, np.int32)
        ranks[:, :-1] = self.rank(now[:, :-1], now[:, 1:])
        while True:
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(j)), j]
            more = best < self.NONE
            if not more.all():
                done = ~more
                out[lanes[done], : now.shape[1]] = now[done]
                now, ranks, lanes, j, best = now[more], ranks[more], lanes[more], j[more], best[more]
            k = len(lanes)
            if not k:
                return out
            rows = np.arange(k)
            after = columns[: now.shape[1] - 1] > j[:, None]
            now = np.concatenate([np.where(after, now[:, 1:], now[:, :-1]), np.full((k, 1), -1, np.int32)], axis=1)
            ranks = np.concatenate([np.where(after, ranks[:, 1:], ranks[:, :-1]), np.full((k, 1), self.NONE, np.int32)], axis=1)
            made = now[rows, j] = self.made[best]
            ranks[rows, j] = self.rank(made, now[rows, j + 1])
            left = np.flatnonzero(j)
            ranks[left, j[left] - 1] = self.rank(now[left, j[left] - 1], made[left])


class Known:
    """Ids of strings that came before: those of string i are ids[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, learn):
        """learn gives ids, starts and sizes of new strings."""
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.strings = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint16)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def find(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, one after the other, and where each string's end, after a 0."""
        if len(self.strings) > MEMO_SIZE or self.strings.nbytes > MEMO_BYTES:
            self.forget()
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(at.is_null()).dictionary_encode()
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[at < 0] = new.indices.to_numpy() + len(self.strings)
            ids, starts, sizes = self.learn(new.dictionary)
            self.strings = pa.concat_arrays([self.strings, new.dictionary])
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ASCII white space parts, and where each text's parts end, after a 0."""
    cut = pc.ascii_split_whitespace(texts)
    offsets = cut.offsets.to_numpy()
    return cut.flatten(), offsets - offsets[0]


class WordEncoder:
    """Ids of whole texts, from remembered words.

    The vocabulary drops white space and never joins what ASCII white space parts, so a
    text's ids are those of its words. Words of printable ASCII and Latin-1 letters, which
    are their own normal form, are cut further where the vocabulary's own pattern cuts
    them, and the merges of new pieces are made for many of them side by side. Other words
    and long pieces go to the tokenizer.
    """

    SIMPLE = r"^[!-~À-ÖØ-öø-ÿ]*$"
    #: The vocabulary's pattern, on such words in lower case.
    PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65535 don't fit the token files")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            built = json.load(f)
        model = built["model"]
        if model.get("end_of_word_suffix") != "</w>" or json.dumps(CUT) not in json.dumps(built["pre_tokenizer"]):
            raise ValueError("the vocabulary does not cut texts in the way that is built here")
        self.merges = Merges(model["vocab"], model["merges"])
        self.words, self.parts = Known(self._learn_words), Known(self._learn_parts)

    def forget(self) -> None:
        self.words.forget()
        self.parts.forget()

    def _tokenize(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings by the library, and how many are of each."""
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [np.array(e.ids, np.uint16) for at in range(0, len(strings), 20_000) for e in batch(strings[at : at + 20_000].to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint16), *ids]), np.array([len(x) for x in ids], np.int64)

    def _learn_words(self, words: pa.Array):
        simple = pc.and_not(pc.match_substring_regex(words, self.SIMPLE), pc.match_substring(words, "<|"))
        cut, ends = _split(pc.replace_substring_regex(pc.utf8_lower(words.filter(simple)), self.PIECES, r"\1 "))
        ids, at = self.parts.find(cut)
        other_ids, other = self._tokenize(words.filter(pc.invert(simple)))
        return _together(simple.to_numpy(zero_copy_only=False), ids, np.diff(at[ends]), other_ids, other)

    def _learn_parts(self, parts: pa.Array):
        sizes = pc.binary_length(parts).to_numpy().astype(np.int64)
        short = (sizes > 0) & (sizes <= Merges.WIDTH)
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts)]
        data = np.frombuffer(parts.buffers()[2] or b"\0", np.uint8)
        ids, counts = self.merges.encode(data, offsets[short], sizes[short])
        return _together(short, ids, counts, *self._tokenize(parts.filter(pa.array(~short))))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many are of each."""
        words, ends = _split(texts)
        ids, at = self.words.find(words)
        return ids, np.diff(at[ends])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def _together(chosen: np.ndarray, ids, sizes, other_ids, other_sizes):
    """Ids, starts and sizes of strings, of which some were encoded in one way and others in another."""
    starts, counts = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
    for which, before, n in ((chosen, 0, sizes), (~chosen, len(ids), other_sizes)):
        starts[which], counts[which] = before + np.cumsum(n) - n, n
    return np.concatenate([ids, other_ids]).astype(np.uint16), starts, counts


@lru_cache(2)
def load_encoder(name: str) -> WordEncoder:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(public_tokenizers.path(name))


def _pieces(texts: pa.Array):
    """Ranges of texts of about TEXT_BYTES."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield at, to
        at = to


def _writer(folder: str, name: str, end_id: int, file_ids: int):
    def write(batches):
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        encoder, pid, seq = load_encoder(name), TaskContext.get().partitionId(), 0
        hold_memo("tokenfile", encoder.forget)
        docs, lengths, parts, size = [], [], [], 0

        def put():
            data = pack(docs, lengths, np.concatenate(parts))
            file = f"part-{pid:06d}-{seq:05d}.qtok"
            tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(tmp) as out:
                out.write(data)
            store.move(tmp, f"{base}/{file}")
            return pa.RecordBatch.from_pydict({"file": [file], "docs": [len(docs)], "ids": [size], "bytes": [len(data)]})

        for batch in batches:
            own, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            for low, high in _pieces(texts):
                ids, sizes = encoder.encode_array(texts.slice(low, high - low))
                ids, ends = np.insert(ids, np.cumsum(sizes), end_id), np.cumsum(sizes + 1)
                at = done = 0
                while at < len(ends):
                    # up to the document that fills the file
                    to = min(int(np.searchsorted(ends, done + file_ids - size)) + 1, len(ends))
                    docs += own[low + at : low + to]
                    lengths += (sizes[at:to] + 1).tolist()
                    parts.append(ids[done : ends[to - 1]])
                    size += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if size >= file_ids:
                        yield put()
                        seq, docs, lengths, parts, size = seq + 1, [], [], [], 0
        if docs:
            yield put()

    return write


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; return the manifest.

    The manifest has file, docs, ids, bytes and start, the number of ids in all files
    before. Each document ends with end_id; a null text has only that. Rows with a null
    doc_id come first, rows of one id in the order of the md5 of their texts. An empty table
    writes no file. A text of any length is one document; it is never split over files, so
    a file is as long as its last text makes it. The vocabulary `name` must have less than
    65536 ids, as a file holds 16 bits of each, and cut texts like the default; else the task
    fails with ValueError.
    The numbers of ids before each file are summed over a row for each file, in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges are drawn from short keys, which are what goes to the driver; how many ranges a task takes is left to AQE
    rows = rows.withColumn("key", F.md5("text")).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    manifest = rows.select("doc_id", "text").mapInArrow(_writer(folder, name, end_id, file_ids), "file string, docs long, ids long, bytes long")
    path = f"{folder.rstrip('/')}-manifest"
    manifest.write.parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return spark.read.parquet(path).withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(with_ids: bool):
    cols = ["file", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(frames):
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                docs, lengths, ids = unpack(bytes(content))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                wide = ids.astype("<u4")
                rows = []
                for d, a, b in zip(docs, starts.tolist(), ends.tolist(), strict=True):
                    raw = wide[a:b].tobytes()
                    rows.append((path.rsplit("/", 1)[1], None if d is None else str(d), a, b - a, zlib.crc32(raw), raw)[: len(cols)])
                yield pd.DataFrame(rows, columns=cols)

    return read


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit) from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtok").load(folder).select("path", "content")
    schema = "file string, doc_id string, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = files.mapInPandas(_reader(with_ids), schema)
    offsets = manifest.select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    out = rows.join(offsets, F.col("file") == F.col("_file"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    folder = make_folder(spark, scratch_path(spark, "tokens"))
    manifest = write_tokens(read_table(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, manifest)
