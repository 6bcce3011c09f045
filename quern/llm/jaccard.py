"""N-gram Jaccard join with signature trees.

1. Each text becomes the set of hashes of its five-word shingles. Equal sets form one
   class; only classes are compared.
2. Two sets that link share a token among the first |x| - ceil(0.8 |x|) + 1 tokens of any
   fixed order. The order puts tokens that very many documents hold last, so passages
   that are common everywhere bring no one together. Classes that share such a token
   meet in a group; groups with the same members count once.
3. A group becomes a signature tree: nodes hold OR-combined (and AND-combined) token
   bitmaps and size ranges. A dual traversal prunes node pairs by the largest possible
   overlap, and pairs that already hang together; what is left becomes candidate edges,
   at most one for each member. Their components are clusters that hold every link.
4. In a cluster the sets themselves are compared by a second dual traversal, again
   skipping what is already linked. A group or cluster above a size limit is dealt as
   pairs of chunks to several tasks, so none is unbounded, and no pair is left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold_memo, materialize, read_table, shuffle_parts

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of a signature for each token, at least: of those that go between tasks, and of those in a cluster.
SENT_BITS, CLUSTER_BITS = 2, 8
#: Members of a group or cluster that one task compares at once.
GROUP_LIMIT, CLUSTER_LIMIT = 20_000, 4_000
#: A token in more than one of so many documents goes last in the order. So the list of
#: these tokens is no longer than COMMON times the mean set size, whatever the input.
COMMON = 200


@lru_cache(1)
def _tables():
    rng = np.random.default_rng(20240608)
    lower = np.arange(256, dtype=np.uint64)
    lower[ord("A") : ord("Z") + 1] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space, rng.integers(1, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text.

    A word is hashed by eight bytes at a time, each mixed with its place before the sum, so no
    arrangement of the same letters cancels out. Of two texts that differ, a given pair of
    shingles has one hash with a probability of 2**-64.
    """
    lower, space, odd = _tables()
    x = np.frombuffer(text.encode(), np.uint8)
    if not len(x):
        return np.empty(0, np.uint64)
    blank = space[x]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    # no white space before the first word, so that each byte has a place in its word
    x, blank, starts = x[starts[0] :], blank[starts[0] :], starts - starts[0]
    within = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    value = lower[x] << ((within & 7).astype(np.uint64) * np.uint64(8))
    value[blank] = 0
    first = np.flatnonzero((within & 7 == 0) & ~blank)  # where eight bytes of a word begin
    part = np.add.reduceat(value, first)
    part = _mix(part ^ _mix((within[first] >> 3).astype(np.uint64) * odd[14] + odd[15]))
    w = _mix(np.add.reduceat(part, np.searchsorted(first, starts)) + sizes.astype(np.uint64) * odd[0])
    n = len(w) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(w * odd[1 : 1 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + n] * odd[1 + k]
    return np.unique(_mix(h))


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = _mix(tokens * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    other = np.bitwise_xor.reduce(tokens) if len(tokens) else np.uint64(0)
    return int(_mix(np.array([total ^ _mix(np.array([other + np.uint64(len(tokens))], np.uint64))[0]], np.uint64)).view(np.int64)[0])


def size_class(n: int) -> int:
    return max(6, int(n).bit_length())


def width(cls: int, bits: int) -> int:
    """Signature bits for the sets of a size class, which have fewer than 2**cls tokens."""
    return bits << cls


def signature(tokens: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of `size` bits, a power of two; halves of it, OR-ed, are the shorter bitmap."""
    bits = np.zeros(size, bool)
    bits[(tokens >> np.uint64(20)) & np.uint64(size - 1)] = True
    return np.packbits(bits)


def shortened(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) * 8 > size:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


def size_classes(sizes: np.ndarray):
    """(class, members) such that all pairs that can link meet in a class.

    A class also holds the sets of the next one that are near enough in size.
    """
    own = np.array([size_class(n) for n in sizes.tolist()])
    for c in np.unique(own).tolist():
        yield c, np.flatnonzero((own == c) | ((own == c + 1) & (PERCENT * sizes <= 100 * ((1 << c) - 1))))


def prefix(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first tokens of which two linked sets share one: rare before common, then by hash."""
    n = len(tokens)
    size = n - (PERCENT * n + 99) // 100 + 1
    if not len(common) or n == 0:
        return tokens[:size]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    late = common[at] == tokens
    return np.concatenate([tokens[~late], tokens[late]])[:size]


def least_overlap(a, b):
    """The least intersection with which sets of these sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


class Forest:
    """Disjoint sets over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class SignatureTree:
    """Binary tree over sets in order of size; leaves are single sets.

    links(forest, test) joins all pairs (i, j) whose bound allows a link and for which
    test(i, j) is true, except those that hang together already.
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, members: np.ndarray | None = None):
        """sizes of all sets, and the bitmaps of the members (all, if None) that the tree is of."""
        members = np.arange(len(sizes)) if members is None else members
        turn = np.lexsort((bitmaps[:, 0], sizes[members]))
        self.order = members[turn]
        lo = hi = sizes[self.order].astype(np.int64)
        any_ = all_ = bitmaps[turn]
        self.levels = [(lo, hi, any_, all_)]
        while len(lo) > 1:
            if len(lo) % 2:  # an odd one stands twice
                lo, hi, any_, all_ = (np.concatenate([v, v[-1:]]) for v in (lo, hi, any_, all_))
            lo, hi, any_, all_ = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), any_[::2] | any_[1::2], all_[::2] & all_[1::2]
            self.levels.append((lo, hi, any_, all_))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Can a set under node a and one under node b link?"""
        lo, hi, any_, all_ = self.levels[level]
        ok = (100 * hi[a] >= PERCENT * lo[b]) & (100 * hi[b] >= PERCENT * lo[a])
        k = np.flatnonzero(ok)
        p, q = a[k], b[k]
        # tokens that each set under one node has and none under the other
        most_p = hi[p] - np.bitwise_count(all_[p] & ~any_[q]).sum(axis=1, dtype=np.int64)
        most_q = hi[q] - np.bitwise_count(all_[q] & ~any_[p]).sum(axis=1, dtype=np.int64)
        ok[k] = np.minimum(most_p, most_q) >= least_overlap(lo[p], lo[q])
        return ok

    def _uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the common label under a node, or -1."""
        now = labels[self.order]
        out = [now]
        for _ in self.levels[1:]:
            if len(now) % 2:
                now = np.r_[now, now[-1:]]
            now = np.where(now[::2] == now[1::2], now[::2], -1)
            out.append(now)
        return out

    def links(self, forest: Forest, test, step: int = 1 << 14) -> None:
        n = len(self.order)
        if n < 2:
            return
        order = self.order.tolist()
        for i in range(n - 1):  # neighbours first: near copies soon hang together
            if self.possible(0, np.array([i]), np.array([i + 1]))[0] and forest.find(order[i]) != forest.find(order[i + 1]) and test(order[i], order[i + 1]):
                forest.join(order[i], order[i + 1])
        same = self._uniform(forest.labels())
        top = len(self.levels) - 1
        stack = [(top, np.array([0]), np.array([0]))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            keep = ~((same[level][a] == same[level][b]) & (same[level][a] >= 0))
            a, b = a[keep], b[keep]
            keep = self.possible(level, a, b)
            if level:
                keep |= a == b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                changed = False
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if i != j and forest.find(order[i]) != forest.find(order[j]) and test(order[i], order[j]):
                        changed |= forest.join(order[i], order[j])
                if changed and stack:
                    same = self._uniform(forest.labels())
                continue
            left, right = [], []
            m = len(self.levels[level - 1][0])
            for da in (0, 1):
                for db in (0, 1):
                    p, q = 2 * a + da, 2 * b + db
                    ok = (p < m) & (q < m) & ((a != b) | (p <= q))
                    left.append(p[ok])
                    right.append(q[ok])
            stack.append((level - 1, np.concatenate(left), np.concatenate(right)))


def _common_tokens(frames):
    """Tokens in many documents of a batch, with their counts."""
    hold_memo("jaccard", lambda: None)
    for f in frames:
        sets = [shingles(t) for t in f.text]
        if sets:
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            keep = n >= max(2, len(sets) // (2 * COMMON))
            yield pd.DataFrame({"token": token[keep].view(np.int64), "n": n[keep]})


def _describe(common: np.ndarray):
    def describe(frames):
        hold_memo("jaccard", lambda: None)
        seen: set[int] = set()
        for f in frames:
            rows = []
            for text in f.text:
                tokens = shingles(text or "")
                if not len(tokens):
                    rows.append((0, None, None, None, None))
                    continue
                key = set_key(tokens)
                if key in seen:
                    rows.append((len(tokens), key, None, None, None))
                    continue
                if len(seen) < 1_000_000:  # copies met later in this task need not say it again
                    seen.add(key)
                bits = signature(tokens, width(size_class(len(tokens)), SENT_BITS))
                first = prefix(tokens, common)
                rare = len(first) - int(np.isin(first, common).sum())
                rows.append((len(tokens), key, first.view(np.int64), rare, bits.tobytes()))
            out = pd.DataFrame(rows, columns=["n", "set", "prefix", "rare", "bits"], dtype=object)
            for c in ("set", "rare"):
                out[c] = pd.array(out[c].tolist(), dtype="Int64")
            out["n"] = out["n"].astype("int64")
            out.insert(0, "doc_id", f.doc_id.to_numpy())
            out.insert(1, "text_hash", f.text_hash.to_numpy())
            yield out

    return describe


def _grouped(frames, keys: list[str]):
    """Groups of rows of a sorted partition, as lists of tuples; the third column tells repeated rows."""
    held, now = [], None
    for f in frames:
        cols = [f[c].tolist() for c in keys]
        for key, row in zip(zip(*cols, strict=True), f.itertuples(index=False, name=None), strict=True):
            if key != now:
                if held:
                    yield held
                held, now = [], key
            if not held or held[-1][2] != row[2]:
                held.append(row)
    if held:
        yield held


def _edges(rows_of):
    """One row (u, v) for each member that hangs on another, v the root."""
    u, v = [], []
    for keys, forest in rows_of:
        for i, r in enumerate(forest.labels().tolist()):
            if r != i and keys[i] != keys[r]:
                u.append(keys[i])
                v.append(keys[r])
        if len(u) > 20_000:
            yield pd.DataFrame({"u": u, "v": v})
            u, v = [], []
    if u:
        yield pd.DataFrame({"u": u, "v": v})


def _candidates(frames):
    """Input sorted by token and cell: token, cell, set, n, bits."""

    def joined():
        for rows in _grouped(frames, ["token", "cell"]):
            keys = [r[2] for r in rows]
            forest = Forest(len(rows))
            sizes = np.array([r[3] for r in rows])
            for c, own in size_classes(sizes):
                bitmaps = np.stack([shortened(np.frombuffer(rows[i][4], np.uint8), width(c, SENT_BITS)) for i in own.tolist()])
                SignatureTree(sizes, bitmaps.view(np.uint64), own).links(forest, lambda i, j: True)
            yield keys, forest

    return _edges(joined())


def _verified(frames):
    """Input sorted by cluster and cell: cluster, cell, set, text."""

    def joined():
        for rows in _grouped(frames, ["cluster", "cell"]):
            sets = {key: s for _, _, key, text in rows if set_key(s := shingles(text)) == key}
            keys, tokens = list(sets), list(sets.values())
            if len(keys) < 2:
                continue
            forest = Forest(len(keys))
            sizes = np.array([len(t) for t in tokens])

            def test(i, j, tokens=tokens):
                a, b = tokens[i], tokens[j]
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                return 100 * both >= PERCENT * (len(a) + len(b) - both)

            for c, own in size_classes(sizes):
                bitmaps = np.stack([signature(tokens[i], width(c, CLUSTER_BITS)) for i in own.tolist()])
                SignatureTree(sizes, bitmaps.view(np.uint64), own).links(forest, test)
            yield keys, forest

    return _edges(joined())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (u, v) pairs; root is the least node of the component.

    Alternating stars: each round hangs the neighbours of a node on the least of them,
    with grouped minima and joins only. Ends when a round changes nothing.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        # large star: larger neighbours hang on the least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours hang on the least of them
        large = materialize(large.where("u <> v").distinct(), "star")
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(down, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "star")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _cells(df: DataFrame, key: str, many: str, limit: int) -> DataFrame:
    """df with cell: one for small groups; members of large ones go to every pair of chunks that holds theirs."""
    g = F.ceil(F.col(many) / F.lit(limit)).cast("int")
    c = F.pmod(F.xxhash64("set"), g).cast("int")
    pair = F.transform(F.sequence(F.lit(0), g - 1), lambda j: F.concat_ws("-", F.least(c, j).cast("string"), F.greatest(c, j).cast("string")))
    return df.withColumn("cell", F.explode(F.when(F.col(many) > limit, pair).otherwise(F.array(F.lit("")))))


def text_hash(column="text"):
    """A name of a text, null or not, by which rows with one doc_id are told apart."""
    return F.coalesce(F.md5(F.col(column).cast("string")), F.lit("null"))


def jaccard_components(docs: DataFrame, group_limit: int = GROUP_LIMIT, cluster_limit: int = CLUSTER_LIMIT, with_group: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. The set of a
    text: its distinct five-word shingles; with fewer words the whole sequence as one;
    a text without words, empty or null has none and links with nothing. Documents link
    when 100 * intersection >= 80 * union; component_id is the least doc_id reachable by
    links. A row with a null id links like others and gets that id or null. Repeated ids
    count by their texts. Extra columns are ignored.

    with_group adds text_hash, which with doc_id names the text, and group, a name of the
    component that is there for rows without an id too; null for texts without words.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    counts = data.where("text is not null").select("text").mapInPandas(_common_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    floor = max(20, data.count() // COMMON)
    common = np.sort(np.array([r.token for r in counts.where(F.col("n") >= floor).select("token").collect()], np.int64).view(np.uint64))
    schema = "doc_id string, text_hash string, n long, set long, prefix array<long>, rare int, bits binary"  # pandas would make floats of ids with nulls
    described = data.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_describe(common), schema)
    described = materialize(described.withColumn("doc_id", F.col("doc_id").cast("long")), "sets")

    tokens = described.where("prefix is not null").select("set", "rare", F.posexplode("prefix").alias("pos", "token"))
    marks = {"m": F.count(F.lit(1)), "s1": F.bit_xor(F.xxhash64("set", F.lit(1))), "s2": F.bit_xor(F.xxhash64("set", F.lit(2)))}
    # a rare token is in one document of COMMON at most
    rare = tokens.where("pos < rare").select("set", "token").repartition(parts, "token").dropDuplicates(["token", "set"])
    rare = rare.withColumns({c: x.over(Window.partitionBy("token")) for c, x in marks.items()}).where("m > 1")
    # of a common one the sums are made before the shuffle, and the join can be split
    late = materialize(tokens.where("pos >= rare").select("set", "token").dropDuplicates(["token", "set"]), "late")
    stats = late.groupBy("token").agg(*[x.alias(c) for c, x in marks.items()]).where("m > 1").withColumnRenamed("token", "t")
    groups = rare.unionByName(late.join(stats, F.col("token") == F.col("t")).drop("t"))
    groups = materialize(groups, "groups")
    # groups with the same members: one stands for all
    chosen = groups.groupBy("m", "s1", "s2").agg(F.min("token").alias("t")).select("t")
    members = groups.select("token", "set", "m").join(chosen, F.col("token") == F.col("t"), "left_semi")
    bits = described.where("bits is not null").groupBy("set").agg(F.first("bits").alias("bits"), F.first("n").alias("n")).withColumnRenamed("set", "set2")
    members = members.join(bits, F.col("set") == F.col("set2")).select("token", "set", "m", "n", "bits")
    members = _cells(members, "token", "m", group_limit).select("token", "cell", "set", "n", "bits")
    dealt = members.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "set")
    edges = dealt.mapInPandas(_candidates, "u long, v long")
    clusters = components(edges)

    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m")).select(F.col("root").alias("cluster"), "m")
    ids = described.where("set is not null and prefix is not null").groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    needed = clusters.join(ids, F.col("node") == F.col("set")).join(sizes, F.col("root") == F.col("cluster")).select("cluster", "m", "set", "one")
    named = F.col("one.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("one.text_hash") == F.col("text_hash"))
    texts = needed.join(data, named).select("cluster", "m", "set", "text")
    cells = _cells(texts, "cluster", "m", cluster_limit).select("cluster", "cell", "set", "text")
    cells = cells.repartition(parts, "cluster", "cell").sortWithinPartitions("cluster", "cell", "set")
    linked = components(cells.mapInPandas(_verified, "u long, v long")).select(F.col("node").alias("node"), F.col("root").alias("root"))

    own = described.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set")
    rooted = own.join(linked, F.col("set") == F.col("node"), "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "set").alias("group"))
    rooted = materialize(rooted, "rooted")
    least = rooted.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("group", "group2")
    out = rooted.join(least, F.col("group") == F.col("group2"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *["text_hash", "group"] * with_group)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
