"""Merkle manifest of a dataset, with a witness for every row.

Rows are leaves; per key (language) they ascend by id, and every eight consecutive nodes
of a level are hashed into their parent until one node is left, the subroot. Subroots
are nodes of one more tree, whose last node is the root.

The tree is built by appending. `Appender` takes the nodes of an aligned stretch one after
another and keeps only open runs. A node that joins an open run gets the digests before it
as a partial witness, and every later sibling extends the witnesses of the run; when a run
is full, or the stretch ends, it closes into its parent, which is appended one level up.
A stretch is a block of 8**3 leaves. Blocks are dealt over tasks; the block roots are then
appended in the same way as the nodes of a table 512 times smaller, until each key has one.

Witnesses come down again: the witness of a node is its own within its block, then that of
its block's root. Blocks are appended a second time for that, as witnesses of all leaves are
larger than their texts and hashing is cheaper than storing them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, read_table, shuffle_parts

#: Nodes of a run, levels of a block, nodes of a block.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: Rows of a batch that a task gives back.
BATCH = 5000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UP = T.StructType([T.StructField(c, T.LongType() if c == "i" else T.StringType()) for c in ("key", "i", "up", "subroot", "root")])
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Node:
    """A digest, the run that it stands in and its place there; above is the parent."""

    __slots__ = ("above", "digest", "left", "right")

    def __init__(self, value: str):
        self.digest, self.left, self.right, self.above = value, "", "", None

    def witness(self) -> list[tuple[str, str]]:
        """Digests left and right of the node and of each of its ancestors in the stretch."""
        out, node = [], self
        while node.above is not None:
            out.append((node.left, node.right))
            node = node.above
        return out


class Appender:
    """Appends the nodes of one aligned stretch; at most ARITY open nodes of a level are held.

    levels: how far the stretch is raised. None: until a single node is left.
    """

    def __init__(self, levels: int | None = None):
        self.levels = levels
        self.open: list[list[Node]] = [[]]

    def append(self, value: str) -> Node:
        node = Node(value)
        self._join(0, node)
        return node

    def _join(self, level: int, node: Node) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if len(run) == ARITY:  # full: it closes only now, as it may be the last of an unbounded stretch
            self._close(level)
            run = self.open[level]
        for other in run:
            node.left += other.digest
            other.right += node.digest
        run.append(node)
        if len(run) == ARITY and self.levels is not None and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run = self.open[level]
        parent = Node(digest("".join(n.digest for n in run)))
        for n in run:
            n.above = parent
        self.open[level] = []
        self._join(level + 1, parent)

    def finish(self) -> Node:
        """Close what is open, short runs too, and return the top node."""
        level = 0
        while True:
            run = self.open[level]
            higher = any(self.open[level + 1 :])
            if self.levels is None and len(run) == 1 and not higher:
                return run[0]
            if self.levels is not None and level == self.levels:
                return run[0]
            if run:
                self._close(level)
            level += 1


def fold(value: str, witness: list[tuple[str, str]]) -> str:
    """The top digest that a leaf and its witness give."""
    for left, right in witness:
        value = digest(left + value + right)
    return value


def proof(witness: list[tuple[str, str]]) -> str:
    return digest("".join(left + right for left, right in witness))


def _pack(witness: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in witness)


def _unpack(text: str | None) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


def leaf_digest(text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of the named columns of a row, each `-` if null, else its bytes counted, a colon and the value."""
    values = [(text if text is not None and f == "text" else F.col(f)).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def place_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `i`, the row's place (from 0) among those of its key, and `total`, their number.

    Rows are dealt by ranges of (key, order), sorted and written once with their place in
    the range; where a key starts in each range is counted from a row for each range and
    key. No task sees all rows of a key. Rows that tie are told apart by where they came from.
    """
    spark = rows.sparkSession
    by = [key, *order, "_salt"]
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(shuffle_parts(spark), *by)
    dealt = dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_salt")
    dealt = materialize(dealt, "merkle-ranges").withColumn("_range", F.shiftright("_at", 33))
    spans = dealt.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    mine = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(key, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("total"))
    placed = dealt.join(spans, [key, "_range"]).withColumn("i", F.col("_at") + F.col("_shift"))
    return materialize(placed.drop("_at", "_range", "_shift"), "merkle-leaves")


def _in_blocks(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes (key, i, ...) dealt by block, in order inside their task."""
    nodes = nodes.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))
    return nodes.repartition(shuffle_parts(nodes.sparkSession), "key", "block").sortWithinPartitions("key", "block", *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def block_roots(nodes: DataFrame) -> DataFrame:
    """Roots of the blocks of nodes (key, i, total, digest), as nodes of the next table.

    A key of one block is raised until one node is left, which has total 1.
    """
    out_type = T.StructType.fromDDL("key string, i long, total long, digest string")
    arrow = to_arrow_schema(out_type)

    def run(batches):
        at, appender, total, out = None, None, 0, []
        for key, block, n, value in _rows(batches):
            if (key, block) != at:
                if at is not None:
                    out.append((*at, -(-total // BLOCK), appender.finish().digest))
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out = []
                at, total, appender = (key, block), n, Appender(LEVELS if n > BLOCK else None)
            appender.append(value)
        if at is not None:
            out.append((*at, -(-total // BLOCK), appender.finish().digest))
            yield _batch(out, arrow)

    dealt = _in_blocks(nodes.select("key", "i", "total", "digest"), "i").select("key", "block", "total", "digest")
    return dealt.mapInArrow(run, out_type)


def build_tables(nodes: DataFrame) -> list[DataFrame]:
    """nodes and the tables of block roots above it, up to one node for each key.

    There is one more table for each 512-fold of the largest key.
    """
    tables = [nodes]
    while (tables[-1].agg(F.max("total")).first()[0] or 1) > 1:  # one number
        tables.append(materialize(block_roots(tables[-1].where("total > 1")), "merkle-blocks"))
    return tables


def witnesses(nodes: DataFrame, above: DataFrame, more: list[str], made, out_type: T.StructType) -> DataFrame:
    """made(key, i, digest, further columns, witness, subroot, root) for each of the nodes (key, i, total, digest, ...).

    above: (key, i, up, subroot, root) of the block roots, up being their packed witness.
    Rows of both are dealt by block; in a block the root's row stands first. A block's
    nodes are appended, and their witnesses are whole when it ends.
    """
    arrow, names = to_arrow_schema(out_type), ("up", "subroot", "root")
    rows = nodes.select("key", "i", "total", "digest", *[F.lit(None).cast("string").alias(c) for c in names], F.lit(1).alias("_kind"), *more)
    types = dict(rows.dtypes)
    empty = lambda c: F.lit(None).cast(types[c]).alias(c)
    tops = above.select("key", (F.col("i") * BLOCK).alias("i"), empty("total"), empty("digest"), *names, F.lit(0).alias("_kind"), *[empty(c) for c in more])
    dealt = _in_blocks(rows.unionByName(tops), "_kind", "i").select("_kind", "key", "i", "total", "digest", *names, *more)

    def run(batches):
        held, top, appender, out = [], None, None, []

        def end_block():
            if appender is not None:
                appender.finish()
                up = _unpack(top[0])
                out.extend(made(*row, node.witness() + up, *top[1:]) for node, row in held)
                held.clear()

        for kind, key, i, total, value, up, subroot, root, *rest in _rows(batches):
            if kind == 0:
                end_block()
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out.clear()
                top, appender = (up, subroot, root), None
            else:
                appender = appender or Appender(LEVELS if total > BLOCK else None)
                held.append((appender.append(value), (key, i, value, rest)))
        end_block()
        if out:
            yield _batch(out, arrow)

    return dealt.mapInArrow(run, out_type)


def descend(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Witnesses (key, i, up, subroot, root) of the block roots of the lowest table; top has those of each key's last node."""
    ends = lambda k: top.join(tables[k].where("total = 1").select("key"), "key", "left_semi")

    def made(key, i, value, rest, witness, subroot, root):
        return key, i, _pack(witness), subroot, root

    known = None
    for k in range(len(tables) - 1, 0, -1):
        deeper = known and witnesses(tables[k].where("total > 1"), known, [], made, UP)
        known = ends(k) if deeper is None else materialize(ends(k).unionByName(deeper), "merkle-up")
    return ends(0) if known is None else known.unionByName(ends(0))


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("-"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "lang", order: str = "doc_id") -> DataFrame:
    """Return order (doc_id), leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    tampered: the text as it is found later, null where it is not looked at; folded_root
    is recomputed from it (else from the row as it is) and the row's own witness.
    A null key is a key of its own and stands first; a null id stands before others.
    Repeated rows are leaves each; ties of an id go by the leaf. Null and empty texts
    are told apart. An empty table gives an empty result. Other columns are ignored.
    """
    parts = [F.col(order).alias("id"), _key(key).alias("key"), leaf_digest(fields=fields).alias("digest")]
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered, fields))
    hashed = materialize(docs.select(*parts, changed.alias("other")), "merkle-digests")  # texts are read once
    leaves = place_rows(hashed, "key", ["id", "digest"])
    tables = build_tables(leaves)
    # the last node of each key, in whichever table it stands
    subroots = reduce(DataFrame.unionByName, [t.where("total = 1").select(F.lit("").alias("key"), F.col("key").alias("name"), "digest") for t in tables])
    crown = place_rows(subroots, "key", ["name"])
    crowns = build_tables(crown)
    root = reduce(DataFrame.unionByName, [t.where("total = 1").select("key", F.lit(0).cast("long").alias("i"), F.lit("").alias("up"), F.lit("").alias("subroot"), F.col("digest").alias("root")) for t in crowns])

    def of_key(key, i, value, rest, witness, subroot, root):
        return rest[0], 0, _pack(witness), value, root

    def of_leaf(key, i, value, rest, witness, subroot, root):
        folded = fold(rest[1] or value, witness)
        return rest[0], value, subroot, root, proof(witness), folded, folded == root

    top = materialize(witnesses(crown, descend(crowns, root), ["name"], of_key, UP), "merkle-top")
    out_type = T.StructType([T.StructField(order, docs.schema[order].dataType), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    return witnesses(leaves, descend(tables, top), ["id", "other"], of_leaf, out_type)


def lower_cased(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The tampered text of the contract: every third row by crc32 of its id, A-Z in lower case."""
    return F.when(F.crc32(F.col(doc_id).cast("string")) % 3 == 0, F.translate(text, LETTERS, LETTERS.lower()))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of documents. A null text stays null when tampered with, so such a row still verifies."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    return merkle_manifest(docs, lower_cased())


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels over leaves (key, i, h, n)."""
    return (
        f"{name} AS (SELECT 0 AS lvl, key, i, h, n FROM {leaves} UNION ALL "
        f"SELECT lvl + 1, key, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY lvl, key, i // 8)"
    )


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1))::BIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({" || ".join(_FIELD.format(f) for f in FIELDS)}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({" || ".join(_FIELD.format(f) for f in FIELDS[:-1])} || {_FIELD.format(f"translate(text, '{LETTERS}', '{LETTERS.lower()}')")}) END AS other
  FROM documents),
p AS (SELECT *, coalesce('s' || lang, '-') AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
leaves AS (SELECT key, i, leaf AS h, n FROM p),
{_tree("t", "leaves")},
subs AS (SELECT key AS name, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
tops AS (SELECT '' AS key, i, h, n FROM subs),
{_tree("u", "tops")},
root AS (SELECT h AS root FROM u WHERE n = 1),
own AS (SELECT p.doc_id, p.key, p.i, p.leaf, p.other, s.h AS subroot, s.i AS si FROM p JOIN subs s ON s.name = p.key),
steps AS (
  SELECT o.key, o.i, o.si, t.lvl, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < o.i // (8 ** t.lvl)::BIGINT) AS l, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > o.i // (8 ** t.lvl)::BIGINT) AS r
  FROM own o JOIN t ON t.key = o.key AND t.n > 1 AND t.i // 8 = o.i // (8 ** (t.lvl + 1))::BIGINT GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT o.key, o.i, o.si, 100 + u.lvl, string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < o.si // (8 ** u.lvl)::BIGINT), string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > o.si // (8 ** u.lvl)::BIGINT)
  FROM own o JOIN u ON u.n > 1 AND u.i // 8 = o.si // (8 ** (u.lvl + 1))::BIGINT GROUP BY 1, 2, 3, 4),
numbered AS (SELECT key, i, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY key, i ORDER BY lvl) AS k, count(*) OVER (PARTITION BY key, i) AS m FROM steps),
proofs AS (SELECT key, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM numbered GROUP BY 1, 2),
folds AS (
  SELECT key, i, 0 AS k, coalesce(other, leaf) AS h FROM own
  UNION ALL
  SELECT f.key, f.i, f.k + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN numbered s ON s.key = f.key AND s.i = f.i AND s.k = f.k + 1),
ends AS (SELECT key, i, arg_max(h, k) AS folded FROM folds GROUP BY 1, 2)
SELECT o.doc_id, o.leaf, o.subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = root.root AS verified
FROM own o JOIN ends e ON e.key = o.key AND e.i = o.i LEFT JOIN proofs p ON p.key = o.key AND p.i = o.i CROSS JOIN root
"""
