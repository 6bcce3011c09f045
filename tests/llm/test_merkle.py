import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from quern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, i long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Levels of the tree over nodes, and the siblings of each."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_witness(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def brute(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        value = leaf(doc_id, source, lang, n_chars, text)
        other = None
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            other = leaf(doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        by[lang].append((doc_id is not None, doc_id or 0, value, doc_id, other))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    crown = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, value, doc_id, other) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            witness = plain_witness(trees[x], i) + plain_witness(crown, k)
            folded = other or value
            for left, right in witness:
                folded = h(left + folded + right)
            out.append((doc_id, value, trees[x][-1][0], crown[-1][0], h("".join(a + b for a, b in witness)), folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.merkle_manifest(docs, merkle.lower_cased()).collect()), key=repr)


def test_appender_equals_plain_tree():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513]:
        values = [h(str(k)) for k in range(n)]
        a = merkle.Appender()
        nodes = [a.append(v) for v in values]
        levels = plain_tree(values)
        assert a.finish().digest == levels[-1][0]
        assert all(x.witness() == plain_witness(levels, i) for i, x in enumerate(nodes))
        assert all(merkle.fold(v, x.witness()) == levels[-1][0] for v, x in zip(values, nodes))


def test_partial_witnesses_grow_only():
    """A witness is a prefix, run by run, of what it is after further appends."""
    a, nodes = merkle.Appender(), []
    for k in range(20):
        before = [(x.left, x.right) for x in nodes]
        nodes.append(a.append(h(str(k))))
        assert all(x.left == left and x.right.startswith(right) for x, (left, right) in zip(nodes, before))


def test_manifest_equals_brute_force(spark):
    rows = [(k, f"Text {k} Ä" * (k % 3), ["en", "de", None, "Ünter"][k % 7 % 4], f"s{k % 5}", k) for k in range(1500)]
    rows += [(None, "No Id", "en", None, None)] * 9 + [(3, None, "en", "s", 0), (3, "", "en", "s", 0), (6, "Lone", "zz", "s", 1)]
    rows += [(10**17 + 1, "BIG", "de", "s", 1), (10**17 + 2, "BIG", "de", "s", 1)] + [(8, "Same", "fr", "s", 4)] * 70
    assert manifest(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_manifest(spark, n):
    rows = [(k, "A long Text " * 50_000, "en", None, 1) for k in range(n)]
    assert manifest(spark, rows) == brute(rows)


def test_large_key_needs_three_tables(spark, monkeypatch):
    """One key holds all rows; blocks of eight make a tower of tables."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, "T", "en", "s", 1) for k in range(600)] + [(5, "T", "de", "s", 1)] * 9
    assert manifest(spark, rows) == brute(rows)
