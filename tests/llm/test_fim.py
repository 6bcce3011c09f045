import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from(list("ab \n\té漢😀\x1c  <PSM>\x00")), max_size=60)


def plain(doc_id, text, unit="word"):
    text = text or ""
    g = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = UNITS.findall(text) if unit == "word" else list(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 10**6))
def test_cut_equals_plain(text, doc_id):
    for unit in ("word", "char"):
        n, form, p, m, out = fim.cut(text.encode(), fim.numbers(doc_id), unit)
        assert (n, form, p, m, out.decode()) == plain(doc_id, text, unit)
        assert fim.restore(out, form).decode() == text


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_index_converts_both_ways(text):
    import numpy as np

    data = text.encode()
    index = fim.ExceptionIndex(np.frombuffer(data, np.uint8))
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.to_bytes(range(len(text) + 1)).tolist() == at
    assert index.to_chars(at).tolist() == list(range(len(text) + 1))
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 10**6))
def test_byte_cuts_keep_characters(text, doc_id):
    n, form, p, m, out = fim.cut(text.encode(), fim.numbers(doc_id), "byte")
    assert n == len(text.encode()) and fim.restore(out, form).decode() == text


def test_marks_across_cuts():
    """Text that would form a mark together with the next one still comes back."""
    for p, m, s in [("<", "P>", "S>"), ("<S", "<M", "><P"), ("<P", ">", "<"), ("", "", "")]:
        for form in ("psm", "spm"):
            out = fim.arrange(p.encode(), m.encode(), s.encode(), form)
            assert fim.restore(out, form) == (p + m + s).encode()


def test_documents(spark):
    rows = [(k, f"Wörter {k} 漢字  and\tmore \n" * (k % 5)) for k in range(200)]
    rows += [(None, "no id at all"), (None, None), (7, None), (7, ""), (7, "same id"), (7, "same id"), (9, "a <P> b"), (11, "é long 😀 " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, form string")
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        n, form, p, m, out = plain(doc_id, text)
        want.append((doc_id, n, form, p, m, sha256(out.encode()).hexdigest(), sha256((text or "").encode()).hexdigest(), out))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
