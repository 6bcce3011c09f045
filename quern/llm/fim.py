"""Fill-in-middle transformation of documents, with cuts in tokens, characters or bytes.

Texts stay UTF-8 bytes from the column to the output. To turn byte cuts into code points and
back, a text has a sparse index: only its multibyte characters are recorded, with the
place of each and the bytes that they have beyond one, summed up. A cut is looked up among
them by searchsorted; everything between is arithmetic, and an ASCII text has an empty index.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many are suffix first.
TRANSFORMED, SPM = 50, 80
#: Rows of a batch that a task gives back, and bytes of the texts in it.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


class ExceptionIndex:
    """Places of the multibyte characters of a UTF-8 text, in bytes and code points, and their excess bytes, summed up."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.total = np.concatenate([[0], np.cumsum(excess)])
        self.bytes = lead
        self.chars = lead - self.total[:-1]
        self.size = len(data)

    def to_chars(self, cuts):
        """Code points before byte cuts that lie between characters."""
        cuts = np.asarray(cuts, np.int64)
        return cuts - self.total[np.searchsorted(self.bytes, cuts)]

    def to_bytes(self, cuts):
        """Bytes before cuts given in code points."""
        cuts = np.asarray(cuts, np.int64)
        return cuts + self.total[np.searchsorted(self.chars, cuts)]


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte ends of the units of a text: words with the white space before them, and white space at the end."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    if not len(data):
        return np.empty(0, np.int64)
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(last, len(data))  # a last word, or what is left of white space


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return prefix + middle + suffix


def restore(output: bytes, form: str) -> bytes:
    """The text, from an arranged output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def numbers(doc_id, seed: int = 42) -> tuple[int, int, int, int]:
    """The four numbers that decide how a document is cut; a null id counts as no digits."""
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(text: bytes, h: tuple[int, int, int, int], unit: str = "word") -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain), output.

    unit: word (see unit_ends), char or byte; byte cuts move back to the start of the
    character that they fall in.
    """
    data = np.frombuffer(text, np.uint8)
    index = ExceptionIndex(data)
    ends = unit_ends(data) if unit == "word" else None
    n = len(ends) if unit == "word" else index.size if unit == "byte" else int(index.to_chars(index.size))
    plain = not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= TRANSFORMED
    if plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if unit == "word":
        at = [0 if k == 0 else int(ends[k - 1]) for k in (a, b)]
        chars = index.to_chars(at)
    elif unit == "char":
        chars, at = np.array([a, b]), index.to_bytes([a, b]).tolist()
    else:
        at = [_start(text, k) for k in (a, b)]
        chars = index.to_chars(at)
    form = "spm" if h[3] % 100 < SPM else "psm"
    out = arrange(text[: at[0]], text[at[0] : at[1]], text[at[1] :], form)
    return n, form, int(chars[0]), int(chars[1] - chars[0]), out


def _start(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def fill_in_middle(docs: DataFrame, seed: int = 42, unit: str = "word", with_output: bool = True) -> DataFrame:
    """Return doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (and output) for each row.

    n is the number of units. A null text is an empty one, and an empty text is plain, as
    is one that holds a mark. Rows with one id are cut by the same numbers; a null id is
    an id of its own. restored_sha256 is of the text that is rebuilt from output and form.
    A text of any length is one row of one task; an empty table gives an empty result.
    Other columns are ignored.
    """
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    out_type = T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in fields], *[T.StructField("output", T.StringType())] * with_output])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.string()] * with_output]
    names = out_type.names

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_binary())
            rows, start, size = [], 0, 0
            for k in range(b.num_rows):
                text = texts[k].as_py() or b""
                n, form, prefix, middle, out = cut(text, numbers(ids[k].as_py(), seed), unit)
                rows.append((n, form, prefix, middle, sha256(out).hexdigest(), sha256(restore(out, form)).hexdigest(), *[out.decode()] * with_output))
                size += len(out) * with_output
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([ids[start : k + 1], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)
                    rows, start, size = [], k + 1, 0

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out_type)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut by words; digests of the output and of the text rebuilt from it."""
    return fill_in_middle(read_table(spark, sf_dir, "documents"), with_output=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
n AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
