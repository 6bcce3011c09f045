"""WARC archives: a deduplicating writer and a salvaging reader.

Writer: Spark decides which records are revisits, deals the records by page over tasks,
and each task writes whole gzip-member archives to the shared folder. A file appears
under its final name only when it is complete, and the name and the bytes depend only
on the task's rows, so a repeated task writes the same file again.

Reader: reads members in order. When a member fails a check (gzip, header, length or
digest), it looks for the next gzip magic or version line that starts a valid record,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, make_folder, materialize, read_table, scratch_path

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A new file is begun after so many bytes.
FILE_BYTES = 8 << 20
MIN_DEDUP_BYTES = 100

RECORD_SCHEMA = (
    "path string, kind string, offset long, length long, reason string, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def plan_records(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (null: a response).

    Only (page_id, digest) pairs are grouped by digest, with partial sums before the
    shuffle, and the digests of very common payloads go to their pages by broadcast;
    payloads move once, by page and digest, so rows without an id are spread, too.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = materialize(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"), "digests")
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null")
    firsts = materialize(firsts, "first-pages")
    n = firsts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    revisits = join_hot(large, firsts, ["payload_digest"], "_n", n).where(F.coalesce(F.col("page_id") > F.col("_first"), F.lit(True)))
    revisits = revisits.groupBy("page_id", "payload_digest").agg(F.first("_first").alias("refers_to"))
    # the id goes first: it alone deals the rows evenly, and the digest settles repeated ids
    r = revisits.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "refers_to")
    return rows.join(r, rows.page_id.eqNullSafe(r._p) & (rows.payload_digest == r._d), "left").drop("_p", "_d")


def _clean(value) -> bytes:
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value)).encode("utf-8", "replace")


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member with one WARC record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id),
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Payload-Length: %d" % len(payload),
    ]
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    raw = b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str, file_bytes: int):
    def write(frames):
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        pid, seq, parts, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def put():
            name = f"{base}/part-{pid:06d}-{seq:05d}.warc.gz"
            tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(tmp) as out:
                for x in parts:
                    out.write(x)
            store.move(tmp, name)
            return pd.DataFrame({"file": [name.rsplit("/", 1)[1]], "records": [n], "bytes": [size]})

        for f in frames:
            for page_id, url, payload, digest, ref in zip(f.page_id, f.url, f.payload, f.payload_digest, f.refers_to, strict=True):
                page_id, ref = (None if pd.isna(x) else int(x) for x in (page_id, ref))
                parts.append(build_record(page_id, url, bytes(payload), digest, ref))
                size, n = size + len(parts[-1]), n + 1
                if size >= file_bytes:
                    yield put()
                    seq, parts, size, n = seq + 1, [], 0, 0
        if parts:
            yield put()

    return write


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_DEDUP_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each row of pages; return the manifest (file, records, bytes).

    Of records with equal payloads of at least min_bytes, those with the smallest page_id
    are responses and the others revisit it; repeated rows of that id are responses. A
    null html is an empty payload; a null page_id is never the one referred to. Ids are
    written as 64-bit decimal numbers. An empty table writes no file.
    """
    spark = pages.sparkSession
    # the join has dealt the records by page already; they are not moved again
    planned = plan_records(pages, min_bytes).sortWithinPartitions("page_id", "payload_digest", "url")
    planned = planned.withColumn("refers_to", F.col("refers_to").cast("string")).withColumn("page_id", F.col("page_id").cast("string"))
    planned = planned.select("page_id", "url", "payload", "payload_digest", "refers_to")
    manifest = planned.mapInPandas(_writer(folder, file_bytes), "file string, records long, bytes long")
    path = f"{folder.rstrip('/')}-manifest"
    manifest.write.parquet(path)
    return spark.read.schema("file string, records long, bytes long").parquet(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place in raw and where it ends; raises ValueError if a check fails."""
    if not raw.startswith(VERSION, at):
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header does not end")
    h = _headers(raw[at:end])
    try:
        length = int(h["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    block, tail = raw[end + 4 : end + 4 + length], raw[end + 4 + length : end + 8 + length]
    if length < 0 or len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("content length does not fit")
    kind = h.get("warc-type", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    rec = {"page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "refers_to": _page(h.get("warc-refers-to")), "payload": None}
    if kind == "response":
        _, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no HTTP header")
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
        rec |= {"payload": payload, "payload_bytes": len(payload)}
    else:
        size = h.get("warc-payload-length", "")
        rec["payload_bytes"] = int(size) if size.isdigit() else None
    return rec, end + 8 + length


def _inflate(data: bytes, at: int, step: int, stop: int) -> tuple[list[bytes], int, int, str | None]:
    """(content, end of the last piece that was read, end of the member, error) of the gzip member at a place.

    Pieces of step bytes are read, and from stop on single bytes.
    """
    z, view, raw, end = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not z.eof and end < len(data):
            piece = view[end : end + (step if end < stop else 1)]
            raw.append(z.decompress(piece))
            end += len(piece)
    except zlib.error as e:
        return raw, end, end, f"gzip: {e}"
    return raw, end, end - len(z.unused_data), None if z.eof else "gzip: cut short"


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at a place, where it ends, and the error that ended it before.

    Content before an error is returned up to the byte that the error was found at.
    """
    raw, last, end, error = _inflate(data, at, 1 << 16, len(data))
    if error and last < len(data):
        raw, _, end, error = _inflate(data, at, 1 << 16, last)
    return b"".join(raw), end, error


def _content(raw: bytes, error: str | None) -> tuple[list[tuple], str | None]:
    """Records and gaps of the content of a member, as (kind, record or reason), and the first failed check.

    The bytes up to a cut are as they were written. Where gzip fails another check and no
    record shows the damage, it is in the member's trailer or in a header, which no digest
    covers; the records are given, each marked as suspect in its reason.
    """
    found, p, gap, why, first, shown = [], 0, None, "", None, False
    while p < len(raw):
        try:
            rec, end = parse_record(raw, p)
        except ValueError as e:
            if gap is None:
                gap, why, first = p, str(e), first or str(e)
            shown = shown or raw.startswith(VERSION, p)
            p = raw.find(VERSION, p + 1)
            p = len(raw) if p < 0 else p
            continue
        if gap is not None:
            found.append(("gap", f"bytes {gap} to {p} of the member: {why}"))
            gap = None
        found.append(("record", rec))
        p = end
    if gap is not None or error:
        found.append(("gap", f"bytes {len(raw) if gap is None else gap} on of the member: {error or why}"))
    if error not in (None, "gzip: cut short") and not shown:
        found = [(kind, what | {"reason": f"suspect: {error}"} if kind == "record" else what) for kind, what in found]
    return found, error or first


def salvage(data: bytes):
    """Yield (kind, offset, length, record or reason) for the records and gaps of an archive.

    Works on gzip members and on plain records, also mixed. Bytes that belong to no
    valid record come back as gaps; together both cover the whole archive. Records and
    gaps inside a member have the place of the member; such a gap says in its reason
    which bytes of the content it is.
    """
    at, gap, why, n = 0, None, "", len(data)
    while at < n:
        try:
            if data.startswith(MAGIC, at):
                raw, end, error = _member(data, at)
                found, first = _content(raw, error)
                if not any(kind == "record" for kind, _ in found):
                    raise ValueError(first or "empty member")
                if error:  # where the member would have ended isn't known; if its trailer failed, that may be the start of the next
                    after = max(at + 1, end - 8) if " check" in error else at + 1
                    end = min((x for x in (data.find(MAGIC, after), data.find(VERSION, end)) if x >= 0), default=n)
            elif data.startswith(VERSION, at):
                rec, end = parse_record(data, at)
                found = [("record", rec)]
            else:
                raise ValueError("neither a member nor a version line")
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            nexts = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
            at = min(nexts, default=n)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why
            gap = None
        for kind, what in found:
            yield kind, at, end - at, what
        at = end
    if gap is not None:
        yield "gap", gap, n - gap, why


def _reader(with_payload: bool):
    cols = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def frame(rows):
        f = pd.DataFrame(rows, columns=cols, dtype=object)
        for c in ("page_id", "refers_to", "payload_bytes", "offset", "length"):
            f[c] = pd.array(f[c].tolist(), dtype="Int64")
        return f

    def read(frames):
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                rows, size = [], 0
                for kind, offset, length, what in salvage(bytes(content)):
                    base = {"path": path, "kind": kind, "offset": offset, "length": length, "reason": None if kind == "record" else what}
                    if kind == "record":
                        base |= what if with_payload else what | {"payload": None}
                        size += len(base["payload"] or b"")
                    rows.append([base.get(c) for c in cols])
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of all archives of a folder, one row each.

    kind is record or gap. A gap has its place, length and the reason of the first failed
    check. A record has a reason only if it is suspect: its own checks passed, but the
    member that it stands in failed one. A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInPandas(_reader(with_payload), RECORD_SCHEMA)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = make_folder(spark, scratch_path(spark, "warc"))
    write_warc(read_table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""
