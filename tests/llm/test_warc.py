import gzip
import hashlib
import random

from quern.llm import warc


def rec(i, payload, ref=None):
    return warc.build_record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), ref)


def kinds(data):
    return [(k, what["page_id"] if k == "record" else (o, n)) for k, o, n, what in warc.salvage(data)]


def test_round_trip_of_whole_archive():
    data = rec(1, b"a" * 200) + rec(2, b"") + rec(3, b"a" * 200, 1)
    assert kinds(data) == [("record", 1), ("record", 2), ("record", 3)]
    assert kinds(gzip.decompress(data)) == [("record", 1), ("record", 2), ("record", 3)]
    assert kinds(b"") == []


def test_salvage_skips_damage_and_logs_gaps():
    a, b, c = rec(1, b"x" * 500), rec(2, bytes(range(256)) * 20), rec(3, b"z" * 300)
    for at in range(0, len(b), 7):
        broken = bytearray(b)
        broken[at] ^= 0x55
        got = kinds(a + bytes(broken) + c)
        assert got[0] == ("record", 1) and got[-1] == ("record", 3)
        gap, inner = ("gap", (len(a), len(b))), got[1:-1]
        # where only gzip's own check failed, the record is given too, as suspect
        assert inner in ([gap], [("record", 2)]) or (inner[0][0], inner[1:]) == ("record", [gap])
        suspect = [what["reason"] for k, _, _, what in warc.salvage(a + bytes(broken) + c) if k == "record" and what.get("reason")]
        assert len(suspect) == (len(inner) == 2)
    # the next member's bytes were taken for a trailer that is missing: nothing of the next is lost
    assert kinds(a + b[:-9] + c) == [("record", 1), ("record", 2), ("gap", (len(a), len(b) - 9)), ("record", 3)]
    assert kinds(a + b[:-40] + c) == [("record", 1), ("gap", (len(a), len(b) - 40)), ("record", 3)]
    assert kinds(b"junk" + a) == [("gap", (0, 4)), ("record", 1)]
    assert kinds(a + c[:20]) == [("record", 1), ("gap", (len(a), 20))]
    plain = gzip.decompress(b)
    assert kinds(gzip.decompress(a) + plain[: len(plain) // 2] + gzip.decompress(c)) == [("record", 1), ("gap", (len(gzip.decompress(a)), len(plain) // 2)), ("record", 3)]


def test_members_of_several_records():
    a, b, c = (gzip.decompress(rec(i, bytes([96 + i]) * 300)) for i in (1, 2, 3))
    spoiled = b.replace(b"bbb", b"bXb", 1)
    whole = gzip.compress(a + spoiled + c)
    place = (0, len(whole))
    assert kinds(whole + rec(4, b"d")) == [("record", 1), ("gap", place), ("record", 3), ("record", 4)]
    assert kinds(gzip.compress(b"junk" + a + c)) == [("gap", (0, len(gzip.compress(b"junk" + a + c)))), ("record", 1), ("record", 3)]
    reason = [what for k, _, _, what in warc.salvage(whole) if k == "gap"][0]
    assert f"bytes {len(a)} to {len(a) + len(b)} of the member" in reason and "digest" in reason


def test_one_member_cut_short_or_damaged():
    r = random.Random(3)
    plain = [gzip.decompress(rec(i, r.randbytes(3000))) for i in range(1, 41)]
    whole = gzip.compress(b"".join(plain))
    for end in (len(whole) // 2, len(whole) - 9):
        got = kinds(whole[:end])
        n = len(got) - 1
        assert got == [*(("record", i) for i in range(1, n + 1)), ("gap", (0, end))] and n >= 40 * end // len(whole) - 2
    spoiled = list(plain)
    spoiled[6] = spoiled[6][:-50] + bytes([spoiled[6][-50] ^ 1]) + spoiled[6][-49:]
    other = gzip.compress(b"".join(spoiled))
    bad_crc = other[:-8] + whole[-8:]
    got = list(warc.salvage(bad_crc + rec(50, b"z")))
    assert [what["page_id"] for k, _, _, what in got if k == "record"] == [i for i in [*range(1, 41), 50] if i != 7]
    assert sum(k == "gap" and "incorrect data check" in what for k, _, _, what in got) == 1
    # the damage is in no payload: the records are given as suspect, and the trailer as a gap
    for at in range(1, 9):
        bad_end = whole[:-at] + bytes([whole[-at] ^ 1]) + whole[len(whole) - at + 1 :]
        assert kinds(bad_end + rec(50, b"z")) == [*(("record", i) for i in range(1, 41)), ("gap", (0, len(bad_end))), ("record", 50)]
        reasons = [what.get("reason") for k, _, _, what in warc.salvage(bad_end + rec(50, b"z")) if k == "record"]
        assert all(x.startswith("suspect: gzip") and "incorrect" in x for x in reasons[:40]) and reasons[40] is None


def test_table_with_nulls_copies_and_small_payloads(spark, tmp_path):
    big = "é" * 80
    pages = spark.createDataFrame([(5, "u", big), (3, None, big), (9, "u\r\nX: y", big), (None, "u", big), (1, "u", None), (2, "u", ""), (7, "s", "same"), (8, "s", "same"), (3, None, big)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    man = warc.write_warc(pages, folder, file_bytes=300)
    assert man.selectExpr("sum(records)").first()[0] == 9
    rows = warc.read_warc(spark, folder, with_payload=True).collect()
    assert len(rows) == 9 and all(r.kind == "record" for r in rows)
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to or 0, r.payload_bytes, bytes(r.payload or b"")) for r in rows)
    b = big.encode()
    assert got == [(-1, "revisit", 3, 160, b""), (1, "response", 0, 0, b""), (2, "response", 0, 0, b""), (3, "response", 0, 160, b), (3, "response", 0, 160, b), (5, "revisit", 3, 160, b""), (7, "response", 0, 4, b"same"), (8, "response", 0, 4, b"same"), (9, "revisit", 3, 160, b"")]
    assert {r.payload_digest for r in rows if r.payload_bytes == 160} == {hashlib.sha256(b).hexdigest()}


def test_damaged_file_is_read_on(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    x, y = rec(1, b"p" * 400), rec(2, b"q" * 400)
    (d / "one.warc.gz").write_bytes(x[:30] + b"\0\0\0" + x[33:] + y)
    rows = {r.kind: r for r in warc.read_warc(spark, f"file://{d}").collect()}
    assert rows["record"].page_id == 2 and rows["gap"].length == len(x) and rows["gap"].reason


def test_empty_table(spark, tmp_path):
    (tmp_path / "w").mkdir()
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string, payload int"), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0
