import hashlib
import random
import zlib

import pytest

from feldspark.llm import matroska as M


def frames(data):
    return [data[p.start : p.end] for p in M.parse(data).packets]


@pytest.mark.parametrize("lacing", [None, 1, 2, 3])
def test_round_trip(lacing):
    rnd = random.Random(1)
    for n in (1, 576, 5760, 576 * 128, 576 * 300):
        payload = bytes(rnd.randrange(256) for _ in range(n // 576 * 576 or 576))
        assert b"".join(frames(M.mux(payload, lacing))) == payload


@pytest.mark.parametrize("lacing", [1, 3])
def test_uneven_lacing(lacing):
    own = [b"a" * k for k in (0, 1, 254, 255, 256, 700, 3, 90000, 2)]
    body = M.element(M.TIME, 100) + M.element(M.SIMPLE, b"\x81\x00\x05" + bytes([0x80 | lacing << 1]) + M.lace(own, lacing))
    data = M.element(M.SEGMENT, M.element(M.CLUSTER, body))
    assert frames(data) == own
    assert {p.timestamp for p in M.parse(data).packets} == {105} and all(p.keyframe for p in M.parse(data).packets)


def test_unknown_sizes_groups_and_negative_offsets():
    unknown = lambda kind, body: kind.to_bytes((kind.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7 + body
    block = b"\x82" + (-3).to_bytes(2, "big", signed=True) + b"\x00" + b"xyz"
    group = M.element(M.GROUP, M.element(M.BLOCK, block) + M.element(M.LENGTH, 40) + M.element(0xFB, 1))
    one = unknown(M.CLUSTER, M.element(M.TIME, 10) + group)
    two = unknown(M.CLUSTER, M.element(M.TIME, 20) + M.element(0xEC, b"void") + M.element(M.SIMPLE, b"\x81\x00\x00\x00" + b"k"))
    media = M.parse(unknown(M.SEGMENT, M.element(M.INFO, M.element(M.SCALE, 1000)) + one + two))
    assert [(p.track, p.timestamp, p.keyframe) for p in media.packets] == [(2, 7, False), (1, 20, False)]
    assert media.clusters == 2 and media.scale == 1000


def test_cues_point_at_clusters():
    data = M.mux(bytes(576 * 1000))
    media = M.parse(data)
    assert media.clusters == len(media.cues) == 8 and media.doctype == "matroska" and media.tracks == {1: "A_PCM/INT/LIT"}
    assert all(data[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in media.cues)
    assert [p.timestamp for p in media.packets] == [k * M.TICKS for k in range(1000)]


@pytest.mark.parametrize("bad", [b"\x00", b"\x1a\x45\xdf\xa3\x85ab", M.mux(bytes(576))[:-10], M.element(M.SEGMENT, M.element(M.INFO, b"\x44\x89\x83abc")), M.element(M.SEGMENT, M.element(M.INFO, M.element(M.SCALE, 0))), M.element(M.SEGMENT, M.element(M.CLUSTER, b"\xe7\x89" + b"\xff" * 9)), b"\x18\x53\x80\x67\x84\x1f\x43\xb6\x75"])
def test_broken_files(bad):
    with pytest.raises(ValueError):
        M.parse(bad)


def test_texts(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "x" * 576), (5, "é" * 40000), (5, "é" * 40000)]
    got = M.store_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert M.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(M.mux(bytes(576 * 3))), "a"), (2, None, "b"), (3, bytearray(b"\x00"), "c")], "id long, media binary, lacing string")
    got = M.packet_table(df).orderBy("id", "packet").collect()
    assert [(r["id"], r["packet"], r["timestamp"]) for r in got] == [(1, 0, 0), (1, 1, 72), (1, 2, 144), (2, None, None), (3, None, None)]
    assert got[3]["reason"] == "empty" and got[4]["reason"] and got[0]["lacing"] == "fixed"
    assert M.packet_table(M.with_media(spark.createDataFrame([("hello",)], "text string"))).count() == 1


def test_bytes_written_by_hand():
    """A file byte by byte from the format's description, with its own examples of lacing: frames of 800, 500 and 1000 bytes."""
    body = bytes([1]) * 800 + bytes([2]) * 500 + bytes([3]) * 1000
    for flags, sizes in (("02", "02 ff ff ff 23 ff f5"), ("06", "02 43 20 5e d3")):
        block = bytes.fromhex(f"81 00 07 {flags} {sizes}") + body
        cluster = bytes.fromhex("e7 81 64") + bytes.fromhex("a3") + (0x4000 | len(block)).to_bytes(2, "big") + block
        segment = bytes.fromhex("1654ae6b 8c ae 8a d7 81 01 86 85") + b"V_VP9" + bytes.fromhex("1f43b675") + (0x4000 | len(cluster)).to_bytes(2, "big") + cluster
        data = bytes.fromhex("1a45dfa3 87 4282 84") + b"webm" + bytes.fromhex("18538067 01ffffffffffffff") + segment
        media = M.parse(data)
        assert (media.doctype, media.tracks, media.clusters) == ("webm", {1: "V_VP9"}, 1)
        assert [data[p.start : p.end] for p in media.packets] == [body[:800], body[800:1300], body[1300:]]
        assert {(p.track, p.timestamp, p.keyframe) for p in media.packets} == {(1, 107, False)}


def test_spoiled_files_give_packets_or_a_reason():
    rnd = random.Random(6)
    whole = M.mux(bytes(rnd.randrange(256) for _ in range(576 * 20)))
    kinds = set()
    for trial in range(3000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.randrange(200 if trial % 2 else len(data))] = rnd.randrange(256)
        if trial % 5 == 0:
            del data[rnd.randrange(len(data)) :]
        rows = M.packet_rows(bytes(data))[1]
        kinds.add(rows[0][0] is None)
        assert rows and all(-(1 << 63) <= x < 1 << 63 for r in rows for x in r[1:] if isinstance(x, int))
    assert kinds == {True, False}


def test_files_are_stored_and_read_again(spark):
    df = spark.createDataFrame([(1, "abc", "z"), (1, "abc", "z")], "doc_id long, text string, media string")
    got = M.store_texts(df)
    assert "parquet" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in got.collect()] == [(1, 3, 576)] * 2
    assert "behind_cues=1;" in got.first()["feature"]
