import hashlib
import random
import struct
import zlib

import pytest

from gridwright.llm import matroska as mk
from tests.llm.odd import collected


@pytest.mark.parametrize("lacing", [0, mk.XIPH, mk.FIXED, mk.EBML_LACING])
@pytest.mark.parametrize("frames", [1, 2, 8, 9, 256, 257, 700])
def test_round_trip(lacing, frames):
    rng = random.Random(frames)
    payload = rng.randbytes(frames * mk.FRAME)
    media = mk.mux_pcm(payload, lacing, per_block=8 if lacing else 1)
    d = mk.demux(media)
    assert d.status == "ok"
    assert b"".join(media[o : o + n] for _, _, o, n, _ in d.packets) == payload
    assert [p[1] for p in d.packets] == [i * 24_000_000 for i in range(frames)]
    assert d.tracks[1]["codec"] == "A_PCM/INT/LIT" and d.tracks[1]["bits"] == 8 and d.duration_ns == frames * 24e6
    assert {c[2] for c in d.cues} == set(d.clusters) and len(d.cues) == len(d.clusters)


@pytest.mark.parametrize("lacing", [mk.XIPH, mk.EBML_LACING])
def test_frames_of_unequal_sizes(lacing):
    sizes = [0, 1, 254, 255, 256, 700, 3, 20_000, 5]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    block = b"\x81\x00\x00" + bytes([0x80 | lacing]) + mk._lace(frames, lacing) + b"".join(frames)
    d = mk.demux(mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk._uint(mk.TIMESTAMP, 7) + mk.element(mk.SIMPLE_BLOCK, block))))
    assert [p[3] for p in d.packets] == sizes and {p[1] for p in d.packets} == {7_000_000}


def test_unknown_sizes_groups_and_references():
    unknown = b"\x01" + b"\xff" * 7
    block = lambda t, x: mk.element(mk.BLOCK, b"\x82" + struct.pack(">hB", t, 0) + x)
    group = mk.element(mk.BLOCK_GROUP, block(-1, b"ab")) + mk.element(mk.BLOCK_GROUP, block(2, b"c") + mk.element(mk.REFERENCE, b"\x01"))
    data = mk.element(mk.EBML, b"") + bytes.fromhex("18538067") + unknown + bytes.fromhex("1f43b675") + unknown + mk._uint(mk.TIMESTAMP, 10) + group + bytes.fromhex("1f43b675") + unknown + mk._uint(mk.TIMESTAMP, 50) + mk.element(mk.SIMPLE_BLOCK, b"\x82\x00\x00\x00z")
    d = mk.demux(data)
    assert d.status == "ok" and len(d.clusters) == 2
    assert [(p[0], p[1] // 10**6, data[p[2] : p[2] + p[3]], p[4]) for p in d.packets] == [(2, 9, b"ab", True), (2, 12, b"c", False), (2, 50, b"z", False)]


def test_broken_files_say_so():
    whole = mk.mux_pcm(b"x" * mk.FRAME * 20)
    assert mk.demux(b"").status == "ok" and mk.demux(b"RIFF....").status != "ok"
    seen = set()
    for n in range(1, len(whole) - 1, 13):
        d = mk.demux(whole[:n])
        seen.add(len(d.packets))
        assert len(d.packets) <= 20
    assert seen >= {0, 8, 16}
    rng = random.Random(0)
    for _ in range(300):
        bad = bytearray(whole)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        mk.demux(bytes(bad))


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**28])
def test_vint(value):
    assert mk._read_vint(mk.vint(value), 0, False) == (value, len(mk.vint(value)))


def expected(text):
    raw = (text or "").encode()
    n = max(192, -(-len(raw) // 192) * 192)
    full = raw + b" " * (n - len(raw))
    return len(raw), n, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])


def test_query(spark, data, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = mk.op5_matroska(spark, data).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        assert by_text.setdefault(texts[r.doc_id], (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        assert hashlib.sha256(mk.mux_pcm(mk._padded(texts[r.doc_id])[0])).hexdigest() == r.media_sha256
        assert f"packets={r.payload_bytes // 192};" in r.feature


def test_odd_rows(odd, none, spark):
    media = mk.text_media(odd)
    files = mk.demuxed(media.withColumnRenamed("n_bytes", "packets"))
    assert files.count() == odd.count() and {r[0] for r in collected(files, "status")} == {"ok"}
    assert sorted(bytes(r[0]) for r in collected(files, "payload")) == sorted(mk._padded(t)[0] for (t,) in collected(odd, "text"))
    packets = mk.packet_table(media, "doc_id")
    assert packets.count() == sum(len(mk._padded(t)[0]) // 192 for (t,) in collected(odd, "text"))
    broken = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"")], "doc_id long, media binary")
    got = {r.doc_id: (r.status, len(r.packets)) for r in mk.demuxed(broken).collect()}
    assert got[1] == (None, 0) and got[2][0] != "ok" and got[3] == ("ok", 0)
    assert mk.packet_table(mk.text_media(none), "doc_id").count() == 0
