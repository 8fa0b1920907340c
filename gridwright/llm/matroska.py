"""Media columns: Matroska files as binary values, and their packet tables.

``demux`` parses a file's EBML elements (variable-length ids and sizes, unknown
sizes included), tracks, clusters, blocks with any of the four kinds of lacing,
and cues. ``packet_table`` gives a row for each packet: track, timestamp, byte
range and key-frame flag. ``mux_pcm`` writes the files which the tests and the
registered query read: one 8-bit PCM track, laced frames, clusters and cues.

Every value is handled by itself in one narrow pass: no shuffle, and a batch is
cut by size, so that memory is bounded by the largest value.

Defined results: a null media value has no packets and status null; a value that
breaks off or isn't Matroska keeps the packets before the break and says why in
its status; null texts are stored as empty ones, very long ones whole; packets with
one timestamp keep their order in the file; equal values and repeated rows give equal
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import small_batches, table
from gridwright.llm.shingles import by_words

# Fixed values of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, BLOCK_GROUP, BLOCK, SIMPLE_BLOCK, TIMESTAMP = 0x1F43B675, 0xA0, 0xA1, 0xA3, 0xE7
CUES, CUE_POINT, CUE_POSITIONS, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB7, 0xB3, 0xF7, 0xF1
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
REFERENCE = 0xFB
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS})
XIPH, FIXED, EBML_LACING = 0x02, 0x04, 0x06

FRAME = 192  #: bytes, and samples, in a PCM packet
RATE = 8000  #: samples a second: a packet lasts 24 ms


def vint(value: int, width: int = 0) -> bytes:
    """value as an EBML variable-length size, in the fewest bytes or in ``width``."""
    n = width or 1
    while not width and value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """The head of a laced block's data: the number of frames, and their sizes."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACING:
        out = vint(sizes[0])
        for before, s in zip(sizes[:-2], sizes[1:-1]):
            n, d = 1, s - before
            while not -(1 << 7 * n - 1) < d < (1 << 7 * n - 1):
                n += 1
            out += vint(d + (1 << 7 * n - 1) - 1, n)
        return head + out
    return head


def mux_pcm(payload: bytes, lacing: int = EBML_LACING, per_block: int = 8, per_cluster: int = 256) -> bytes:
    """A Matroska file with payload, a multiple of FRAME bytes, as 8-bit mono samples."""
    n = len(payload) // FRAME
    ms = FRAME * 1000 // RATE
    info = _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(n * ms))) + element(MUXING_APP, b"gridwright") + element(WRITING_APP, b"gridwright")
    audio = element(SAMPLING, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, ms * 1_000_000) + element(AUDIO, audio)
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for first in range(0, n, per_cluster):
        body = [_uint(TIMESTAMP, first * ms)]
        for b in range(first, min(n, first + per_cluster), per_block):
            frames = [payload[i * FRAME : (i + 1) * FRAME] for i in range(b, min(n, first + per_cluster, b + per_block))]
            kind = lacing if len(frames) > 1 else 0
            head = b"\x81" + struct.pack(">hB", (b - first) * ms, 0x80 | kind) + (_lace(frames, kind) if kind else b"")
            body.append(element(SIMPLE_BLOCK, head + b"".join(frames)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Demuxed:
    """What a file holds. packets: track, timestamp in ns, offset, size, key frame."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  #: ns, track, cluster's offset in the file
    clusters: list[int] = field(default_factory=list)  #: offsets in the file
    duration_ns: float | None = None
    status: str = "ok"


class _Broken(Exception):
    pass


def _read_vint(data: bytes, at: int, marker: bool, most: int = 8) -> tuple[int | None, int]:
    """The number at ``at`` and where it ends; None for an unknown size."""
    if at >= len(data):
        raise _Broken(f"truncated at byte {at}")
    n = 9 - data[at].bit_length()
    if n > most or at + n > len(data):
        raise _Broken(f"bad variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Offsets and sizes of a block's frames."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise _Broken(f"empty lace at byte {at}")
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise _Broken(f"uneven lace at byte {at}")
        size = (end - at) // n
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise _Broken(f"truncated lace at byte {at}")
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at = _read_vint(data, at, False)
            if value is None:
                raise _Broken(f"unknown frame size at byte {start}")
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise _Broken(f"lace is longer than its block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Demuxed:
    """Parse one file. A master element is entered, any other is read or skipped,
    so elements of unknown size need no special end."""
    out, at, scale, cluster, base = Demuxed(), 0, 1_000_000, 0, None
    track: dict = {}
    cue: dict = {}
    group_from = 0
    spans: list[tuple[int, int, int, int]] = []  # cues before their base is known
    try:
        while at < len(data):
            start = at
            ident, at = _read_vint(data, at, True, 4)
            size, at = _read_vint(data, at, False)
            if start == 0 and ident != EBML:
                raise _Broken("no EBML header")
            if ident in MASTERS:
                if ident == SEGMENT:
                    base = at
                elif ident == CLUSTER:
                    out.clusters.append(start)
                    cluster = 0
                elif ident == TRACK_ENTRY:
                    track = {}
                elif ident == CUE_POINT:
                    cue = {}
                elif ident == BLOCK_GROUP:
                    group_from = len(out.packets)
                continue
            if size is None:
                raise _Broken(f"unknown size of element {ident:x} at byte {start}")
            end = at + size
            if end > len(data):
                raise _Broken(f"element {ident:x} at byte {start} breaks off")
            if ident in (SIMPLE_BLOCK, BLOCK):
                number, p = _read_vint(data, at, False)
                if p + 3 > end:
                    raise _Broken(f"short block at byte {start}")
                relative, flags = struct.unpack_from(">hB", data, p)
                time = (cluster + relative) * scale
                step = out.tracks.get(number, {}).get("default_duration_ns", 0)
                key = bool(flags & 0x80) if ident == SIMPLE_BLOCK else True
                out.packets += [(number, time + i * step, o, n, key) for i, (o, n) in enumerate(_laced(data, p + 3, end, flags & 0x06))]
            elif ident == REFERENCE:
                out.packets[group_from:] = [(*p[:4], False) for p in out.packets[group_from:]]
            elif ident == CODEC:
                track["codec"] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
            elif ident in (DURATION, SAMPLING) and size in (4, 8):
                value = struct.unpack(">f" if size == 4 else ">d", data[at:end])[0]
                if ident == DURATION:
                    out.duration_ns = value * scale
                else:
                    track["sampling_rate"] = value
            elif size <= 8:
                value = int.from_bytes(data[at:end], "big")
                if ident == TIMESTAMP:
                    cluster = value
                elif ident == TIMESTAMP_SCALE:
                    scale = value
                elif ident == TRACK_NUMBER:
                    out.tracks[value] = track
                elif ident == DEFAULT_DURATION:
                    track["default_duration_ns"] = value
                elif ident == TRACK_TYPE:
                    track["type"] = value
                elif ident == CHANNELS:
                    track["channels"] = value
                elif ident == BIT_DEPTH:
                    track["bits"] = value
                elif ident == CUE_TIME:
                    cue["time"] = value
                elif ident == CUE_TRACK:
                    cue["track"] = value
                elif ident == CUE_CLUSTER:
                    spans.append((cue.get("time", 0), cue.get("track", 0), value, scale))
            at = end
    except _Broken as e:
        out.status = str(e)
    out.cues = [(t * s, k, p + (base or 0)) for t, k, p, s in spans]
    return out


def _padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % FRAME or (0 if raw else FRAME)), len(raw)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: int = EBML_LACING) -> DataFrame:
    """id, media (a Matroska file of the text's bytes, spaces appended up to a
    positive multiple of FRAME) and n_bytes (before that)."""

    def muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for part in by_words(texts):
                data = [_padded(t) for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(part.start, part.stop - part.start), pa.array([mux_pcm(p, lacing) for p, _ in data], pa.binary()), pa.array([n for _, n in data], pa.int64())],
                    [id_col, "media", "n_bytes"],
                )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(muxed, f"`{id_col}` {kind}, media binary, n_bytes long")


PACKETS = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())])


SAMPLES = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("sum", pa.int64()), ("crossings", pa.int64())])


def _signal(payload: bytes | None) -> dict | None:
    """Of a payload read as unsigned 8-bit samples; crossings are of the middle, 128."""
    if not payload:
        return None
    x = np.frombuffer(payload, dtype=np.uint8)
    above = x >= 128
    return {"low": int(x.min()), "high": int(x.max()), "sum": int(x.sum(dtype=np.int64)), "crossings": int(np.count_nonzero(above[1:] != above[:-1]))}


RESULTS = ("packets", "status", "clusters", "cues", "duration_ms", "payload", "samples")


def demuxed(media: DataFrame, media_col: str = "media", payload: bool = True) -> DataFrame:
    """media's columns with packets (array of structs), status, clusters, cues
    (how many point at a cluster), duration_ms and, if wanted, the payload: the
    bytes of all packets in file order, with a summary of them as 8-bit samples. Columns of media with
    these names are replaced."""
    more = "packets array<struct<track:int,timestamp_ns:long,offset:long,size:long,keyframe:boolean>>, status string, clusters int, cues int, duration_ms double, payload binary, samples struct<low:int,high:int,sum:long,crossings:long>"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, payloads, sound = [], [], []
            for m in batch.column(media_col).to_pylist():
                d = demux(m) if m is not None else Demuxed(status=None)
                found.append(d)
                payloads.append(b"".join([m[o : o + n] for _, _, o, n, _ in d.packets]) if payload and m is not None else None)
                heads = set(d.clusters)
                sound.append(sum(c[2] in heads for c in d.cues))
            flat = [p for d in found for p in d.packets]
            columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
            packets = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKETS)], fields=list(PACKETS))
            ends = pa.array(np.cumsum([0] + [len(d.packets) for d in found]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.ListArray.from_arrays(ends, packets),
                    pa.array([d.status for d in found], pa.string()),
                    pa.array([len(d.clusters) for d in found], pa.int32()),
                    pa.array(sound, pa.int32()),
                    pa.array([None if d.duration_ns is None else d.duration_ns / 1e6 for d in found], pa.float64()),
                    pa.array(payloads, pa.binary()),
                    pa.array([_signal(x) for x in payloads], SAMPLES),
                ],
                [*batch.schema.names, *RESULTS],
            )

    small_batches(media.sparkSession)
    media = media.drop(*[c for c in media.columns if c.lower() in RESULTS])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(parsed, f"{own}, {more}")


def packet_table(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each packet: id, packet (its number in the file), track,
    timestamp_ns, offset, size, keyframe."""
    files = demuxed(media.select(id_col, media_col), media_col, payload=False)
    return files.select(id_col, F.posexplode("packets").alias("packet", "p")).select(id_col, "packet", "p.*")


def op5_matroska(spark, sf_dir: str) -> DataFrame:
    files = demuxed(text_media(table(spark, sf_dir, "documents")))
    last = F.element_at("packets", -1)
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit(""))) for name, c in (
        ("status", F.col("status")),
        ("packets", F.size("packets")),
        ("clusters", F.col("clusters")),
        ("cues", F.col("cues")),
        ("ms", F.col("duration_ms").cast("long")),
        ("last_ns", last["timestamp_ns"]),
        ("bytes", F.expr("aggregate(packets, 0L, (a, p) -> a + p.size)")),
        ("keyframes", F.size(F.filter("packets", lambda p: p["keyframe"]))),
        ("low", F.col("samples.low")),
        ("high", F.col("samples.high")),
        ("sum", F.col("samples.sum")),
        ("crossings", F.col("samples.crossings")),
        ("tracks", F.size(F.array_distinct(F.transform("packets", lambda p: p["track"])))),
    )])
    return files.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
