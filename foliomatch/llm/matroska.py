"""Matroska media columns: EBML elements to packet tables, and lossless storage of byte payloads.

``elements`` walks variable-length EBML elements. ``parse`` reads tracks, clusters, simple blocks and
block groups with all lacings (none, Xiph, fixed size, EBML) and cues into a packet table: track,
timestamp, keyframe, byte range in the file, kind of lacing, cluster. ``mux`` stores bytes as one track
of unsigned 8-bit PCM samples, in laced blocks within clusters, with cues; equal bytes give equal files.

Scale: each row is handled by itself where it is read: one scan, no shuffle, memory for one file.

Defined cases: a null file has no packets; a file that ends inside an element gives the packets before
that place; elements of unknown size end with their parent; unknown elements are passed over. Repeated
rows give repeated packets; an empty table gives none; other columns are ignored. In op5 null text is
empty text, and a payload has at least 64 bytes. Ties: packets of equal time stay in the file's order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliomatch.llm.common import table

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
ENCODINGS, ENCODING, COMPRESSION, COMPRESSION_ALGORITHM, COMPRESSION_SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
HEADER_STRIPPING = 3
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS, ENCODINGS, ENCODING, COMPRESSION}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
LACINGS = ("none", "xiph", "fixed", "ebml")

RATE = 8000
FRAME = 1024
LACED = 8
CLUSTER_BLOCKS = 31


def vint(data: bytes, at: int) -> tuple[int, int, bool]:
    """Value, length and whether all value bits are set (unknown size) of a variable-length integer."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise IndexError(at)
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return value, n, value == (1 << 7 * n) - 1


def vint_bytes(value: int, least: int = 1) -> bytes:
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    """A difference of sizes in EBML lacing: biased by half the range."""
    n = 1
    while not -(1 << 7 * n - 1) < value < 1 << 7 * n - 1:
        n += 1
    return ((value + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint_bytes(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin of body, end of body) of the elements of a body, one level deep."""
    while at < end:
        n = 9 - data[at].bit_length()
        if n > 4 or at + n >= end:
            raise IndexError(at)
        ident = int.from_bytes(data[at : at + n], "big")
        size, m, unknown = vint(data, at + n)
        begin = at + n + m
        stop = _unknown_end(data, ident, begin, end) if unknown else begin + size
        if stop > end and ident not in PARENTS:
            raise IndexError(begin)
        yield ident, begin, min(stop, end)
        if stop > end:
            raise IndexError(begin)
        at = stop


def _unknown_end(data: bytes, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: a cluster before the next top-level element, else its parent's end."""
    if ident != CLUSTER:
        return end
    while at < end:
        n = 9 - data[at].bit_length()
        if n > 4 or int.from_bytes(data[at : at + n], "big") in TOP:
            return at
        try:
            size, m, _ = vint(data, at + n)
        except IndexError:
            return end
        at += n + m + size
    return end


@dataclass
class Packet:
    track: int
    timestamp: int
    keyframe: bool
    offset: int
    length: int
    lacing: str
    cluster: int
    header: bytes = b""


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    complete: bool = True

    def frame_time(self, track: int, frames: int, duration: int | None) -> float:
        """Of a laced block's frames, in the file's time units: the block's own duration or the track's."""
        if duration is not None:
            return duration / frames
        return self.tracks.get(track, {}).get("duration", 0) / self.scale


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if kind == 0:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            value, m, _ = vint(data, at)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * m - 1) - 1))
            at += m
    return [*sizes, end - at - sum(sizes)], at


def _block(data: bytes, begin: int, end: int, key: bool | None, base: int, cluster: int, media: Media, duration: int | None = None) -> None:
    """Packets of a block's frames; key None: a simple block, whose flags say whether it is a keyframe."""
    track, n, _ = vint(data, begin)
    time, flags = struct.unpack_from(">hB", data, begin + n)
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, begin + n + 3, end, kind)
    if end > len(data) or min(sizes) < 0:
        raise IndexError(begin)
    each, header = media.frame_time(track, len(sizes), duration), media.tracks.get(track, {}).get("header", b"")
    for i, size in enumerate(sizes):
        media.packets.append(Packet(track, base + time + round(i * each), bool(flags & 0x80) if key is None else key, at, size, LACINGS[kind], cluster, header))
        at += size


def _number(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def _encodings(data: bytes, begin: int, end: int) -> dict:
    """encoded: frames are stored in another form; header: the bytes that header stripping left off every frame."""
    found: dict = {}
    for ident, b, e in elements(data, begin, end):
        if ident != ENCODING:
            continue
        found["encoded"] = True
        for i, x, y in elements(data, b, e):
            if i == COMPRESSION:
                parts = {j: (u, v) for j, u, v in elements(data, x, y)}
                if _number(data, *parts.get(COMPRESSION_ALGORITHM, (0, 0))) == HEADER_STRIPPING:
                    found |= {"encoded": False, "header": data[slice(*parts.get(COMPRESSION_SETTINGS, (0, 0)))]}
    return found


def _track(data: bytes, begin: int, end: int) -> dict:
    found: dict = {}
    for ident, b, e in elements(data, begin, end):
        if ident == CODEC_ID:
            found["codec"] = data[b:e].decode("ascii", "replace")
        elif ident in (TRACK_NUMBER, TRACK_TYPE, TRACK_UID, DEFAULT_DURATION):
            found[{TRACK_NUMBER: "number", TRACK_TYPE: "type", TRACK_UID: "uid", DEFAULT_DURATION: "duration"}[ident]] = _number(data, b, e)
        elif ident == ENCODINGS:
            found |= _encodings(data, b, e)
        elif ident == AUDIO:
            for i, x, y in elements(data, b, e):
                if i == SAMPLING_FREQUENCY:
                    found["rate"] = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
                elif i in (CHANNELS, BIT_DEPTH):
                    found["channels" if i == CHANNELS else "bits"] = _number(data, x, y)
    return found


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a file. Frames of a laced block follow each other by the block's duration or the
    track's default duration; where neither is stated, all carry the block's timestamp."""
    media = Media()
    try:
        for ident, begin, end in elements(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            clusters = 0
            for i, b, e in elements(data, begin, end):
                if i == INFO:
                    for j, x, y in elements(data, b, e):
                        if j == TIMESTAMP_SCALE:
                            media.scale = _number(data, x, y)
                elif i == TRACKS:
                    for j, x, y in elements(data, b, e):
                        if j == TRACK_ENTRY and "number" in (found := _track(data, x, y)):
                            media.tracks[found["number"]] = found
                elif i == CLUSTER:
                    base = 0
                    for j, x, y in elements(data, b, e):
                        if j == TIMESTAMP:
                            base = _number(data, x, y)
                        elif j == SIMPLE_BLOCK:
                            _block(data, x, y, None, base, clusters, media)
                        elif j == BLOCK_GROUP:
                            parts = list(elements(data, x, y))
                            key = all(k != REFERENCE_BLOCK for k, _, _ in parts)
                            lasts = next((_number(data, u, v) for k, u, v in parts if k == BLOCK_DURATION), None)
                            for k, u, v in parts:
                                if k == BLOCK:
                                    _block(data, u, v, key, base, clusters, media, lasts)
                    clusters += 1
                elif i == CUES:
                    for j, x, y in elements(data, b, e):
                        if j != CUE_POINT:
                            continue
                        time, places = 0, []
                        for k, u, v in elements(data, x, y):
                            if k == CUE_TIME:
                                time = _number(data, u, v)
                            elif k == CUE_TRACK_POSITIONS:
                                got = {m: _number(data, r, s) for m, r, s in elements(data, u, v)}
                                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
                        media.cues += [(time, track, begin + place) for track, place in places]
    except (IndexError, struct.error):
        media.complete = False
    return media


def block_bytes(frames: list[bytes], time: int, kind: int | None = None, track: int = 1) -> bytes:
    """A simple block's body; kind None: no lacing for one frame, fixed for equal sizes, else EBML."""
    sizes = [len(f) for f in frames]
    if kind is None:
        kind = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = vint_bytes(track) + struct.pack(">hB", time, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint_bytes(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def _head(n: int) -> bytes:
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", n * 1000 / RATE)) + element(MUXING_APP, b"foliomatch") + element(WRITING_APP, b"foliomatch")
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    return element(INFO, info) + element(TRACKS, element(TRACK_ENTRY, track))


_EBML_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one track."""
    head = _head(len(payload))
    parts, cues, place = [head], [], len(head)
    step = FRAME * LACED
    for at in range(0, len(payload), step * CLUSTER_BLOCKS):
        base = at * 1000 // RATE
        body = [uint(TIMESTAMP, base)]
        for b in range(at, min(len(payload), at + step * CLUSTER_BLOCKS), step):
            frames = [payload[f : f + FRAME] for f in range(b, min(len(payload), b + step), FRAME)]
            body.append(element(SIMPLE_BLOCK, block_bytes(frames, b * 1000 // RATE - base)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _EBML_HEAD + element(SEGMENT, b"".join(parts))


def demux(data: bytes, track: int = 1) -> tuple[bytes, Media]:
    """A track's bytes in packet order, and what else the file holds."""
    media = parse(data)
    return b"".join(p.header + data[p.offset : p.offset + p.length] for p in media.packets if p.track == track), media


def feature(samples: bytes, media: Media) -> str:
    """What describes a track: packets, clusters, cues, milliseconds, and of the samples the mean, mean
    square about 128, sign changes about 128, and entropy of their histogram in millibits."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = max(1, len(x))
    centred = np.arange(256) - 128
    high = x >= 128
    p = counts[counts > 0] / n
    laced = sum(k.lacing != "none" for k in media.packets)
    clusters = media.packets[-1].cluster + 1 if media.packets else 0
    return (
        f"packets={len(media.packets)};laced={laced};clusters={clusters};cues={len(media.cues)};ms={len(x) * 1000 // RATE}"
        f";mean={int((counts * np.arange(256)).sum()) / n:.4f};power={int((counts * centred**2).sum()) / n:.4f}"
        f";crossings={int(np.count_nonzero(high[1:] != high[:-1]))};entropy={int(round(-1000 * float((p * np.log2(p)).sum())))}"
    )


PACKETS = "id long, track long, packet long, timestamp long, keyframe boolean, offset long, length long, lacing string, cluster long, header binary"


def packet_table(media: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """One row per packet of the files in a binary column. A packet is `header` (what header stripping left off every
    frame of its track, mostly nothing) and then the file's bytes from offset on. Frames that a track stores
    compressed or encrypted otherwise are given as stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("track", pa.int64()), ("packet", pa.int64()), ("timestamp", pa.int64()), ("keyframe", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64()), ("lacing", pa.string()), ("cluster", pa.int64()), ("header", pa.binary())])
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(ident, p.track, i, p.timestamp, p.keyframe, p.offset, p.length, p.lacing, p.cluster, p.header) for i, p in enumerate(parse(data.as_py() or b"").packets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 10, schema, strict=True)], schema=schema)

    return media.select(media[id_col].cast("long"), media[file_col]).mapInArrow(run, PACKETS)


OP5 = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: bytes) -> tuple:
    """Store a text's payload, read it back and describe it: all columns of op5 but the first."""
    payload = text + bytes(-len(text) % 64 or (0 if text else 64))
    media = mux(payload)
    back, found = demux(media)
    if back != payload:
        raise ValueError("the track doesn't hold the payload")
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, found),
    )


def op5_matroska(spark, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 512):
                rows = [stored(t.as_py() or b"") for t in texts.slice(at, 512)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), *columns], names=[c.split()[0] for c in OP5.split(", ")])

    docs = table(spark, sf_dir, "documents")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, OP5)
