"""Matroska media columns: texts stored as 8-bit PCM in Matroska files, and Matroska files parsed into
packet tables.

* ``mux(df)``: key, ``n_bytes``, ``media`` - a Matroska file whose one audio track (A_PCM/INT/LIT, 8 bit,
  mono, 8000 Hz) holds the payload; blocks use no, fixed-size, Xiph or EBML lacing in turn, clusters
  start every ``CLUSTER_FRAMES`` frames, and Cues point at each cluster.
* ``packets(df)``: one row per frame of a media column: key, track, timestamp_ms, keyframe, lacing,
  block, cluster, byte_start, byte_length, cue (is its cluster named in Cues).
* ``read_back(df)``: key, media size and hash, the payload joined from the byte ranges, its length and
  hashes, and a feature string of container and signal figures.

Parsing follows RFC 8794 (EBML) and RFC 9559 (Matroska): variable-length ids and sizes, unknown sizes for
Segment and Cluster, SimpleBlock and BlockGroup, all four lacings (later frames of a lace follow by the track's
default duration, if it has one), Void and CRC-32 skipped.

Defined cases: null or empty text is stored as 64 zero bytes; null media gives no packets and null
results in ``read_back``; bytes that are not Matroska give no packets, and ``read_back`` returns them with
``error`` set; a truncated file gives the frames that lie wholly inside it; repeated rows each give a row;
very long texts are one file of many clusters; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import pieces_of, table

# Element ids of RFC 9559.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

RATE, PAD = 8000, 64
#: Samples in a frame (64 ms), frames in a laced block, frames in a cluster (the 16-bit block timestamps allow 511).
FRAME, LACE, CLUSTER_FRAMES = 512, 8, 256
LACINGS = ("none", "xiph", "fixed", "ebml")


def size_of(n: int, width: int = 0) -> bytes:
    """An EBML data size; all ones is kept for "unknown"."""
    w = width or next(i for i in range(1, 9) if n < (1 << 7 * i) - 1)
    return ((1 << 7 * w) | n).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The body after a block's header for frames laced as ``LACINGS[kind]``."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            w = next(i for i in range(1, 9) if abs(d) < (1 << (7 * i - 1)) - 1)
            head += size_of(d + (1 << (7 * w - 1)) - 1, w)
    return head + b"".join(frames)


def blocks(frames: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first frame, lacing, frames): laces of LACE frames; fixed-size lacing only where sizes are equal."""
    for k, i in enumerate(range(0, len(frames), LACE)):
        part = frames[i : i + LACE]
        kind = 0 if len(part) == 1 else (1, 3, 2)[k % 3]
        if kind == 2 and len(part[-1]) != len(part[0]):
            kind = 3
        yield i, kind, part


def write(payload: bytes) -> bytes:
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"docintake") + element(WRITING_APP, b"docintake"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, len(frames), CLUSTER_FRAMES):
        parts = [uint(TIMESTAMP, c * ms)]
        for i, kind, part in blocks(frames[c : c + CLUSTER_FRAMES]):
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", i * ms, 0x80 | kind << 1) + laced(part, kind)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c * ms) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def vint(buf: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, next position, is it the reserved all-ones size) of a variable-length integer."""
    if at >= end or not buf[at]:
        raise ValueError(f"no EBML number at byte {at}")
    w = 9 - buf[at].bit_length()
    if at + w > end:
        raise ValueError(f"EBML number cut off at byte {at}")
    n = int.from_bytes(buf[at : at + w], "big")
    plain = n & ((1 << 7 * w) - 1)
    return (n if keep_marker else plain), at + w, plain == (1 << 7 * w) - 1


def elements(buf: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end); an unknown size reaches to ``end``."""
    while at < end:
        start = at
        ident, at, _ = vint(buf, at, end, True)
        n, at, unknown = vint(buf, at, end, False)
        stop = end if unknown else at + n
        yield ident, start, at, stop
        at = stop


def number(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def frame_ranges(buf: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose laced body is buf[at:end]."""
    if kind == 0:
        return [(at, end)]
    n, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            total = 0
            while True:
                x, at = buf[at], at + 1
                total += x
                if x < 255:
                    break
            sizes.append(total)
    elif kind == 3:
        for i in range(n - 1):
            v, to, _ = vint(buf, at, end, False)
            sizes.append(sizes[-1] + v - (1 << (7 * (to - at) - 1)) + 1 if i else v)
            at = to
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes exceed the block at byte {at}")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def parse(buf: bytes) -> tuple[dict, list[tuple]]:
    """(header figures, packets as (track, timestamp_ms, keyframe, lacing, block, cluster, start, length, cue))."""
    head: dict = {"doc_type": "", "codec": "", "rate": 0.0, "bits": 0, "duration": 0.0, "tracks": 0, "clusters": 0, "blocks": 0, "cues": 0, "error": None}
    packets: list[tuple] = []
    cue_at: set[int] = set()
    starts: list[int] = []
    scale, lasts, number_now = 1_000_000, {}, 0
    try:
        for ident, _, a, b in elements(buf, 0, len(buf)):
            if ident == EBML:
                for i, _, x, y in elements(buf, a, b):
                    if i == DOC_TYPE:
                        head["doc_type"] = bytes(buf[x:y]).decode("ascii", "replace")
            elif ident != SEGMENT:
                if not head["doc_type"]:
                    raise ValueError("not EBML")
            else:
                todo = [(a, min(b, len(buf)))]
                while todo:
                    at, end = todo.pop()
                    for i, start, x, y in elements(buf, at, end):
                        if i == INFO:
                            for j, _, p, q in elements(buf, x, y):
                                if j == TIMESTAMP_SCALE:
                                    scale = number(buf, p, q)
                                elif j == DURATION:
                                    head["duration"] = struct.unpack(">d" if q - p == 8 else ">f", buf[p:q])[0]
                        elif i == TRACKS:
                            for j, _, p, q in elements(buf, x, y):
                                if j == TRACK_ENTRY:
                                    head["tracks"] += 1
                                    for k, _, r, s in elements(buf, p, q):
                                        if k == TRACK_NUMBER:
                                            number_now = number(buf, r, s)
                                        elif k == DEFAULT_DURATION:
                                            lasts[number_now] = number(buf, r, s) / 1e6
                                        elif k == CODEC_ID:
                                            head["codec"] = bytes(buf[r:s]).decode("ascii", "replace")
                                        elif k == AUDIO:
                                            for m, _, t, u in elements(buf, r, s):
                                                if m == SAMPLING:
                                                    head["rate"] = struct.unpack(">d" if u - t == 8 else ">f", buf[t:u])[0]
                                                elif m == BIT_DEPTH:
                                                    head["bits"] = number(buf, t, u)
                        elif i == CUES:
                            for j, _, p, q in elements(buf, x, y):
                                if j == CUE_POINT:
                                    head["cues"] += 1
                                    for k, _, r, s in elements(buf, p, q):
                                        if k == CUE_TRACK_POSITIONS:
                                            cue_at.update(a + number(buf, t, u) for m, _, t, u in elements(buf, r, s) if m == CUE_CLUSTER_POSITION)
                        elif i == CLUSTER:
                            starts.append(start)
                            head["clusters"] += 1
                            base = 0
                            for j, _, p, q in elements(buf, x, min(y, len(buf))):
                                if j in (CLUSTER, CUES, INFO, TRACKS):  # the end of a cluster of unknown size
                                    todo.append((_, end))
                                    break
                                if j == TIMESTAMP:
                                    base = number(buf, p, q)
                                found = [(p, q, True)] if j == SIMPLE_BLOCK else [(r, s, False) for k, _, r, s in elements(buf, p, q) if k == BLOCK] if j == BLOCK_GROUP else []
                                for p, q, simple in found:
                                    if q > len(buf):
                                        raise ValueError("cut off")
                                    track, p, _ = vint(buf, p, q, False)
                                    rel, flags = struct.unpack(">hB", buf[p : p + 3])
                                    kind = flags >> 1 & 3
                                    for n, (r, s) in enumerate(frame_ranges(buf, p + 3, q, kind)):
                                        packets.append((track, (base + rel) * scale / 1e6 + n * lasts.get(track, 0.0), bool(flags & 0x80) or not simple, LACINGS[kind], head["blocks"], head["clusters"] - 1, r, s - r))
                                    head["blocks"] += 1
                            if todo:
                                break
        if not head["doc_type"]:
            raise ValueError("not EBML")
    except (ValueError, IndexError, struct.error) as e:
        head["error"] = str(e)
    return head, [(*p, starts[p[5]] in cue_at) for p in packets]


PACKET = "track bigint, timestamp_ms double, keyframe boolean, lacing string, block bigint, cluster bigint, byte_start bigint, byte_length bigint, cue boolean"


def mux(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for b in pieces_of(whole, "text", 8 << 20):
                n, media = [], []
                for x in b.column("text").cast(pa.binary()).to_pylist():
                    x = x or b""
                    n.append(len(x))
                    media.append(write(x + bytes(-len(x) % PAD or (0 if x else PAD))))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def packets(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    src = df.select(F.col(key).alias("key"), F.col(media).alias("media"))

    def run(batches):
        names = [x.split()[0] for x in PACKET.split(", ")]
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in PACKET.split(", ")]
        for b in batches:
            for i, m in enumerate(b.column("media").to_pylist()):
                rows = parse(m)[1] if m is not None else []
                for at in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[at : at + 10_000], strict=True))
                    keys = b.column("key").take(pa.array([i] * len(cols[0])))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["key", *names])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, {PACKET}").withColumnRenamed("key", key)


BACK = "media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, error string"


def describe(m: bytes | None) -> tuple:
    if m is None:
        return (None,) * 7
    head, rows = parse(m)
    payload = b"".join([m[r[6] : r[6] + r[7]] for r in rows])
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = max(len(x), 1)
    lacing = ",".join(f"{k}:{sum(r[3] == k for r in rows)}" for k in LACINGS)
    feature = f"{head['codec']};{head['rate']:.0f}Hz;{head['bits']}bit;{head['duration']:.0f}ms;tracks={head['tracks']};clusters={head['clusters']};blocks={head['blocks']};packets={len(rows)};cues={head['cues']};lacing={lacing};mean={x.sum() / n:.3f};energy={int((x * x).sum()) / n:.3f};crossings={int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())}"
    return len(m), hashlib.sha256(m).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), feature, head["error"]


def read_back(df: DataFrame, key: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    src = df.select(F.col(key).alias("key"), F.col(media).alias("media"), *(F.col(k) for k in keep))

    def run(batches):
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in BACK.split(", ")]
        for b in batches:
            cols = list(zip(*map(describe, b.column("media").to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("key"), *(b.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key", *keep, *(x.split()[0] for x in BACK.split(", "))])

    kept = "".join(f", {k} {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}{kept}, {BACK}").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(mux(table(spark, sf_dir, "documents")), keep=("n_bytes",)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
