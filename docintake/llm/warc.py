"""WARC records in seekable Zstandard bundles.

``tag(df)`` marks which pages repeat another's payload; ``bundle(df)`` writes WARC/1.1 records (response, or
revisit where the payload repeats) into bundles: records are grouped into independent Zstandard frames, a
seek table in a skippable frame stands at the end (the public "zstd seekable format"), and each bundle row
carries an index of record id -> (frame, offset in the frame, length). ``read_records`` reads every record
of bundles back; ``fetch`` reads the records of given ids only, unpacking just their frames.

Bundles are rows of a table (``bundle_id``, ``data``, ``index``), which Spark writes to any store; each task
makes its own, so a lost executor costs only its unwritten bundles.

Defined cases: null html is an empty payload; null url is an empty target; a null key gives a record whose
id ends in ``null`` and which is a response; repeated rows (equal key and payload) are all responses if their
key is the group's largest, else all revisits; equal payloads are found by SHA-256; a very long payload is one record, in a frame of its
own; an empty table gives no
bundles; other columns are ignored; a damaged bundle raises an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import stored, table

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Uncompressed bytes of a frame and of a bundle, about: a record is never split over frames.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:docintake:page:"

INDEX = "array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: object, url: str, payload: bytes | None, size: int, digest: str, refers_to: object | None) -> bytes:
    """One WARC record; ``payload`` None makes a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if payload is None else http + payload
    kind = ["WARC-Type: response"] if payload is not None else ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    key = "null" if key is None else key
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", *kind, f"WARC-Record-ID: <{ID}{key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    bare = lambda x: x.strip("<>").removeprefix(ID)
    revisit = f["warc-type"] == "revisit"
    digest = f["warc-payload-digest"].partition(":")[2]
    if not revisit:
        if len(payload) != size or (got := base32_sha1(payload)) != digest:
            raise ValueError(f"payload of {f['warc-record-id']} differs from its header")
        digest = got
    return {"record_id": bare(f["warc-record-id"]), "url": f["warc-target-uri"], "record_type": f["warc-type"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": bare(f["warc-refers-to"]) if revisit else None}


class Bundle:
    """A seekable Zstandard bundle being written."""

    def __init__(self, level: int = LEVEL):
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0

    def add(self, record_id: str, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((record_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        self.total += len(data)

    def flush(self) -> None:
        if self.open:
            frame = self.codec.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    width = 12 if flags & 0x80 else 8
    if magic != SEEKABLE_MAGIC or len(data) < 17 + n * width or struct.unpack("<I", data[-17 - n * width : -13 - n * width])[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - (n - i) * width)
        out.append((at, c, d))
        at += c
    return out


def frame(data: bytes, entry: tuple[int, int, int]) -> bytes:
    start, c, d = entry
    return zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=d)


def tag(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """key, url, html, size, sha1 (hex) and ``refers_to``: the largest key of an equal payload of at least
    ``min_bytes`` bytes, where that is another row's; html is null there, so it isn't written again.

    Only keys and hashes meet by payload; the groups with more than one row are written down first, so that
    a join partition with a hot payload can be split at run time. So are the rows that repeat another: by the size of
    that table the optimizer tells whether they can be sent to the pages, or pages and repeats must be shuffled."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("html"), F.octet_length(body).cast("bigint").alias("size"), F.sha2(body, 256).alias("same"))
    thin = rows.filter(F.col("size") >= min_bytes).select("key", "same")
    groups = stored(thin.groupBy("same").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "last"), "payload-groups")
    again = stored(thin.join(groups, "same").filter("key < last").select("key", "same", "last").distinct(), "payload-repeats")
    out = rows.join(again, ["key", "same"], "left")
    return out.select("key", "url", F.when(F.col("last").isNull(), F.col("html")).alias("html"), "size", F.sha1("html").alias("sha1"), F.col("last").alias("refers_to"))


def bundle(tagged: DataFrame, level: int = LEVEL) -> DataFrame:
    """Bundles of the rows that ``tag`` gives: bundle_id, data, index."""

    def run(batches):
        b = Bundle(level)

        def done():
            data = b.close()
            names = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in b.index]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([names], kind)], ["bundle_id", "data", "index"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                payload = None if r["refers_to"] is not None else r["html"].encode()
                b.add("null" if r["key"] is None else str(r["key"]), record(r["key"], r["url"], payload, r["size"], digest, r["refers_to"]))
                if b.total >= BUNDLE_BYTES:
                    yield done()
                    b = Bundle(level)
        if b.index:
            yield done()

    return tagged.mapInArrow(run, f"bundle_id string, data binary, index {INDEX}")


RECORD = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string()}


def _records(only_wanted: bool, with_payload: bool):
    names = [k for k in RECORD if with_payload or k != "payload"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                index = batch.column("index")[i].as_py()
                try:
                    frames = seek_table(data)
                    at, text, rows, size = -1, b"", [], 0
                    for x in index:
                        if x["frame"] != at:
                            at, text = x["frame"], frame(data, frames[x["frame"]])
                        rows.append(parse_record(text[x["offset"] : x["offset"] + x["length"]]))
                        size += x["length"]
                        if size > 4 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    yield _batch(rows, names)
                except (ValueError, KeyError, StopIteration, struct.error, zstandard.ZstdError) as e:
                    raise ValueError(f"bundle {batch.column('bundle_id')[i].as_py()}: {e}") from e

    return run, ", ".join(f"{k} {'binary' if k == 'payload' else 'bigint' if k == 'payload_bytes' else 'string'}" for k in names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], RECORD[k]) for k in names], names)


def read_records(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles, parsed, with response payloads held against their digests."""
    return bundles.select("bundle_id", "data", "index").mapInArrow(*_records(False, with_payload))


def fetch(bundles: DataFrame, ids: list[str]) -> DataFrame:
    """The records of the given ids: the index picks bundles and frames, and only those are unpacked."""
    want = F.filter("index", lambda x: x["record_id"].isin([str(i) for i in ids]))
    return bundles.select("bundle_id", "data", want.alias("index")).filter(F.size("index") > 0).mapInArrow(*_records(True, True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bundles = stored(bundle(tag(pages)), "warc")
    kind = pages.schema["page_id"].dataType
    back = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return read_records(bundles, with_payload=False).select(back("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))


#: DuckDB has no base32 function; five bits at a time come from the hexadecimal digest.
_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {}, 1)"
_BIT = "((strpos('0123456789abcdef', substr(h, {} // 4 + 1, 1)) - 1) >> (3 - {} % 4)) & 1"
_CHARS = " || ".join(_B32.format("(" + " + ".join(f"(({_BIT.format(5 * k + j, 5 * k + j)}) << {4 - j})" for j in range(5)) + ")") for k in range(32))
SQL = f"""
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM (SELECT page_id, octet_length(encode(b)) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last
      FROM (SELECT page_id, coalesce(html, '') AS b FROM pages) x) y
"""
