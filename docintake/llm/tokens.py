"""Byte-level BPE encoding and decoding with tiktoken over a local rank file.

``encode(df)`` returns one row per input row: the key, ``n_tokens``, ``ids_le`` (token ids as
little-endian unsigned 32-bit integers) and ``decoded`` (the raw bytes that the ids decode to).

Defined cases: null text counts as the empty text (no ids, empty bytes); long texts are cut at safe
boundaries only (between a non-space and a white-space character, where no match of the splitting
pattern can reach across), so the ids equal those of the whole text; repeated rows each give a row;
an empty table gives an empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import pieces_of, table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Texts of more characters are encoded in parts of about this size.
PART_CHARS = 1 << 16
_BORDER = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Built once in each Python worker from the local rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut ``text`` at safe boundaries into parts of at least ``size`` characters (but the last)."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _BORDER.search(text, start + size)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= PART_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(x, disallowed_special=()) for x in safe_parts(text)])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(RANK_FILE)
    pattern = pattern or public_tokenizers.PATTERN
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        enc = encoding(path, pattern)
        for whole in batches:
            for b in pieces_of(whole, "text", 8 << 20):
                n, ids, back = [], [], []
                for x in b.column("text").to_pylist():
                    got = encode_text(enc, x or "")
                    n.append(len(got))
                    ids.append(got.astype("<u4").tobytes())
                    back.append(enc.decode_bytes(got.tolist()))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["key", "n_tokens", "ids_le", "decoded"])

    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_le binary, decoded binary")
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
