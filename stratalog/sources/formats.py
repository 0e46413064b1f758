"""Bytes: content-defined chunks, keyed ids, pack files, compression, sealed objects.

What needs a hash or a scan that SQL lacks runs in Arrow batches; the rest are
Column expressions.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A pack file: magic, a version byte, then blobs, each after its little-endian 32-bit length.
MAGIC, VERSION = b"STRATPAK", 1
HEADER = MAGIC + bytes([VERSION])
#: Kinds of sealed objects by their first byte.
OBJECT_TYPES = ("config", "manifest", "snapshot_meta", "chunk_data", "chunk_index", "file_cache", "pending_index", "key", "lock")
#: Bytes that a compressed blob has beside its tag and data: the length, and a frame's own.
FRAME = 24
#: What decompression may give at most, by kind of data.
CAPS = {"data": 32 << 20, "metadata": 4 << 30}


@cache
def gear() -> np.ndarray:
    """The rolling hash's value of each byte: the first eight bytes of the MD5 of 64 copies of it."""
    return np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64).digest()[:8], "big") for b in range(256)], np.uint64)


def _mask(bits: int) -> np.uint64:
    """So many bits, spread over the upper 48."""
    return np.uint64(sum(1 << (16 + i * 48 // bits) for i in range(bits)))


def cut_points(data: bytes, low: int, average: int, high: int) -> list[int]:
    """Where content-defined chunks end: the hash of the last 64 bytes has certain bits zero, more of them before the average size than after it; no chunk is shorter than ``low`` (but the last) or longer than ``high``."""
    n = len(data)
    h = gear()[np.frombuffer(data, np.uint8)].copy()
    for s in (1, 2, 4, 8, 16, 32):  # h[i] becomes the sum of gear[data[i - k]] << k over the last 64 bytes
        h[s:] = h[s:] + (h[:-s] << np.uint64(s)) if s < n else h[s:]
    bits = average.bit_length() - 1
    strict, loose = np.flatnonzero((h & _mask(bits + 1)) == 0) + 1, np.flatnonzero((h & _mask(bits - 1)) == 0) + 1
    ends, at = [], 0
    while n - at > low:
        end = min(at + high, n)
        i = np.searchsorted(strict, at + low)
        j = np.searchsorted(loose, max(at + average, at + low))
        a = int(strict[i]) if i < len(strict) and strict[i] <= min(at + average, end) else None
        b = int(loose[j]) if j < len(loose) and loose[j] <= end else None
        at = a if a is not None else b if b is not None else end
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def check_chunker(low: int, average: int, high: int) -> tuple[int, int, int]:
    """The parameters, the greatest clamped to 16 MiB; raises where they aren't in order."""
    high = min(high, 16 << 20)
    if not 64 <= low <= average <= high:
        raise ValueError("chunk sizes must be in order, the least 64 bytes")
    return low, average, high


def chunk_files(df: DataFrame, key: bytes, low: int = 512, average: int = 2048, high: int = 8192, path: str = "path", content: str = "content") -> DataFrame:
    """(path, pos, offset, length, chunk_id): the chunks of each file, ids keyed by BLAKE2b."""
    low, average, high = check_chunker(low, average, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = c.as_py() or b""
                ends = cut_points(data, low, average, high)
                starts = [0, *ends[:-1]]
                if ends:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(ends)), pa.array(range(len(ends)), pa.int64()), pa.array(starts, pa.int64()), pa.array([j - i for i, j in zip(starts, ends)], pa.int64()), pa.array([hashlib.blake2b(data[i:j], key=key, digest_size=32).hexdigest() for i, j in zip(starts, ends)])],
                        ["path", "pos", "offset", "length", "chunk_id"],
                    )

    return df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, pos bigint, offset bigint, length bigint, chunk_id string")


def chunk_id(key: bytes):
    """A function of a binary column: the keyed BLAKE2b-256 of each value, as hexadecimal digits."""

    @F.pandas_udf("string")
    def f(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else hashlib.blake2b(bytes(b), key=key, digest_size=32).hexdigest())

    return f


def pack_id():
    return chunk_id(b"")


def write_pack(blobs: list[bytes]) -> tuple[str, bytes, list[int]]:
    """The id, the bytes and the blobs' offsets of a pack."""
    out, offsets = bytearray(HEADER), []
    for b in blobs:
        out += struct.pack("<I", len(b))
        offsets.append(len(out))
        out += b
    return hashlib.blake2b(bytes(out), digest_size=32).hexdigest(), bytes(out), offsets


def seal_packs(blobs: DataFrame) -> DataFrame:
    """(pack, pack_id, size, content) from (pack, seq, blob): packs assembled a group at a time; a group holds what fits a pack."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        id_, data, _ = write_pack([bytes(b) for b in g.sort_values("seq").blob])
        return pd.DataFrame({"pack": [g.pack.iloc[0]], "pack_id": [id_], "size": [len(data)], "content": [data]})

    return blobs.groupBy("pack").applyInPandas(one, "pack string, pack_id string, size bigint, content binary")


def scan_packs(packs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, seq, offset, length, error): the blobs of each pack, or what is wrong with it: header, or bytes left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = c.as_py() or b""
                if data[:9] != HEADER:
                    rows.append((p, None, None, None, "bad header"))
                    continue
                at, seq = 9, 0
                while at + 4 <= len(data):
                    (n,) = struct.unpack_from("<I", data, at)
                    if n == 0 or at + 4 + n > len(data):
                        break
                    rows.append((p, seq, at + 4, n, None))
                    at, seq = at + 4 + n, seq + 1
                if at != len(data):
                    rows.append((p, None, None, None, "trailing bytes"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i in (0, 4) else pa.int64()) for i in range(5)], ["path", "seq", "offset", "length", "error"])

    return packs.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, seq bigint, offset bigint, length bigint, error string")


def header_valid(content: Column) -> Column:
    return F.substring(content, 1, 9) == F.lit(HEADER)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a path as rows: path, modificationTime, length, content (read only where it is used)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def list_keys(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(key, size, modified) of the files below a path, by their names relative to it; contents aren't read."""
    files = read_files(spark, path, glob).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return files.select(F.substring("path", len(top) + 2, F.length("path")).alias("key"), "size", "modified")


def read_range(content: Column, start: int, length: int) -> Column:
    """A range of an object, null where it ends before that."""
    part = F.substring(content, start + 1, length)
    return F.when(F.length(part) == length, part)


def read_blobs(index: DataFrame, packs: DataFrame) -> DataFrame:
    """Each indexed chunk's bytes by range, with an error where the pack is too short."""
    blob = F.substring(F.col("content"), F.col("pack_offset").cast("int") + 1, F.col("stored_size").cast("int"))
    return index.join(packs.select("pack_id", "content"), "pack_id").select("chunk_id", blob.alias("blob"), (F.length(blob) != F.col("stored_size")).alias("short"))


def compress(codec: str):
    """A function of a binary column: a tag byte (0 none, 1 LZ4, 2 ZSTD), the length where needed, and the data."""
    tag = {"none": 0, "lz4": 1, "zstd": 2}[codec]

    @F.pandas_udf("binary")
    def f(data: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            b = bytes(b)
            if tag == 0:
                return b"\0" + b
            return bytes([tag]) + struct.pack("<Q", len(b)) + pa.Codec(codec).compress(b, asbytes=True)

        return data.map(one)

    return f


def decompress(cap: int = CAPS["data"]):
    """The inverse of compress(); null where the data is malformed or would be larger than the cap."""

    @F.pandas_udf("binary")
    def f(data: pd.Series) -> pd.Series:
        def one(b):
            if b is None or len(b) == 0:
                return None
            b = bytes(b)
            if b[0] == 0:
                return b[1:] if len(b) - 1 <= cap else None
            if b[0] not in (1, 2) or len(b) < 9:
                return None
            (n,) = struct.unpack_from("<Q", b, 1)
            if n > cap:
                return None
            try:
                return pa.Codec(("", "lz4", "zstd")[b[0]]).decompress(b[9:], n, asbytes=True)
            except (pa.ArrowInvalid, OSError):
                return None

        return data.map(one)

    return f


def seal(kind: str, content: Column, key: Column) -> Column:
    """A type byte and the data, encrypted by AES-GCM with the type as authenticated data."""
    tag = F.lit(bytes([OBJECT_TYPES.index(kind)]))
    return F.concat(tag, F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), tag))


def unseal(kind: str, sealed: Column, key: Column) -> Column:
    """The data, null where the type is another one or the seal doesn't hold."""
    tag = F.lit(bytes([OBJECT_TYPES.index(kind)]))
    return F.when((F.substring(sealed, 1, 1) == tag), F.try_aes_decrypt(F.substring(sealed, 2, 2147483647), key, F.lit("GCM"), F.lit("DEFAULT"), tag))


def object_type(sealed: Column) -> Column:
    """The name of an object's type, null for an unknown byte."""
    code = F.conv(F.hex(F.substring(sealed, 1, 1)), 16, 10).cast("int")
    return F.try_element_at(F.array(*(F.lit(t) for t in OBJECT_TYPES)), code + 1)
