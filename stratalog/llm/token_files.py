"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank (0: the most frequent id of all documents), so
that most take one byte. A block of ranks holds control bytes first, two bits a
rank for its length of 1 to 4 bytes, then the data bytes. Decoding looks the
lengths of four ranks up in a table by their control byte.

A shard file, little-endian::

    4 bytes  magic STK1
    u32      documents        u64  ids, end ids included
    i64[]    doc_id           u8[] 1 where doc_id is null       u32[] ids of each document
    blocks   u32 ids, u32 data bytes, control bytes, data bytes

Shards hold ascending ranges of doc_id (nulls first), as does each shard inside.
A task writes as many shards as its range fills, one at a time, so their number grows
with the ids while that of the tasks has a bound; the manifest is a table.
Null and empty texts have the end id only; repeated rows are written each;
an empty table makes no shard. A file appears under its name when it is whole,
so a task that runs again replaces equal bytes. Texts are encoded whole.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .arrow import slices, stored, two
from .tokens import word_bpe

MAGIC = b"STK1"
BLOCK = 1 << 18
#: Tasks that write at most.
TASKS = 50_000
#: Bytes of texts whose words are encoded together.
TOGETHER = 8 << 20
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_PLACE = np.arange(4, dtype=np.uint8)


def pack_ranks(r: np.ndarray) -> bytes:
    """Blocks of control and data bytes."""
    out = []
    for at in range(0, len(r), BLOCK):
        x = np.ascontiguousarray(r[at : at + BLOCK], "<u4")
        code = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
        four = np.zeros((-(-len(x) // 4), 4), np.uint8)
        four.reshape(-1)[: len(x)] = code
        control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
        data = x.view(np.uint8).reshape(-1, 4)[_PLACE <= code[:, None]]
        out += [struct.pack("<II", len(x), len(data)), control.tobytes(), data.tobytes()]
    return b"".join(out)


def unpack_ranks(buf: memoryview | bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(buf):
        n, size = struct.unpack_from("<II", buf, at)
        at += 8
        control = np.frombuffer(buf, np.uint8, -(-n // 4), at)
        at += len(control)
        length = LENGTHS[control].reshape(-1)[:n]
        x = np.zeros((n, 4), np.uint8)
        x[_PLACE < length[:, None]] = np.frombuffer(buf, np.uint8, size, at)
        at += size
        out.append(x.reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _place(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Write a file so that it appears under its name only when whole."""
    system, at = _place(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{posixpath.dirname(at)}/.{posixpath.basename(at)}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


def get(path: str) -> bytes:
    system, at = _place(path)
    with system.open_input_stream(at) as f:
        return f.read()


def packed_ids(df: DataFrame, make, id_col: str, text_col: str, extra: str = "", more=None, together: bool = False) -> DataFrame:
    """(doc_id, n, ids): ids as compressed 32-bit integers, for intermediate tables. ``more`` adds one column of the ids, of type ``extra``. What ``make`` gives encodes a text to bytes, or, ``together``, an Arrow array of texts to arrays."""
    schema = "doc_id bigint, n bigint, ids binary" + (f", {extra}" if extra else "")

    def ready():
        encode, z = make(), zstandard.ZstdCompressor(level=1)

        def f(ids, texts):
            small = encode(texts) if together else [np.frombuffer(encode(t), "<u4") for t in texts.to_pylist()]
            cols = [ids, pa.array([len(x) for x in small], pa.int64()), pa.array([z.compress(squeezed(x)) for x in small], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *([more(small)] if more else [])], ["doc_id", "n", "ids", *([extra.split()[0]] if extra else [])])

        return f

    def run(batches):
        f = ready()
        for batch in batches:
            for part in slices(batch, 1, *([TOGETHER] if together else [])):
                yield f(*part.columns)

    return two(df, id_col, text_col).mapInArrow(run, schema)


def squeezed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else four; the last byte says which."""
    return ids.astype("<u2").tobytes() + b"2" if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes() + b"4"


def unpacked(blob: bytes, z: zstandard.ZstdDecompressor) -> np.ndarray:
    """Inverse of packed_ids for one document."""
    data = z.decompress(blob)
    return np.frombuffer(memoryview(data)[:-1], "<u" + chr(data[-1])).astype("<u4")


def id_counts(encoded: DataFrame, vocabulary: int, documents: bool = False) -> np.ndarray:
    """How often each id occurs in all rows of packed_ids, or in how many documents. At most one row a task and id is shuffled, and one an id collected."""

    def run(batches):
        z, c, held, size = zstandard.ZstdDecompressor(), np.zeros(vocabulary, np.int64), [], 0

        def tally():
            return np.bincount(np.concatenate(held), minlength=vocabulary) if held else 0

        for batch in batches:
            for blob in batch.column(0):
                x = unpacked(blob.as_py(), z)
                held.append(np.unique(x) if documents else x)
                size += len(held[-1])
                if size > 1 << 20:
                    c += tally()
                    held, size = [], 0
        c += tally()
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["id", "c"])

    out = np.zeros(vocabulary, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id int, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[r.id] = r.c
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark takes it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write_token_files(df: DataFrame, vocab: str, out_dir: str, end_id: int = 2, shard_ids: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards of about ``shard_ids`` ids and the rank table; return the manifest, a stored table with a row a shard: (task, shard, path, documents, ids, first), first: ids of all shards before it."""
    end = np.uint32(end_id)
    spark = df.sparkSession
    out_dir = qualified(spark, out_dir)

    def make():
        bpe = word_bpe(vocab)
        return lambda texts: [np.append(x, end) for x in bpe.encode_all(texts)]

    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(vocab).get_vocab_size(with_added_tokens=True), end_id + 1)
    encoded = stored(packed_ids(df, make, id_col, text_col, together=True), "token-ids")
    counts = id_counts(encoded, size)
    by_rank = np.lexsort((np.arange(size), -counts)).astype("<u4")
    rank = np.empty(size, "<u4")
    rank[by_rank] = np.arange(size, dtype="<u4")
    put(f"{out_dir}/ranks.u32", by_rank.tobytes())
    tasks = min(TASKS, max(1, -(-int(counts.sum()) // shard_ids)))

    def write(batches):
        z, docs, null, n, parts, total, made = zstandard.ZstdDecompressor(), [], [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def shard():
            f = io.BytesIO()
            f.write(MAGIC + struct.pack("<IQ", len(docs), total))
            f.write(np.array(docs, "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(n, "<u4").tobytes())
            f.write(pack_ranks(np.concatenate(parts)))
            path = f"{out_dir}/shard-{task:05d}-{made:05d}.stk"
            put(path, f.getvalue())
            row = ((task, pa.int64()), (made, pa.int64()), (path, pa.string()), (len(docs), pa.int64()), (total, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], ["task", "shard", "path", "documents", "ids"])

        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                x = unpacked(blob.as_py(), z)
                docs.append(i or 0)
                null.append(i is None)
                n.append(len(x))
                parts.append(rank[x].astype("<u4"))
                total += len(x)
                if total >= 2 * shard_ids:  # ranges are sampled, so they may hold somewhat more than a shard
                    yield shard()
                    docs, null, n, parts, total, made = [], [], [], [], 0, made + 1
        if docs:
            yield shard()

    dealt = encoded.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "ids")
    shards = stored(dealt.mapInArrow(write, "task bigint, shard bigint, path string, documents bigint, ids bigint"), "token-shards")
    first, before = 0, []
    for r in shards.groupBy("task").agg(F.sum("ids").alias("ids")).orderBy("task").collect():  # TASKS rows at most
        before.append((r.task, first))
        first += r.ids
    tasks_first = spark.createDataFrame(before, "task bigint, before bigint")
    by = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("ids").over(by), F.lit(0))
    return shards.join(F.broadcast(tasks_first), "task").withColumn("first", F.col("before") + own).drop("before")


def read_shard(path: str, by_rank: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and all ids of a shard."""
    buf = get(path)
    if buf[:4] != MAGIC:
        raise ValueError(f"{path} is no token file")
    docs, total = struct.unpack_from("<IQ", buf, 4)
    at = 16
    ids, null, n = np.frombuffer(buf, "<i8", docs, at), np.frombuffer(buf, np.uint8, docs, at + 8 * docs), np.frombuffer(buf, "<u4", docs, at + 9 * docs)
    tokens = by_rank[unpack_ranks(memoryview(buf)[at + 13 * docs :])]
    if len(tokens) != total or int(n.sum()) != total:
        raise ValueError(f"{path} is damaged")
    return [None if z else int(i) for i, z in zip(ids, null)], n.astype(np.int64), tokens


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: ids as little-endian unsigned 32-bit integers, start: ids of all documents before it."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    out_dir = qualified(spark, out_dir)

    def run(batches):
        by_rank = np.frombuffer(get(f"{out_dir}/ranks.u32"), "<u4")
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, n, tokens = read_shard(path, by_rank)
                ends = np.cumsum(n)
                for k in range(0, len(docs), 2000):
                    m = slice(k, k + 2000)
                    e = ends[m]
                    base = int(e[0] - n[k])
                    blob = pa.py_buffer(np.ascontiguousarray(tokens[base : int(e[-1])], "<u4").tobytes())
                    offsets = pa.py_buffer(((np.r_[base, e] - base) * 4).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(docs[m], pa.int64()), pa.array(first + e - n[m]), pa.array(n[m]), pa.Array.from_buffers(pa.binary(), len(e), [None, offsets, blob])], ["doc_id", "start", "n_tokens", "ids"])

    tasks = min(TASKS, max(1, manifest.count()))
    return manifest.select("path", "first").repartition(tasks, "path").mapInArrow(run, schema)
