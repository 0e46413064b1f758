"""Sinks: objects as files, item streams, index generations, file caches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Directory of the items that commands' outputs become, and the modes of directories and files there.
DUMPS, DIR_MODE, FILE_MODE = "dumps", 0o755, 0o644


def dump_items(dumps: DataFrame) -> DataFrame:
    """(path, entry_type, size, mode): a directory, and a file for each (name, size); no directory where there are none."""
    files = dumps.select(F.concat(F.lit(f"{DUMPS}/"), "name").alias("path"), F.lit("file").alias("entry_type"), F.col("size").cast("long").alias("size"), F.lit(FILE_MODE).alias("mode"))
    top = dumps.limit(1).select(F.lit(DUMPS).alias("path"), F.lit("dir").alias("entry_type"), F.lit(0).cast("long").alias("size"), F.lit(DIR_MODE).alias("mode"))
    return top.unionByName(files)


def _pack(value: object) -> bytes:
    """A value in the MessagePack format: nil, integers, strings, arrays."""
    if value is None:
        return b"\xc0"
    if isinstance(value, int):
        return struct.pack(">Bq", 0xD3, value) if not 0 <= value < 128 else bytes([value])
    if isinstance(value, str):
        raw = value.encode()
        return struct.pack(">BI", 0xDB, len(raw)) + raw
    return struct.pack(">BI", 0xDD, len(value)) + b"".join(map(_pack, value))


def _unpack(data: memoryview, at: int) -> tuple[object, int]:
    """The value that begins at a place, and where the next begins: nil, booleans, integers, strings, bytes, arrays and maps."""
    tag = data[at]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag == 0xC0:
        return None, at
    if tag in (0xC2, 0xC3):
        return tag == 0xC3, at
    if 0xCC <= tag <= 0xD3:
        form = ">" + "BHIQbhiq"[tag - 0xCC]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if 0x80 <= tag < 0x90:
        kind, n = "map", tag & 15
    elif 0x90 <= tag < 0xA0:
        kind, n = "array", tag & 15
    elif 0xA0 <= tag < 0xC0:
        kind, n = "str", tag & 31
    else:
        kind, form = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}[tag]
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    if kind in ("str", "bin"):
        if at + n > len(data):
            raise ValueError("the stream ends inside a value")
        raw = bytes(data[at : at + n])
        return (raw.decode() if kind == "str" else raw), at + n
    out = []
    for _ in range(n * (2 if kind == "map" else 1)):
        value, at = _unpack(data, at)
        out.append(value)
    return (dict(zip(out[::2], out[1::2])) if kind == "map" else out), at


def encode_items(items: DataFrame, by: list[str]) -> DataFrame:
    """(*by, content): the items of each stream (item_index, path, entry_type, size), in order, one after another. A stream holds what a chunk of it does."""
    row = F.struct("item_index", "path", "entry_type", "size")
    rows = items.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    keys = [rows.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [b"".join(_pack([r["item_index"], r["path"], r["entry_type"], r["size"]]) for r in own) for own in b.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.array(content, pa.binary())], [*by, "content"])

    return rows.mapInArrow(run, ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in keys) + ", content binary")


def decode_items(streams: DataFrame, content: str = "content") -> DataFrame:
    """The items of each stream, with its other columns; a stream that ends inside a value is an error."""
    keys = [c for c in streams.columns if c != content]
    own = "item_index bigint, path string, entry_type string, size bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, c in enumerate(b.column(len(keys))):
                data, place = memoryview(c.as_py() or b""), 0
                while place < len(data):
                    row, place = _unpack(data, place)
                    at.append(i)
                    rows.append(row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*keys, "item_index", "path", "entry_type", "size"])

    return streams.select(*keys, content).mapInArrow(run, ", ".join(f"{k} {streams.schema[k].dataType.simpleString()}" for k in keys) + ", " + own)


def write_objects(objects: DataFrame, path: str) -> None:
    """Store (key, content) rows. Small objects lie many to a file, which a store of millions of them asks for; a file appears when it is whole."""
    objects.select("key", "content").repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def read_objects(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(key, content) of all objects, or of one, whose file is found by the keys' ranges."""
    rows = spark.read.parquet(path)
    return rows if key is None else rows.where(F.col("key") == key)


def write_index(index: DataFrame, path: str, generation: int) -> None:
    """The index of a generation, which counts once a snapshot of it does. Writing it again replaces it."""
    index.write.mode("overwrite").parquet(f"{path}/index/generation={generation}")


def commit(index: DataFrame, snapshot: DataFrame, path: str, generation: int) -> None:
    """Two steps: the index, then the snapshot, whose row is the commit. What comes between them leaves readers with the generation before."""
    write_index(index, path, generation)
    snapshot.withColumn("generation", F.lit(generation).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/snapshots")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The index of the last generation that has a snapshot."""
    last = spark.read.parquet(f"{path}/snapshots").agg(F.max("generation")).first()[0]
    return spark.read.parquet(f"{path}/index/generation={last}").withColumn("generation", F.lit(last).cast("long"))


def save_file_cache(rows: DataFrame, path: str) -> None:
    """A file cache by the roots of its sections."""
    rows.write.mode("overwrite").partitionBy("root").parquet(path)


def load_file_cache(spark: SparkSession, path: str, root: str) -> DataFrame:
    """One section; the others' files aren't read."""
    return spark.read.parquet(path).where(F.col("root") == root)
