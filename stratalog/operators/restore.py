"""Planning a restore: locations, offsets, read groups, links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Bytes between two blobs that are still read at once, and of a read at most.
MAX_GAP, MAX_READ = 256 << 10, 16 << 20


def file_offsets(refs: DataFrame) -> DataFrame:
    """Where each chunk begins in its file."""
    by = Window.partitionBy("snapshot_id", "item_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return refs.withColumn("file_offset", F.coalesce(F.sum("size").over(by), F.lit(0)).cast("long"))


def chunk_targets(refs: DataFrame) -> DataFrame:
    """How many places each chunk is written to, and its bytes in all."""
    return refs.groupBy("chunk_id").agg(F.count("*").alias("targets"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"))


def inconsistent_sizes(refs: DataFrame) -> DataFrame:
    """Chunks whose references disagree on their size."""
    return chunk_targets(refs).where("least <> most").select("chunk_id", "least", "most")


def fingerprints(refs: DataFrame) -> DataFrame:
    """A hash of each file's chunk ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x.chunk_id)
    return refs.groupBy("snapshot_id", "item_index").agg(F.sha2(F.array_join(ids, ""), 256).alias("fingerprint"), F.sum("size").alias("size"))


def hard_links(files: DataFrame) -> DataFrame:
    """Members of (dev, ino) groups: the first is written, the others are links where size and fingerprint equal its own, else copies. The first of each group is an aggregate, and the join with it can be split."""
    first = files.groupBy("dev", "ino").agg(F.min(F.struct("ordinal", "size", "fingerprint")).alias("_f"))
    same = (F.col("_f.size") == F.col("size")) & (F.col("_f.fingerprint") == F.col("fingerprint"))
    kind = F.when(F.col("_f.ordinal") == F.col("ordinal"), "primary").when(same, "link").otherwise("copy")
    return files.join(first, ["dev", "ino"]).withColumn("kind", kind).drop("_f")


def link_counts(linked: DataFrame) -> DataFrame:
    return linked.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def stats(items: DataFrame) -> DataFrame:
    k = F.col("entry_type")
    return items.agg(F.count_if(k == "file").alias("files"), F.count_if(k == "dir").alias("dirs"), F.count_if(k == "symlink").alias("symlinks"), F.sum(F.when(k == "file", F.col("size")).otherwise(0)).alias("bytes"))


def range_read(refs: DataFrame, start: int, length: int) -> DataFrame:
    """The part of each chunk that a read of every file's range needs, in order."""
    o = file_offsets(refs)
    low, high = F.greatest(F.col("file_offset"), F.lit(start)), F.least(F.col("file_offset") + F.col("size"), F.lit(start + length))
    return o.withColumn("chunk_start", low - F.col("file_offset")).withColumn("length", high - low).where("length > 0").select("snapshot_id", "item_index", "pos", "chunk_id", "chunk_start", "length")


def gap_groups(blobs: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Blobs of a pack numbered by reads that the gap alone decides."""
    by = Window.partitionBy("pack_id").orderBy("pack_offset")
    end = F.max(F.col("pack_offset") + F.col("stored_size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("pack_offset") - end > max_gap, F.lit(True))
    return blobs.withColumn("_new", new.cast("int")).withColumn("read_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def read_groups(blobs: DataFrame, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """(pack_id, read_start, read_end, blobs): blobs of a pack merged while the gap and the whole read stay in bounds.

    Where a read must end depends on where it began, so blobs are folded in order; a
    gap ends every read, so each gap group is folded by itself, as a stream of sorted
    rows of which only the open read is held.
    """
    rows = gap_groups(blobs, max_gap).select("pack_id", "read_group", F.col("pack_offset").cast("long").alias("s"), (F.col("pack_offset") + F.col("stored_size")).cast("long").alias("e"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, end, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for pack, g, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if (pack, g) == group and max(e, end) - start <= max_read:
                    end, n = max(e, end), n + 1
                    continue
                if group is not None:
                    out.append((group[0], start, end, n))
                group, start, end, n = (pack, g), s, e, 1
            yield reads(out)
        if group is not None:
            yield reads([(group[0], start, end, n)])

    def reads(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(4)], ["pack_id", "read_start", "read_end", "blobs"])

    return rows.sortWithinPartitions("pack_id", "s").mapInArrow(fold, "pack_id string, read_start bigint, read_end bigint, blobs bigint")


def segments(items: DataFrame, size: int = 64 << 20) -> DataFrame:
    """Ranges of large files, of a fixed size each; every file has one at least."""
    last = F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("long")
    return items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment")).withColumn("start", F.col("segment") * size).withColumn("length", F.least(F.col("size") - F.col("segment") * size, F.lit(size).cast("long")))


def segment_gaps(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that don't follow the one before."""
    by = Window.partitionBy(*keys).orderBy("segment")
    return parts.withColumn("_before", F.lag("segment").over(by)).where(F.col("segment") != F.coalesce(F.col("_before") + 1, F.lit(0))).drop("_before")


def deepest_first(items: DataFrame) -> DataFrame:
    """Directories in the order their metadata is set."""
    return items.where("entry_type = 'dir'").orderBy(F.desc(F.size(F.split("path", "/"))), "path")
