"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S


def side(items: DataFrame, snapshot_id: int, version: str = "content") -> DataFrame:
    """(path, size, version) of a snapshot's regular files; of a path that occurs twice, the last. The version is a hash, so that no contents are shuffled."""
    files = items.where((F.col("snapshot_id") == snapshot_id) & (F.col("entry_type") == "file"))
    own = files.select("path", "item_index", F.struct("size", F.sha2(F.col(version).cast("binary"), 256).alias("version")).alias("f"))
    return own.groupBy("path").agg(F.max_by("f", "item_index").alias("f")).select("path", "f.size", "f.version")


def diff(items: DataFrame, base: int, target: int, version: str = "content") -> DataFrame:
    """(path, change, old_size, new_size, delta) of files that were added, removed or modified: another size, or other chunks in order."""
    if base == target:
        raise ValueError("a snapshot can't be compared with itself")
    a = side(items, base, version).select("path", F.col("size").alias("old_size"), F.col("version").alias("_a"))
    b = side(items, target, version).select("path", F.col("size").alias("new_size"), F.col("version").alias("_b"))
    change = F.when(F.col("old_size").isNull(), "added").when(F.col("new_size").isNull(), "removed").when((F.col("old_size") != F.col("new_size")) | ~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    both = a.join(b, "path", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    zero = F.lit(0).cast("long")
    return both.select("path", "change", "old_size", "new_size", S.size_delta(F.coalesce("new_size", zero), F.coalesce("old_size", zero)).alias("delta"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("files"), F.sum("delta").alias("bytes"))


#: The order of changes in sorted views.
CHANGE_ORDER = {"added": 0, "removed": 1, "modified": 2}


def sort_rows(changes: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By any column; missing sizes come first, changes in their own order."""
    key = F.create_map(*(F.lit(x) for kv in CHANGE_ORDER.items() for x in kv))[F.col("change")] if column == "change" else F.col(column)
    return changes.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "path")
