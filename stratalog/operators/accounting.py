"""Sizes, references and what deleting would free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def repository_info(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("snapshots"), F.max("time").alias("newest"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.sum("deduplicated_size").alias("deduplicated"))


def info_by_label(snapshots: DataFrame) -> DataFrame:
    """The totals by label and over all (label null)."""
    return snapshots.rollup("source_label").agg(F.count("*").alias("snapshots"), F.sum("original_size").alias("original"))


def index_info(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.sum("stored_size").alias("unique_bytes"), F.sum(F.col("stored_size") * F.col("refcount")).alias("referenced_bytes"), F.count_distinct("pack_id").alias("packs"))


def refcounts(refs: DataFrame) -> DataFrame:
    """One for each occurrence of a chunk."""
    return refs.groupBy("chunk_id").agg(F.count("*").alias("refcount"))


def snapshot_stats(refs: DataFrame) -> DataFrame:
    """Files and bytes by snapshot; a chunk's bytes count as deduplicated where it first occurs."""
    files = refs.groupBy("snapshot_id", "item_index").agg(F.sum("size").alias("size"))
    whole = files.groupBy("snapshot_id").agg(F.count("*").alias("nfiles"), F.sum("size").alias("original"))
    new = first_occurrence(refs).select("snapshot_id", F.col("new_bytes").alias("deduplicated"))
    return whole.join(new, "snapshot_id", "left").na.fill(0, ["deduplicated"])


def first_occurrence(refs: DataFrame) -> DataFrame:
    """The deduplicated bytes of each snapshot, by an aggregate that combines before the shuffle instead of a window, so a chunk that every file has costs a row a task."""
    where = F.min(F.struct("snapshot_id", "item_index", "pos")).alias("at")
    return refs.groupBy("chunk_id").agg(where, F.max("size").alias("size")).groupBy(F.col("at.snapshot_id").alias("snapshot_id")).agg(F.count("*").alias("new_chunks"), F.sum("size").alias("new_bytes"))


def delete_impact(refs: DataFrame, index: DataFrame, doomed: DataFrame) -> DataFrame:
    """What deleting snapshots in the given order (snapshot_id, place) frees with each: a chunk goes with the one whose references bring its count to zero.

    References are summed a snapshot and chunk before the window, so its groups
    have a row a deleted snapshot at most.
    """
    own = refs.join(doomed, "snapshot_id").groupBy("chunk_id", "snapshot_id", "place").agg(F.count("*").alias("n"))
    by = Window.partitionBy("chunk_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    gone = own.withColumn("total", F.sum("n").over(by)).join(index.select("chunk_id", "refcount", "stored_size"), "chunk_id")
    freed = (F.col("total") >= F.col("refcount")) & (F.col("total") - F.col("n") < F.col("refcount"))
    return gone.groupBy("snapshot_id", "place").agg(F.count_if(freed).alias("chunks_freed"), F.sum(F.when(freed, F.col("stored_size")).otherwise(F.lit(0).cast("long"))).alias("bytes_freed"))


def decrement(index: DataFrame, dropped: DataFrame) -> DataFrame:
    """The index after taking (chunk_id, n) references away; chunks at zero go."""
    left = F.greatest(F.col("refcount") - F.coalesce("n", F.lit(0)), F.lit(0))
    return index.join(dropped, "chunk_id", "left").withColumn("refcount", left).where("refcount > 0").select(*index.columns)


def rebuild_refcounts(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The index with counts of the references there are; chunks without any go."""
    return index.drop("refcount").join(refcounts(refs), "chunk_id").select(*index.columns)


def cache_hits(files: DataFrame, *by: str) -> DataFrame:
    """Files, original, compressed and deduplicated bytes; a file taken from the cache (``hit``) adds none of the last."""
    new = F.when(F.col("hit"), 0).otherwise(F.col("size"))
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").alias("original"), F.sum("stored").alias("compressed"), F.sum(new).alias("deduplicated"))


def delete_names(names: DataFrame) -> DataFrame:
    """Each requested name once, at its first place."""
    return names.groupBy("name").agg(F.min("ordinal").alias("ordinal"))


def quota(requests: DataFrame, committed: Column, limit: Column, part: Column) -> DataFrame:
    """Which requests, in order a repository, stay within its quota with all before them. ``part`` cuts the order into ranges (it never falls along it, null is the last): sums of ranges come first, so that no task has a repository's whole history. Null repositories are one; null bytes add nothing, and before any others nothing is known."""
    r = requests.withColumn("_p", part)
    sums = r.groupBy("repo", "_p").agg(F.sum("bytes").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("repo").orderBy(F.asc_nulls_last("_p")).rowsBetween(Window.unboundedPreceding, -1))
    by = Window.partitionBy("repo", "_p").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    own = r.withColumn("_o", F.sum("bytes").over(by))
    sums = sums.select(F.col("repo").alias("_r"), F.col("_p").alias("_q"), before.alias("_b"))
    own = own.join(sums, F.col("repo").eqNullSafe(F.col("_r")) & F.col("_p").eqNullSafe(F.col("_q")))
    total = F.coalesce(F.col("_b") + F.col("_o"), F.col("_o"), F.col("_b"))
    return own.withColumn("accepted", committed + total <= limit).drop("_p", "_o", "_b", "_r", "_q")
