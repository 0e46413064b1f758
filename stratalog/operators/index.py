"""Maintenance of the chunk index: lookups, deltas, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def membership(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The distinct chunks of some references, with whether they are stored."""
    return refs.select("chunk_id").distinct().join(index.select("chunk_id", F.lit(True).alias("stored")), "chunk_id", "left").select("chunk_id", F.coalesce("stored", F.lit(False)).alias("stored"))


def locate(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Where each referenced chunk is stored; null where it isn't."""
    return refs.join(index.select("chunk_id", "pack_id", "stored_size"), "chunk_id", "left")


def lookup_chain(refs: DataFrame, committed: DataFrame, recovered: DataFrame, pending: DataFrame) -> DataFrame:
    """The first of three tables that has each chunk."""
    wanted = refs.select("chunk_id").distinct()
    for name, t in (("committed", committed), ("recovered", recovered), ("pending", pending)):
        wanted = wanted.join(t.select("chunk_id", F.lit(name).alias(name)).distinct(), "chunk_id", "left")
    return wanted.select("chunk_id", F.coalesce("committed", "recovered", "pending", F.lit("new")).alias("found_in"))


def reconcile(new_entries: DataFrame, bumps: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A delta made against an older index, fitted to the current one: entries that exist by now become bumps."""
    known = index.select("chunk_id")
    late = new_entries.join(known, "chunk_id", "left_semi").select("chunk_id", F.col("refcount").alias("n"))
    return new_entries.join(known, "chunk_id", "left_anti"), bumps.select("chunk_id", "n").unionByName(late).groupBy("chunk_id").agg(F.sum("n").alias("n"))


def stale_bumps(bumps: DataFrame, new_entries: DataFrame, index: DataFrame) -> DataFrame:
    """Bumps of chunks that have vanished; there must be none."""
    return bumps.join(index.select("chunk_id").unionByName(new_entries.select("chunk_id")), "chunk_id", "left_anti")


def apply_delta(index: DataFrame, new_entries: DataFrame, bumps: DataFrame) -> DataFrame:
    """The index with new entries and bumps."""
    rest = [c for c in index.columns if c not in ("chunk_id", "refcount")]
    bump = bumps.select("chunk_id", F.col("n").alias("refcount"), *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in rest))
    both = index.unionByName(new_entries.select(*index.columns)).unionByName(bump)
    return both.groupBy("chunk_id").agg(F.sum("refcount").alias("refcount"), *(F.max(c).alias(c) for c in rest)).select(*index.columns)


def missing_packs_of(new_entries: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs a delta refers to that storage doesn't list."""
    return new_entries.select("pack_id").distinct().join(packs.select("pack_id"), "pack_id", "left_anti")


def recover_journal(journal: DataFrame, packs: DataFrame, index: DataFrame) -> DataFrame:
    """Journal entries whose pack is there and whose chunk isn't indexed."""
    return journal.join(packs.select("pack_id"), "pack_id", "left_semi").join(index.select("chunk_id"), "chunk_id", "left_anti")


def promote(recovered: DataFrame, refs: DataFrame) -> DataFrame:
    """Recovered chunks that something refers to."""
    return recovered.join(refs.select("chunk_id"), "chunk_id", "left_semi")


def refresh(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, action): what a local cache must drop and load to hold what the remote lists."""
    drop = local.select(key).join(remote.select(key), key, "left_anti").withColumn("action", F.lit("drop"))
    return drop.unionByName(remote.select(key).join(local.select(key), key, "left_anti").withColumn("action", F.lit("load")))


def checksum(index: DataFrame) -> DataFrame:
    """An order-free checksum of a table: rows, and the sum of their hashes."""
    return index.agg(F.count("*").alias("entries"), F.sum(F.pmod(F.xxhash64(*index.columns), F.lit(1 << 31))).alias("checksum"))
