"""Which packs are worth rewriting, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.catalog import BLOB_HEADER, PACK_HEADER


def live_bytes(index: DataFrame) -> DataFrame:
    return index.groupBy("pack_id").agg(F.sum(F.col("stored_size") + BLOB_HEADER).alias("live"), F.count("*").alias("blobs"))


def analyse(packs: DataFrame, index: DataFrame) -> DataFrame:
    """Each pack with its dead bytes and state: corrupt (shorter than its header or what is live), orphan (nothing live), or ok."""
    p = packs.join(live_bytes(index), "pack_id", "left").withColumn("live", F.coalesce("live", F.lit(0).cast("long"))).withColumn("blobs", F.coalesce("blobs", F.lit(0).cast("long")))
    payload = F.col("size") - PACK_HEADER
    state = F.when((payload < 0) | (payload < F.col("live")), "corrupt").when(F.col("live") == 0, "orphan").otherwise("ok")
    return p.withColumn("state", state).withColumn("dead", F.when(state != "corrupt", payload - F.col("live")).otherwise(F.lit(0).cast("long")))


def candidates(analysed: DataFrame, threshold: float, cap: int | None = None) -> DataFrame:
    """Packs to rewrite or delete, most dead bytes first: orphans, and those whose share of dead bytes reaches the threshold. A cap takes rows while the total of those before is under it.

    The order is total, so the running sum is taken in two steps: by ranges of
    dead bytes, and within them.
    """
    percent = F.col("dead") * 100.0 / (F.col("size") - PACK_HEADER)
    c = analysed.where((F.col("state") != "corrupt") & (F.col("dead") > 0) & ((F.col("state") == "orphan") | (percent >= threshold)))
    c = c.select("pack_id", "size", "live", "dead", "blobs", F.when(F.col("state") == "orphan", "delete").otherwise("repack").alias("action"))
    return c if cap is None else running(c, "dead", "size").where(F.col("before") < cap).drop("before")


def running(df: DataFrame, order: str, value: str, tie: str = "pack_id") -> DataFrame:
    """``before``: the sum of a column over the rows that come first in descending order, without sorting them in one task: rows fall in classes by the order's magnitude and its leading digits, the few class totals are summed first."""
    shift = F.greatest(F.length(F.bin(order)) - 12, F.lit(0))
    group = (F.length(F.bin(order)) * 4096 + F.shiftright(F.col(order), 0).cast("long") / F.pow(F.lit(2.0), shift).cast("long")).cast("long")
    d = df.withColumn("_g", group)
    sums = d.groupBy("_g").agg(F.sum(value).alias("_s"))  # 64 * 4096 classes at most
    base = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_g").orderBy(F.desc(order), tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_o", own).join(base, "_g").withColumn("before", (F.col("_o") + F.col("_b")).cast("long")).drop("_g", "_o", "_b")


def counters(analysed: DataFrame) -> DataFrame:
    return analysed.agg(F.count("*").alias("packs"), F.count_if(F.col("state") == "corrupt").alias("corrupt"), F.count_if(F.col("state") == "orphan").alias("orphan"), F.sum("blobs").alias("live_blobs"), F.sum("dead").alias("dead_bytes"))


def pack_offsets(index: DataFrame, seq: str = "chunk_id") -> DataFrame:
    """Where each blob of a pack begins: after the header, the blobs before it and its own length field."""
    by = Window.partitionBy("pack_id").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("stored_size") + BLOB_HEADER).over(by), F.lit(0))
    return index.withColumn("pack_offset", (PACK_HEADER + before + BLOB_HEADER).cast("long"))


def estimate_size(size: Column) -> Column:
    """Bytes of a pack of blobs of these sizes, as an aggregate; nothing where it keeps none."""
    return F.when(F.count(size) == 0, F.lit(0).cast("long")).otherwise(PACK_HEADER + F.sum(size + BLOB_HEADER)).alias("output_size")


def relocate(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """The index after the chosen packs were rewritten: their chunks lie in a new pack, packed in the order of their old places."""
    old = pack_offsets(index)
    moved = old.join(chosen.where("action = 'repack'").select("pack_id"), "pack_id", "left_semi")
    moved = pack_offsets(moved.drop("pack_offset").withColumn("pack_id", F.concat("pack_id", F.lit("-new"))))
    return old.join(chosen.select("pack_id"), "pack_id", "left_anti").unionByName(moved)
