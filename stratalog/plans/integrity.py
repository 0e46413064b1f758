"""Queries of integrity scans and repairs by all kinds of issues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import check
from ..sources import catalog
from ..sources.catalog import with_tables
from .queries import _INVALID, _REMOVED, _part, _PART, _removed, query

#: Items of an item stream's chunk.
STREAM_ITEMS = 64

# What a scan reads: snapshot objects by the orders, item streams by the items, packs and chunks by their ids.
OBJECTS = """SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'snapshots/tmp-' || o_orderkey ELSE 'snapshots/' || sha256(CAST(o_orderkey AS VARCHAR)) END AS key, o_orderkey AS snapshot_id,
  CASE WHEN o_orderkey % 89 = 0 THEN 'io_error' WHEN o_orderkey % 83 = 0 THEN 'other_length' WHEN o_orderkey % 79 = 0 THEN 'undecodable' WHEN o_orderkey % 73 = 0 THEN 'items_undecodable' WHEN o_orderkey % 71 = 0 THEN 'items_io_error' ELSE 'ok' END AS outcome,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS BIGINT) AS format_version FROM orders"""
PTRS = f"SELECT DISTINCT snapshot_id, item_index // {STREAM_ITEMS} AS pos, sha256(snapshot_id || ':' || item_index // {STREAM_ITEMS}) AS chunk_id FROM items"
TREES = "SELECT chunk_id FROM ptrs WHERE substring(chunk_id, 1, 1) <> '0'"
CHECKS = "SELECT pack_id, CASE substring(pack_id, 2, 1) WHEN 'e' THEN 'io_error' WHEN 'd' THEN 'hash mismatch' ELSE 'ok' END AS outcome FROM packs"
VERIFIED = "SELECT chunk_id, pack_id, CASE WHEN substring(chunk_id, 3, 2) = '7a' THEN 'mismatch' ELSE 'ok' END AS outcome FROM chunk_index"
_COLUMNS = "CAST({} AS VARCHAR) AS kind, CAST({} AS BIGINT) AS snapshot_id, CAST({} AS BIGINT) AS item_index, CAST({} AS VARCHAR) AS chunk_id, CAST({} AS VARCHAR) AS pack_id, CAST({} AS VARCHAR) AS detail"


def _sql(kind: str, snapshot="NULL", item="NULL", chunk="NULL", pack="NULL", detail="NULL") -> str:
    return "SELECT " + _COLUMNS.format(kind, snapshot, item, chunk, pack, detail)


_KIND = "CASE WHEN NOT regexp_full_match(key, 'snapshots/[0-9a-f]{64}') THEN 'invalid_snapshot_key' WHEN outcome IN ('io_error', 'items_io_error') THEN 'snapshot_read_failed' WHEN outcome = 'other_length' THEN 'incompatible_snapshot_envelope' WHEN outcome = 'undecodable' THEN 'corrupt_snapshot' WHEN format_version > 1 THEN 'unsupported_snapshot_version' WHEN outcome = 'items_undecodable' THEN 'unreadable_snapshot' END"
SNAPSHOT_ISSUES = _sql("kind", "snapshot_id", detail="CASE kind WHEN 'invalid_snapshot_key' THEN key WHEN 'unsupported_snapshot_version' THEN 'version ' || format_version ELSE outcome END") + f" FROM (SELECT *, {_KIND} AS kind FROM objects) WHERE kind IS NOT NULL"
PACK_ISSUES = _sql("CASE WHEN outcome IS NULL THEN 'missing_pack' WHEN outcome = 'io_error' THEN 'pack_existence_check_failed' ELSE 'corrupt_pack_content' END", pack="pack_id", detail="CASE WHEN outcome IS NULL THEN chunks || ' chunks' ELSE outcome END") + " FROM (SELECT i.pack_id, chunks, outcome FROM (SELECT pack_id, count(*) AS chunks FROM part GROUP BY pack_id) i LEFT JOIN checks c ON c.pack_id = i.pack_id) WHERE outcome IS NULL OR outcome <> 'ok'"
CHUNK_ISSUES = _sql("'corrupt_chunk'", chunk="chunk_id", pack="pack_id", detail="outcome") + " FROM verified WHERE outcome <> 'ok' AND pack_id NOT IN (SELECT pack_id FROM pack_issues WHERE kind <> 'pack_existence_check_failed')"
PTR_ISSUES = _sql("'dangling_item_ptr'", "snapshot_id", chunk="chunk_id") + " FROM ptrs WHERE chunk_id NOT IN (SELECT chunk_id FROM trees)"
ALL = " UNION ALL ".join(
    [
        "SELECT * FROM snapshot_issues",
        "SELECT * FROM ptr_issues",
        _sql("'invalid_item'", "snapshot_id", "item_index", detail="reason") + " FROM invalid",
        _sql("'dangling_file_chunk'", "snapshot_id", "item_index", "chunk_id") + " FROM chunk_refs WHERE chunk_id NOT IN (SELECT chunk_id FROM part)",
        "SELECT * FROM pack_issues",
        "SELECT * FROM chunk_issues",
    ]
)
_WITH = {"part": _PART, "objects": OBJECTS, "ptrs": PTRS, "trees": TREES, "checks": CHECKS, "verified": VERIFIED, "invalid": _INVALID, "snapshot_issues": SNAPSHOT_ISSUES, "ptr_issues": PTR_ISSUES, "pack_issues": PACK_ISSUES, "chunk_issues": CHUNK_ISSUES, "issues": ALL}


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 89 == 0, "io_error").when(k % 83 == 0, "other_length").when(k % 79 == 0, "undecodable").when(k % 73 == 0, "items_undecodable").when(k % 71 == 0, "items_io_error").otherwise("ok")
    key = F.when(k % 101 == 0, F.concat(F.lit("snapshots/tmp-"), k.cast("string"))).otherwise(F.concat(F.lit("snapshots/"), F.sha2(k.cast("string"), 256)))
    return catalog.table(spark, sf_dir, "orders").select(key.alias("key"), k.alias("snapshot_id"), outcome.alias("outcome"), F.when(k % 97 == 0, 2).otherwise(1).cast("long").alias("format_version"))


def ptrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.items(spark, sf_dir).select("snapshot_id", F.floor(F.col("item_index") / STREAM_ITEMS).alias("pos")).distinct()
    return i.withColumn("chunk_id", F.sha2(F.concat_ws(":", "snapshot_id", "pos"), 256))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptrs(spark, sf_dir).where("substring(chunk_id, 1, 1) <> '0'")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.substring("pack_id", 2, 1)
    return catalog.packs(spark, sf_dir).select("pack_id", F.when(d == "e", "io_error").when(d == "d", "hash mismatch").otherwise("ok").alias("outcome"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_index(spark, sf_dir).select("chunk_id", "pack_id", F.when(F.substring("chunk_id", 3, 2) == "7a", "mismatch").otherwise("ok").alias("outcome"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.full_scan(objects(spark, sf_dir), catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir), ptrs(spark, sf_dir), _part(spark, sf_dir), trees(spark, sf_dir), checks(spark, sf_dir), verified(spark, sf_dir))


@query(with_tables("packs items", "SELECT * FROM snapshot_issues", **_WITH))
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.snapshot_issues(objects(spark, sf_dir))


@query(with_tables("packs items", "SELECT snapshot_id, pos, chunk_id FROM ptrs WHERE chunk_id NOT IN (SELECT chunk_id FROM trees)", **_WITH))
def dangling_item_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.dangling_item_ptrs(ptrs(spark, sf_dir), trees(spark, sf_dir)).select("snapshot_id", "pos", "chunk_id")


@query(with_tables("packs items", "SELECT * FROM pack_issues", **_WITH))
def pack_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.pack_issues(_part(spark, sf_dir), checks(spark, sf_dir))


@query(with_tables("packs items", "SELECT * FROM chunk_issues", **_WITH))
def chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = check.pack_issues(_part(spark, sf_dir), checks(spark, sf_dir)).where("kind <> 'pack_existence_check_failed'")
    return check.chunk_issues(verified(spark, sf_dir), bad)


@query(with_tables("packs items", "SELECT * FROM issues", **_WITH))
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(with_tables("packs items", "SELECT kind, count(*) AS issues, count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT pack_id) AS packs FROM issues GROUP BY kind", **_WITH))
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("issues"), F.count_distinct("snapshot_id").alias("snapshots"), F.count_distinct("pack_id").alias("packs"))


_SAYS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in check.MESSAGES.items()) + " END"


@query(
    with_tables(
        "packs items",
        f"SELECT kind, CASE WHEN kind = 'invalid_snapshot_key' THEN detail WHEN snapshot_id IS NOT NULL THEN 'snapshot ' || snapshot_id WHEN chunk_id IS NOT NULL THEN 'chunk ' || substring(chunk_id, 1, 16) ELSE 'pack ' || pack_id END AS context, {_SAYS} || CASE WHEN kind <> 'invalid_snapshot_key' AND detail IS NOT NULL THEN ': ' || detail ELSE '' END AS message FROM issues",
        **_WITH,
    )
)
def issue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.messages(_issues(spark, sf_dir))


# Drops: the items that need a removed chunk, but in snapshot 1, where some aren't found, and more than there are in snapshot 3; in snapshot 5 an item stream is lost.
_GATED = {
    "removed": _REMOVED + " UNION SELECT chunk_id FROM ptrs WHERE snapshot_id = 5 AND pos = 1",
    "hit": "SELECT DISTINCT snapshot_id, item_index FROM chunk_refs WHERE chunk_id IN (SELECT chunk_id FROM removed)",
    "drops": "SELECT snapshot_id, item_index FROM hit WHERE snapshot_id <> 1 OR item_index % 3 <> 0 UNION SELECT snapshot_id, item_index FROM items WHERE snapshot_id = 3 UNION SELECT CAST(2 AS BIGINT), CAST(-1 AS BIGINT)",
    "gated": """SELECT snapshot_id, drops, items, gate, CASE WHEN gate IS NULL THEN 'drop_items' ELSE 'remove_snapshot' END AS action FROM (
  SELECT d.snapshot_id, d.drops, h.have AS items, CASE WHEN d.known < d.drops THEN 'data' WHEN d.drops >= h.have THEN 'count' WHEN EXISTS (SELECT 1 FROM ptrs p WHERE p.snapshot_id = d.snapshot_id AND p.chunk_id IN (SELECT chunk_id FROM removed)) THEN 'pointers'
    WHEN EXISTS (SELECT 1 FROM hit t WHERE t.snapshot_id = d.snapshot_id AND (t.snapshot_id, t.item_index) NOT IN (SELECT (snapshot_id, item_index) FROM drops)) THEN 'survivors' END AS gate
  FROM (SELECT x.snapshot_id, count(*) AS drops, count(i.item_index) AS known FROM drops x LEFT JOIN items i ON i.snapshot_id = x.snapshot_id AND i.item_index = x.item_index GROUP BY x.snapshot_id) d JOIN (SELECT snapshot_id, count(*) AS have FROM items GROUP BY snapshot_id) h ON h.snapshot_id = d.snapshot_id)""",
}


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, refs, p = catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir), ptrs(spark, sf_dir)
    removed = _removed(spark, sf_dir).unionByName(p.where("snapshot_id = 5 AND pos = 1").select("chunk_id")).distinct()
    hit = refs.join(removed, "chunk_id", "left_semi").select("snapshot_id", "item_index")
    drops = hit.where("snapshot_id <> 1 OR item_index % 3 <> 0").unionByName(items.where("snapshot_id = 3").select("snapshot_id", "item_index")).unionByName(spark.createDataFrame([(2, -1)], "snapshot_id bigint, item_index bigint"))
    declared = items.groupBy("snapshot_id").agg(F.count("*").alias("items"))
    return check.gated_drops(drops, items, declared, p, refs, removed)


@query(with_tables("packs items", "SELECT * FROM gated", **_WITH, **_GATED))
def repair_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)


@query(
    with_tables(
        "packs items",
        """SELECT CAST(list_position(['remove_corrupt_snapshot', 'remove_invalid_snapshot_key', 'remove_dangling_index_entries', 'remove_corrupt_pack', 'remove_corrupt_chunks', 'drop_items', 'remove_snapshot', 'rebuild_refcounts'], action) AS INTEGER) AS step, action, target FROM (
  SELECT DISTINCT CASE kind WHEN 'corrupt_snapshot' THEN 'remove_corrupt_snapshot' WHEN 'invalid_snapshot_key' THEN 'remove_invalid_snapshot_key' WHEN 'missing_pack' THEN 'remove_dangling_index_entries' WHEN 'corrupt_pack_content' THEN 'remove_corrupt_pack' ELSE 'remove_corrupt_chunks' END AS action, CASE kind WHEN 'corrupt_snapshot' THEN CAST(snapshot_id AS VARCHAR) WHEN 'invalid_snapshot_key' THEN detail ELSE pack_id END AS target
  FROM issues WHERE kind IN ('corrupt_snapshot', 'invalid_snapshot_key', 'missing_pack', 'corrupt_pack_content', 'corrupt_chunk')
  UNION ALL SELECT action, CAST(snapshot_id AS VARCHAR) FROM gated UNION ALL SELECT 'rebuild_refcounts', NULL)""",
        **_WITH,
        **_GATED,
    )
)
def repair_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.steps(_issues(spark, sf_dir), _gated(spark, sf_dir))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderdate <= TIMESTAMP '2023-12-25 00:00:00' OR o_custkey % 11 = 0 THEN 100 ELSE CAST(o_custkey % 100 AS INTEGER) END AS percent FROM orders")
def check_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of each repository its next check covers: a full one is due a week after the last."""
    o = catalog.table(spark, sf_dir, "orders")
    last = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp"))
    due = check.full_check_due(last, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(7 * 86400))
    share = F.when(F.col("o_custkey") % 11 != 0, (F.col("o_custkey") % 100).cast("int"))
    return o.select("o_orderkey", check.check_share(share, due).alias("percent"))
