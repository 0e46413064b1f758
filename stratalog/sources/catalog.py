"""The catalog tables, derived from Parquet tables by rules that any SQL engine can follow.

``SQL`` states the same rules for a checking engine: the text of a WITH clause's
members, by table, with the tables each one needs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Documents up to which packs have two digits; each sixteenfold of them adds one.
PACK_DOCUMENTS = 100_000
#: Characters of a stored chunk, and snapshots that items are taken in.
CHUNK_CHARS, SNAPSHOTS = 512, 7
#: Bytes of a pack's header and of each blob's length field.
PACK_HEADER, BLOB_HEADER = 9, 4

#: One row a label: durations and counts of a retention policy. A label with no rule keeps everything.
POLICIES = [
    ("1-URGENT", 90, 3, None, None, None, 6, None),
    ("2-HIGH", None, 5, None, None, 4, None, 2),
    ("3-MEDIUM", None, None, 4, 7, None, 12, None),
    ("4-NOT SPECIFIED", 30, 2, 2, 2, 2, 2, 2),
    ("5-LOW", None, None, None, None, None, None, None),
]
POLICY_COLUMNS = ["source_label", "keep_within_days", "keep_last", "keep_hourly", "keep_daily", "keep_weekly", "keep_monthly", "keep_yearly"]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, a local one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/stratalog-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once a session and folder: a catalog keeps its chunk references and its index, queries don't cut and hash files again. It is written again where it has been cleared away."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _stored.get(key)
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            path = None
    if path is None:
        path = _stored[key] = work_dir(spark, name)
        make().write.parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("snap-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderdate").alias("time"),
        F.col("o_orderpriority").alias("source_label"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("l"), (F.col("o_orderkey") % 3).cast("string"))).alias("label"),
        F.concat(F.lit("host-"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example.org")).alias("hostname"),
        (F.col("o_custkey") % 100).alias("nfiles"),
        F.floor("o_totalprice").cast("long").alias("original_size"),
        F.floor(F.col("o_totalprice") / 2).cast("long").alias("compressed_size"),
        F.floor(F.col("o_totalprice") / 4).cast("long").alias("deduplicated_size"),
        F.when(F.col("o_orderkey") % 97 == 0, 2).otherwise(1).cast("long").alias("format_version"),
        F.col("o_orderstatus").alias("status"),
    )


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, ", ".join(f"{c} {'string' if c == 'source_label' else 'int'}" for c in POLICY_COLUMNS))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document and snapshot k that has it; texts change in one snapshot and stay changed in no other. Nanoseconds are decimals: 64 bits end at document 106,751."""
    d = table(spark, sf_dir, "documents")
    k = F.col("snapshot_id")
    changed = F.col("doc_id") % 11 == k
    return (
        d.withColumn("snapshot_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SNAPSHOTS - 1).cast("long"))))
        .where(F.col("doc_id") % 7 != k)
        .select(
            k,
            F.col("doc_id").alias("item_index"),
            F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("path"),
            F.when(F.col("doc_id") % 17 == 0, "symlink").when(F.col("doc_id") % 23 == 0, "dir").otherwise("file").alias("entry_type"),
            F.when(changed, F.concat("text", F.lit(" v"), k.cast("string"))).otherwise(F.col("text")).alias("content"),
            (F.col("doc_id").cast("decimal(20,0)") * 86_400_000_000_000 + F.when(changed, k * 3_600_000_000_000).otherwise(F.lit(0))).cast("decimal(38,0)").alias("mtime_ns"),
            (F.col("doc_id") % 4096).alias("mode"),
        )
        .withColumn("size", F.octet_length("content").cast("long"))
    )


def pack_digits(spark: SparkSession, sf_dir: str) -> int:
    """So many digits that a pack stays of a bounded size, whatever the documents."""
    n = max(1, table(spark, sf_dir, "documents").count())
    return 2 + math.floor(max(0.0, math.log(n / PACK_DOCUMENTS) / math.log(16.0)))


def pack_of(spark: SparkSession, sf_dir: str) -> Column:
    """The pack of a chunk: its first digits."""
    return F.substring("chunk_id", 1, pack_digits(spark, sf_dir))


def chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of regular files: their texts in pieces of CHUNK_CHARS characters. Stored."""
    return stored(spark, sf_dir, "chunk-refs", lambda: _chunk_refs(spark, sf_dir))


def _chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = items(spark, sf_dir).where("entry_type = 'file'")
    last = F.greatest(F.lit(0), F.floor((F.length("content") - 1) / CHUNK_CHARS)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("content"), i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)))
    return files.select("snapshot_id", "item_index", "path", F.posexplode(pieces).alias("pos", "piece")).select(
        "snapshot_id", "item_index", "path", F.col("pos").cast("long").alias("pos"), F.sha2("piece", 256).alias("chunk_id"), F.octet_length("piece").cast("long").alias("size")
    )


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a chunk: references, stored bytes, its pack. Stored."""
    refs = chunk_refs(spark, sf_dir)
    return stored(spark, sf_dir, "chunk-index", lambda: refs.groupBy("chunk_id").agg(F.count("*").alias("refcount"), F.max("size").alias("stored_size")).withColumn("pack_id", pack_of(spark, sf_dir)))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs in storage: live bytes and some dead ones; packs of 'a0' are missing, 'zz' is an orphan, those of 'b1' are shorter than what is live."""
    live = chunk_index(spark, sf_dir).groupBy("pack_id").agg(F.sum(F.col("stored_size") + BLOB_HEADER).alias("live"))
    dead = F.when(F.substring("pack_id", 2, 1) < "8", F.col("live")).when(F.substring("pack_id", 2, 1) < "c", F.floor(F.col("live") / 10).cast("long")).otherwise(F.lit(0).cast("long"))
    size = F.when(F.col("pack_id").startswith("b1"), F.floor(F.col("live") / 2).cast("long")).otherwise(PACK_HEADER + F.col("live") + dead)
    orphan = spark.sql("SELECT 'zz' AS pack_id, CAST(5000 AS BIGINT) AS size")
    return live.where("NOT startswith(pack_id, 'a0')").select("pack_id", size.alias("size")).unionByName(orphan)


_policy_rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in POLICIES)

#: The pack of a chunk, in SQL.
PACK_SQL = f"substring(chunk_id, 1, (SELECT 2 + CAST(floor(greatest(0.0, ln(greatest(count(*), 1) / {PACK_DOCUMENTS}.0) / ln(16.0))) AS INTEGER) FROM documents))"

SQL: dict[str, tuple[list[str], str]] = {
    "snapshots": (
        [],
        """SELECT o_orderkey AS ordinal, 'snap-' || o_orderkey AS name, o_orderdate AS time, o_orderpriority AS source_label,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'l' || (o_orderkey % 3) END AS label, 'host-' || (o_custkey % 7) || '.example.org' AS hostname,
  o_custkey % 100 AS nfiles, CAST(floor(o_totalprice) AS BIGINT) AS original_size, CAST(floor(o_totalprice / 2) AS BIGINT) AS compressed_size,
  CAST(floor(o_totalprice / 4) AS BIGINT) AS deduplicated_size, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS BIGINT) AS format_version, o_orderstatus AS status
FROM orders""",
    ),
    "policies": ([], f"SELECT * FROM (VALUES {_policy_rows}) AS p({', '.join(POLICY_COLUMNS)})"),
    "items": (
        [],
        """SELECT *, CAST(strlen(content) AS BIGINT) AS size FROM (
  SELECT k AS snapshot_id, doc_id AS item_index, source || '/' || lang || '/doc_' || doc_id AS path,
    CASE WHEN doc_id % 17 = 0 THEN 'symlink' WHEN doc_id % 23 = 0 THEN 'dir' ELSE 'file' END AS entry_type,
    CASE WHEN doc_id % 11 = k THEN text || ' v' || k ELSE text END AS content,
    CAST(doc_id * 86400000000000 + CASE WHEN doc_id % 11 = k THEN k * 3600000000000 ELSE 0 END AS BIGINT) AS mtime_ns, doc_id % 4096 AS mode
  FROM documents, (SELECT unnest(range(0, 7)) AS k) WHERE doc_id % 7 <> k)""",
    ),
    "chunk_refs": (
        ["items"],
        """SELECT snapshot_id, item_index, path, pos, sha256(piece) AS chunk_id, CAST(strlen(piece) AS BIGINT) AS size FROM (
  SELECT snapshot_id, item_index, path, pos, substring(content, pos * 512 + 1, 512) AS piece FROM (
    SELECT *, unnest(range(0, greatest(0, (length(content) - 1) // 512) + 1)) AS pos FROM items WHERE entry_type = 'file'))""",
    ),
    "chunk_index": (["chunk_refs"], f"SELECT chunk_id, count(*) AS refcount, max(size) AS stored_size, {PACK_SQL} AS pack_id FROM chunk_refs GROUP BY chunk_id"),
    "packs": (
        ["chunk_index"],
        """SELECT pack_id, CASE WHEN starts_with(pack_id, 'b1') THEN live // 2 ELSE 9 + live + CASE WHEN substring(pack_id, 2, 1) < '8' THEN live WHEN substring(pack_id, 2, 1) < 'c' THEN live // 10 ELSE 0 END END AS size
FROM (SELECT pack_id, CAST(sum(stored_size + 4) AS BIGINT) AS live FROM chunk_index GROUP BY pack_id) WHERE NOT starts_with(pack_id, 'a0') UNION ALL SELECT 'zz', 5000""",
    ),
}


def with_tables(names: str, body: str, **more: str) -> str:
    """SQL that defines the named catalog tables, then further members, then runs the body."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        before, text = SQL[name]
        for b in before:
            need(b)
        done.setdefault(name, text)

    for n in names.split():
        need(n)
    members = ", ".join(f"{k} AS ({v})" for k, v in {**done, **more}.items())
    return f"WITH {members} {body}"
