"""Queries of chunking, pack files, folds and streams. Tests compare what SQL can't check with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import folds
from ..sources import catalog, formats
from ..sources.catalog import with_tables, work_dir
from ..streaming import streams
from .queries import QUERIES, query


@query()
def content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as files in content-defined chunks with keyed ids."""
    d = catalog.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return formats.chunk_files(d, b"example key")


@query("SELECT CAST(doc_id // 64 AS VARCHAR) AS path, row_number() OVER w - 1 AS seq, CAST(13 + coalesce(sum(strlen(text) + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(strlen(text) AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS error FROM documents WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id // 64 ORDER BY doc_id)")
def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs of 64 documents each sealed into a pack, and the packs scanned again. An empty file has no blob, for a blob has a byte at least."""
    d = catalog.table(spark, sf_dir, "documents").where("length(text) > 0")
    blobs = d.select(F.floor(F.col("doc_id") / 64).cast("string").alias("pack"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("blob"))
    return formats.scan_packs(formats.seal_packs(blobs), path="pack")


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'chunk_data' END AS kind, CASE WHEN text IS NOT NULL THEN true END AS equal, true AS refused FROM documents")
def sealed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed and opened again; another type doesn't open."""
    key = F.lit("0123456789abcdef").cast("binary")
    d = catalog.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    s = d.select("doc_id", "content", formats.seal("chunk_data", F.col("content"), key).alias("sealed"))
    return s.select("doc_id", formats.object_type(F.col("sealed")).alias("kind"), (formats.unseal("chunk_data", F.col("sealed"), key) == F.col("content")).alias("equal"), formats.unseal("config", F.col("sealed"), key).isNull().alias("refused"))


@query("SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS none_bytes, " + ", ".join(f"CASE WHEN text IS NOT NULL THEN true END AS {c}_bounded, CASE WHEN text IS NOT NULL THEN true END AS {c}_equal" for c in ("none", "lz4", "zstd")) + " FROM documents")
def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored size of each text as it is; by codec, whether its size is in the bound, and whether decompression gives it back."""
    d = catalog.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    for c in ("none", "lz4", "zstd"):
        d = d.withColumn(c, formats.compress(c)("content"))
    back = [(formats.decompress()(c) == F.col("content")).alias(f"{c}_equal") for c in ("none", "lz4", "zstd")]
    bound = [(F.length(c) <= S.compressed_bound(F.length("content")) + formats.FRAME).alias(f"{c}_bounded") for c in ("none", "lz4", "zstd")]
    return d.select("doc_id", F.length("none").cast("long").alias("none_bytes"), *bound, *back)


_FOLD = """WITH RECURSIVE rows AS ({rows}), fold AS (
  SELECT key, seq, r, CAST(0 AS BIGINT) AS n, CAST({first} AS BIGINT) AS held, CAST(1 AS BIGINT) AS count, tm AS began FROM rows WHERE r = 1
  UNION ALL SELECT x.key, x.seq, x.r, f.n + CASE WHEN {closes} THEN 1 ELSE 0 END, CASE WHEN {closes} THEN 0 ELSE f.held END + {adds}, CASE WHEN {closes} THEN 0 ELSE f.count END + 1, CASE WHEN {closes} THEN x.tm ELSE f.began END FROM fold f JOIN rows x ON x.key = f.key AND x.r = f.r + 1)
SELECT key AS {key}, seq, n AS {n} FROM fold"""


@query(
    _FOLD.format(
        rows="SELECT l_suppkey % 50 AS key, l_orderkey * 10 + l_linenumber AS seq, CAST(trunc(l_extendedprice) AS BIGINT) AS size, l_orderkey / 10 AS tm, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey * 10 + l_linenumber, trunc(l_extendedprice)) AS r FROM lineitem",
        first="size + 4",
        adds="x.size + 4",
        closes="f.held >= 1000000 OR f.count >= 10000 OR x.tm - f.began > 300.0",
        key="session",
        n="pack",
    )
)
def pack_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pack each blob of a session's stream goes to."""
    li = catalog.table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_suppkey") % 50).alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").cast("long").alias("size"), (F.col("l_orderkey") / 10).alias("at"))
    return folds.assign_packs(rows, 1_000_000)


@query(
    _FOLD.format(
        rows="SELECT 'r' || l_suppkey % 20 AS key, l_orderkey * 10 + l_linenumber AS seq, CAST(trunc(l_extendedprice) AS BIGINT) AS size, 0.0 AS tm, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey * 10 + l_linenumber, trunc(l_extendedprice)) AS r FROM lineitem",
        first="size",
        adds="x.size",
        closes="f.held > 0 AND f.held + x.size > 500000",
        key="repo",
        n="batch",
    )
)
def repack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repack operations in batches under a limit."""
    li = catalog.table(spark, sf_dir, "lineitem")
    return folds.batch_plans(li.select(F.concat(F.lit("r"), (F.col("l_suppkey") % 20).cast("string")).alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").cast("long").alias("size")), 500_000)


RULES = ["doc_1*", "!doc_1?", "de/", "/src2/fr", "# a comment", "**/es/doc_*5"]


_NAME = "regexp_extract(path, '[^/]*$')"
_BELOW = "(regexp_matches(path, '(^|/)de/.') OR starts_with(path, 'src2/fr/'))"
_IGNORED = f"CASE WHEN {_BELOW} THEN true WHEN regexp_matches(path, '(^|/)es/doc_[^/]*5$') THEN true WHEN regexp_full_match({_NAME}, 'doc_1.') THEN false ELSE starts_with({_NAME}, 'doc_1') END"


@query(with_tables("items", f"SELECT snapshot_id, path, {_IGNORED} AS ignored, CASE WHEN length(path) <= 12 THEN path ELSE path[1:5] || '...' || path[-4:] END AS short FROM items"))
def ignored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that ignore rules exclude, with their names cut to 12 columns."""
    i = catalog.items(spark, sf_dir)
    return i.select("snapshot_id", "path", folds.ignored(RULES, F.col("path"), F.col("entry_type") == "dir").alias("ignored"), folds.truncated(12)("path").alias("short"))


#: Ignore files by their directory: the root's, and deeper ones, which come first.
NESTED = {"": ["doc_1*", "fr/"], "src1": ["!doc_1", "doc_2*"], "src1/en": ["!doc_2?", "/doc_1"]}


@query(
    with_tables(
        "items",
        f"""SELECT DISTINCT path, CASE WHEN starts_with(path, 'src1/en/') AND {_NAME} = 'doc_1' THEN true WHEN starts_with(path, 'src1/en/') AND regexp_full_match({_NAME}, 'doc_2.') THEN false
  WHEN starts_with(path, 'src1/') AND starts_with({_NAME}, 'doc_2') THEN true WHEN starts_with(path, 'src1/') AND {_NAME} = 'doc_1' THEN false WHEN regexp_matches(path, '(^|/)fr/.') THEN true ELSE starts_with({_NAME}, 'doc_1') END AS ignored FROM items""",
    )
)
def nested_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that nested ignore files exclude: the deepest one with a rule for a path decides."""
    paths = catalog.items(spark, sf_dir).select("path").distinct()
    return paths.select("path", folds.ignored_by_files(NESTED, F.col("path"), F.lit(False)).alias("ignored"))


def _drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    path = work_dir(spark, name)
    streams.drain(df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state"))
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def _stream_of(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    path = work_dir(spark, name)
    df.write.parquet(path)
    return streams.discover(spark, path, df.schema)


@query(
    """SELECT user_id, beats, registered, last_refresh FROM (SELECT user_id, count(*) AS beats, min(ts) AS registered, max(ts) AS last_refresh FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)
WHERE last_refresh + INTERVAL 45 MINUTES <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions found by a stream; those still open at the end of the input aren't out yet."""
    e = catalog.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = _drained(spark, streams.session_windows(_stream_of(spark, e, "stream-events")), "stream-sessions")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("registered", "last_refresh")})


_AGED = """WITH RECURSIVE rows AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM (SELECT user_id, epoch_us(ts) AS ts FROM events)), fold AS (
  SELECT key, ts AS began, ts, r, CAST(1 AS BIGINT) AS blobs FROM rows WHERE r = 1
  UNION ALL SELECT x.key, CASE WHEN x.ts - f.began > 300000000 THEN x.ts ELSE f.began END, x.ts, x.r, CASE WHEN x.ts - f.began > 300000000 THEN 1 ELSE f.blobs + 1 END FROM fold f JOIN rows x ON x.key = f.key AND x.r = f.r + 1)
SELECT key AS user_id, began, max(blobs) AS blobs FROM fold GROUP BY key, began HAVING began + 300000000 < (SELECT max(ts) // 1000 * 1000 FROM rows)"""


@query(_AGED)
def stream_pack_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs that a stream flushes because their first blob is 300 seconds old; those still open at the end of the input aren't out yet."""
    e = catalog.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, streams.pack_ages(_stream_of(spark, e, "stream-blobs")), "stream-packs")


@query(
    """SELECT user_id, count(*) AS beats, 'registered' AS event FROM events GROUP BY user_id UNION ALL SELECT user_id, count(*), 'stale' FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 45 MINUTES < (SELECT max(ts) FROM events)"""
)
def stream_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions registered by their first beats, and deregistered where they went stale."""
    e = catalog.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, streams.session_state(_stream_of(spark, e.coalesce(1), "stream-states")), "stream-states").select("user_id", "beats", "event")


@query("SELECT DISTINCT props AS chunk_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference to each chunk in this input, whose range of times the delay covers; state older than that goes."""
    e = catalog.table(spark, sf_dir, "events").select(F.col("props").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, streams.dedup_chunks(_stream_of(spark, e, "stream-refs"), delay="31 days"), "stream-dedup").select("chunk_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches written under their numbers, read back."""
    e = catalog.table(spark, sf_dir, "events").select("event_id", "user_id")
    path = work_dir(spark, "stream-journal")
    streams.drain(streams.journal(_stream_of(spark, e, "stream-beats"), f"{path}/data", f"{path}/state"))
    return spark.read.parquet(f"{path}/data").groupBy("user_id").agg(F.count("*").alias("n"))


__all__ = ["QUERIES"]
