"""The registered queries over the derived catalog, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import accounting, benchstats, check, compaction, diff, find, index, restore, retention, sessions, tree
from ..sources import catalog
from ..sources.catalog import PACK_SQL, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The retention decisions are taken as of this day.
NOW = "2024-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Retention

_RULES = ("hourly", "daily", "weekly", "monthly", "yearly")
_CUTS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
_NEW = ", ".join(f"CASE WHEN lag(date_trunc('{u}', time)) OVER w = date_trunc('{u}', time) THEN 0 ELSE 1 END AS new_{n}" for n, u in _CUTS.items())
_NTH = ", ".join(f"CAST(sum(new_{n}) OVER w AS BIGINT) AS nth_{n}" for n in _RULES)
_WHY = ", ".join(
    [f"CASE WHEN time >= TIMESTAMP '{NOW}' - to_days(keep_within_days) THEN 'within' END", "CASE WHEN rank <= keep_last THEN 'last #' || rank END"]
    + [f"CASE WHEN new_{n} = 1 AND nth_{n} <= keep_{n} THEN '{n} #' || nth_{n} END" for n in _RULES]
)
_ANY = ", ".join(["keep_within_days", "keep_last", *(f"keep_{n}" for n in _RULES)])
RETENTION = f"""SELECT source_label, name, time, CASE WHEN reasons = '' THEN 'prune' ELSE 'keep' END AS decision, reasons FROM (
  SELECT *, CASE WHEN coalesce({_ANY}) IS NULL THEN 'no policy' ELSE concat_ws(', ', {_WHY}) END AS reasons FROM (
    SELECT *, {_NTH} FROM (
      SELECT s.source_label, name, time, ordinal, {_ANY}, row_number() OVER w AS rank, {_NEW}
      FROM snapshots s LEFT JOIN policies p ON s.source_label = p.source_label WINDOW w AS (PARTITION BY s.source_label ORDER BY time DESC, ordinal))
    WINDOW w AS (PARTITION BY source_label ORDER BY time DESC, ordinal ROWS UNBOUNDED PRECEDING)))"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return retention.decide(catalog.snapshots(spark, sf_dir), catalog.policies(spark), now)


@query(with_tables("snapshots policies", RETENTION))
def retention_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@query(with_tables("snapshots policies", "SELECT decision, count(*) AS snapshots, CAST(sum(deduplicated_size) AS BIGINT) AS bytes FROM d JOIN snapshots USING (name) GROUP BY decision", d=RETENTION))
def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.totals(_decisions(spark, sf_dir), catalog.snapshots(spark, sf_dir))


# Find and list

FOUND = find.ItemFilter(path_glob="src*/**/doc_*1", entry_type="file", min_size=100, since=86_400)
_FOUND = "SELECT * FROM items WHERE entry_type = 'file' AND size >= 100 AND mtime_ns >= 86400000000000 AND regexp_matches(path, '^src[^/]*/(?:.*/)?doc_[^/]*1$')"
_STATUS = """SELECT path, snapshot_id, size, CASE WHEN lag(snapshot_id) OVER w IS NULL THEN 'added' WHEN lag(content) OVER w = content AND lag(size) OVER w = size THEN 'unchanged' ELSE 'modified' END AS status
FROM items WINDOW w AS (PARTITION BY path ORDER BY snapshot_id)"""


@query(with_tables("items", "SELECT snapshot_id, path, size, mtime_ns FROM f", f=_FOUND))
def find_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.hits(catalog.items(spark, sf_dir), FOUND).select("snapshot_id", "path", "size", "mtime_ns")


@query(with_tables("items", "SELECT snapshot_id, path, size FROM items WHERE lower(path) LIKE '%doc\\_2_' ESCAPE '\\' AND regexp_matches(path, '(?i)/doc_2[^/]$') AND size <= 5000 AND (path = 'src2' OR starts_with(path, 'src2/'))"))
def find_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.hits(catalog.items(spark, sf_dir), find.ItemFilter(path_glob="DOC_2?", ignore_case=True, prefix="src2", max_size=5000)).select("snapshot_id", "path", "size")


@query(with_tables("items", _STATUS))
def find_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.timeline(catalog.items(spark, sf_dir)).select("path", "snapshot_id", "size", "status")


@query(with_tables("items", "SELECT path, count(*) AS hits, string_agg(snapshot_id || ':' || status, ',' ORDER BY snapshot_id) AS history FROM t GROUP BY path", t=_STATUS))
def find_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.timelines(find.timeline(catalog.items(spark, sf_dir)))


@query(with_tables("items", "SELECT count(DISTINCT path) AS paths, count(*) AS hits, count(DISTINCT snapshot_id) AS snapshots FROM f", f=_FOUND))
def find_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.totals(find.hits(catalog.items(spark, sf_dir), FOUND))


@query(with_tables("items", "SELECT snapshot_id, count(*) AS hits, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY snapshot_id", f=_FOUND))
def find_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.by_snapshot(find.hits(catalog.items(spark, sf_dir), FOUND))


@query(with_tables("items", "SELECT snapshot_id, path FROM items WHERE regexp_matches(path, '^src1.*7$')"))
def restore_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.restore_selection(catalog.items(spark, sf_dir), "src1*7").select("snapshot_id", "path")


@query(with_tables("items", "SELECT snapshot_id, path FROM items WHERE starts_with(path, 'src3/') OR starts_with(path, 'src4/en/') OR path IN ('src3', 'src4/en')"))
def restore_by_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([("src3",), ("src4/en",)], "path string")
    return find.restore_selection(catalog.items(spark, sf_dir), selected=chosen).select("snapshot_id", "path")


_LABEL = "coalesce(nullif(source_label, ''), nullif(label, ''), '-')"


@query(
    with_tables(
        "snapshots",
        """SELECT name, time, CASE WHEN again THEN '' ELSE host END AS host, CASE WHEN again THEN '' ELSE shown END AS label, CASE WHEN format_version <= 1 THEN 'ok' ELSE 'unsupported' END AS state FROM (
  SELECT *, coalesce(lag(host) OVER w = host AND lag(shown) OVER w = shown, false) AS again FROM t WINDOW w AS (ORDER BY time, ordinal))""",
        t=f"SELECT *, split_part(hostname, '.', 1) AS host, {_LABEL} AS shown FROM snapshots ORDER BY time DESC, ordinal DESC LIMIT 200",
    )
)
def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.listing(catalog.snapshots(spark, sf_dir), 200)


@query(with_tables("snapshots", "SELECT name, time, source_label FROM snapshots ORDER BY time DESC, ordinal DESC LIMIT 1"))
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.resolve(catalog.snapshots(spark, sf_dir), "LATEST").select("name", "time", "source_label")


@query(with_tables("snapshots", "SELECT name, time FROM snapshots WHERE source_label = '2-HIGH' ORDER BY time DESC, ordinal DESC LIMIT 10"))
def recent_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.scope(catalog.snapshots(spark, sf_dir), "2-HIGH", 10).select("name", "time")


@query(with_tables("snapshots", "SELECT name, lag(name) OVER (PARTITION BY source_label, hostname ORDER BY time, ordinal) AS parent FROM snapshots"))
def parent_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.parent_snapshot(catalog.snapshots(spark, sf_dir))


# Diff

_SIDE = "SELECT * FROM items WHERE entry_type = 'file' AND snapshot_id = {}"
_DIFF = """SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.content <> b.content THEN 'modified' END AS change,
  a.size AS old_size, b.size AS new_size, coalesce(b.size, 0) - coalesce(a.size, 0) AS delta FROM a FULL JOIN b ON a.path = b.path) WHERE change IS NOT NULL"""


@query(with_tables("items", _DIFF, a=_SIDE.format(2), b=_SIDE.format(5)))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(catalog.items(spark, sf_dir), 2, 5)


@query(with_tables("items", "SELECT change, count(*) AS files, CAST(sum(delta) AS BIGINT) AS bytes FROM c GROUP BY change", a=_SIDE.format(0), b=_SIDE.format(6), c=_DIFF))
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(diff.diff(catalog.items(spark, sf_dir), 0, 6))


# Accounting


@query(with_tables("snapshots", "SELECT count(*) AS snapshots, max(time) AS newest, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, CAST(sum(deduplicated_size) AS BIGINT) AS deduplicated FROM snapshots"))
def repository_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.repository_info(catalog.snapshots(spark, sf_dir))


@query(with_tables("snapshots", "SELECT source_label, count(*) AS snapshots, CAST(sum(original_size) AS BIGINT) AS original FROM snapshots GROUP BY ROLLUP (source_label)"))
def info_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.info_by_label(catalog.snapshots(spark, sf_dir))


@query(with_tables("chunk_index", "SELECT count(*) AS chunks, CAST(sum(stored_size) AS BIGINT) AS unique_bytes, CAST(sum(stored_size * refcount) AS BIGINT) AS referenced_bytes, count(DISTINCT pack_id) AS packs FROM chunk_index"))
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.index_info(catalog.chunk_index(spark, sf_dir))


@query(with_tables("chunk_index", "SELECT chunk_id, refcount, stored_size, pack_id FROM chunk_index"))
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_index(spark, sf_dir)


@query(
    with_tables(
        "chunk_refs",
        """SELECT snapshot_id, count(DISTINCT item_index) AS nfiles, CAST(sum(size) AS BIGINT) AS original, CAST(sum(CASE WHEN n = 1 THEN size ELSE 0 END) AS BIGINT) AS deduplicated FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY snapshot_id, item_index, pos) AS n FROM chunk_refs) GROUP BY snapshot_id""",
    )
)
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.snapshot_stats(catalog.chunk_refs(spark, sf_dir))


@query(with_tables("chunk_refs", "SELECT snapshot_id, count(*) AS new_chunks, CAST(sum(size) AS BIGINT) AS new_bytes FROM (SELECT chunk_id, min(snapshot_id) AS snapshot_id, max(size) AS size FROM chunk_refs GROUP BY chunk_id) GROUP BY snapshot_id"))
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.first_occurrence(catalog.chunk_refs(spark, sf_dir))


DOOMED = [(5, 1), (1, 2), (3, 3), (6, 4)]
_DOOMED = "SELECT * FROM (VALUES (5, 1), (1, 2), (3, 3), (6, 4)) AS d(snapshot_id, place)"


def _doomed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOOMED, "snapshot_id bigint, place bigint")


@query(
    with_tables(
        "chunk_refs chunk_index",
        """SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, CAST(place AS BIGINT) AS place, CAST(count(*) FILTER (WHERE total >= refcount AND total - n < refcount) AS BIGINT) AS chunks_freed,
  CAST(sum(CASE WHEN total >= refcount AND total - n < refcount THEN stored_size ELSE 0 END) AS BIGINT) AS bytes_freed FROM (
  SELECT *, sum(n) OVER (PARTITION BY chunk_id ORDER BY place) AS total FROM (SELECT chunk_id, snapshot_id, place, count(*) AS n FROM chunk_refs JOIN doomed USING (snapshot_id) GROUP BY ALL)) JOIN chunk_index USING (chunk_id) GROUP BY ALL""",
        doomed=_DOOMED,
    )
)
def delete_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.delete_impact(catalog.chunk_refs(spark, sf_dir), catalog.chunk_index(spark, sf_dir), _doomed(spark))


@query(
    with_tables(
        "chunk_refs chunk_index",
        "SELECT chunk_id, i.refcount - coalesce(n, 0) AS refcount, stored_size, pack_id FROM chunk_index i LEFT JOIN gone USING (chunk_id) WHERE i.refcount > coalesce(n, 0)",
        gone="SELECT chunk_id, count(*) AS n FROM chunk_refs WHERE snapshot_id IN (5, 1, 3, 6) GROUP BY chunk_id",
    )
)
def index_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = catalog.chunk_refs(spark, sf_dir).where(F.col("snapshot_id").isin(5, 1, 3, 6)).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return accounting.decrement(catalog.chunk_index(spark, sf_dir), gone)


@query(with_tables("chunk_refs chunk_index", "SELECT chunk_id, r.refcount, stored_size, pack_id FROM chunk_index i JOIN (SELECT chunk_id, count(*) AS refcount FROM chunk_refs WHERE item_index % 13 <> 5 GROUP BY chunk_id) r USING (chunk_id)"))
def rebuilt_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.rebuild_refcounts(catalog.chunk_refs(spark, sf_dir).where("item_index % 13 <> 5"), catalog.chunk_index(spark, sf_dir))


@query("SELECT CAST(l_suppkey % 10 AS BIGINT) AS repo, l_orderkey AS orderkey, l_linenumber AS linenumber, 1000000 + sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) <= 1100000 AS accepted FROM lineitem")
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one number keep their places in the table, by file and row: their order decides which of them is accepted."""
    keys = [f(c) for c in ("l_orderkey", "l_linenumber") for f in (lambda c: F.col(c).isNull().alias(f"{c}_null"), F.col)]  # nulls come last
    ordinal = F.struct(*keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    r = catalog.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("repo"), ordinal.alias("ordinal"), F.rint("l_quantity").cast("long").alias("bytes"))
    return accounting.quota(r, F.lit(1_000_000), F.lit(1_100_000), F.floor(F.col("ordinal.l_orderkey") / 4096)).select("repo", F.col("ordinal.l_orderkey").alias("orderkey"), F.col("ordinal.l_linenumber").alias("linenumber"), "accepted")


# Index maintenance: an index as of snapshots 0 to 3, and a delta of snapshot 4

_OLD = f"SELECT chunk_id, count(*) AS refcount, max(size) AS stored_size, {PACK_SQL} AS pack_id FROM chunk_refs WHERE snapshot_id <= {{}} GROUP BY chunk_id"
_DELTA = {
    "base": _OLD.format(3),
    "now": f"SELECT chunk_id, count(*) AS refcount, max(size) AS stored_size, {PACK_SQL} AS pack_id FROM chunk_refs WHERE snapshot_id <= 3 OR (snapshot_id = 5 AND item_index % 2 = 0) GROUP BY chunk_id",
    "own": f"SELECT chunk_id, count(*) AS refcount, max(size) AS stored_size, {PACK_SQL} AS pack_id FROM chunk_refs WHERE snapshot_id = 5 GROUP BY chunk_id",
    "fresh": "SELECT * FROM own WHERE chunk_id NOT IN (SELECT chunk_id FROM base)",
    "bumps": "SELECT chunk_id, refcount AS n FROM own WHERE chunk_id IN (SELECT chunk_id FROM base)",
    "late": "SELECT chunk_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT chunk_id, n FROM bumps UNION ALL SELECT chunk_id, refcount FROM fresh WHERE chunk_id IN (SELECT chunk_id FROM now)) GROUP BY chunk_id",
    "still": "SELECT * FROM fresh WHERE chunk_id NOT IN (SELECT chunk_id FROM now)",
}


def _entries(refs: DataFrame, pack) -> DataFrame:
    return refs.groupBy("chunk_id").agg(F.count("*").alias("refcount"), F.max("size").alias("stored_size")).withColumn("pack_id", pack)


def _delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The current index, and new entries and bumps made against an older one."""
    refs, pack = catalog.chunk_refs(spark, sf_dir), catalog.pack_of(spark, sf_dir)
    base, own = _entries(refs.where("snapshot_id <= 3"), pack), _entries(refs.where("snapshot_id = 5"), pack)
    now = _entries(refs.where("snapshot_id <= 3 OR (snapshot_id = 5 AND item_index % 2 = 0)"), pack)
    known = base.select("chunk_id")
    return now, own.join(known, "chunk_id", "left_anti"), own.join(known, "chunk_id", "left_semi").select("chunk_id", F.col("refcount").alias("n"))


@query(with_tables("chunk_refs", "SELECT chunk_id, 'new' AS kind, refcount AS n FROM still UNION ALL SELECT chunk_id, 'bump', n FROM late", **_DELTA))
def index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, bumps = index.reconcile(*(x := _delta(spark, sf_dir))[1:], x[0])
    return fresh.select("chunk_id", F.lit("new").alias("kind"), F.col("refcount").alias("n")).unionByName(bumps.select("chunk_id", F.lit("bump").alias("kind"), "n"))


@query(with_tables("chunk_refs", "SELECT chunk_id, CAST(sum(refcount) AS BIGINT) AS refcount, max(stored_size) AS stored_size, max(pack_id) AS pack_id FROM (SELECT * FROM now UNION ALL SELECT * FROM still UNION ALL SELECT chunk_id, n, NULL, NULL FROM late) GROUP BY chunk_id", **_DELTA))
def index_apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, fresh, bumps = _delta(spark, sf_dir)
    return index.apply_delta(now, *index.reconcile(fresh, bumps, now))


@query(with_tables("chunk_refs", "SELECT chunk_id, n FROM bumps WHERE chunk_id NOT IN (SELECT chunk_id FROM part) AND chunk_id NOT IN (SELECT chunk_id FROM fresh)", **_DELTA, part="SELECT * FROM base WHERE refcount > 2"))
def index_stale_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = catalog.chunk_refs(spark, sf_dir)
    _, fresh, bumps = _delta(spark, sf_dir)
    return index.stale_bumps(bumps, fresh, _entries(refs.where("snapshot_id <= 3"), catalog.pack_of(spark, sf_dir)).where("refcount > 2"))


@query(with_tables("chunk_refs", "SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM base) AS stored FROM own", **_DELTA))
def dedup_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = catalog.chunk_refs(spark, sf_dir)
    return index.membership(refs.where("snapshot_id = 5"), _entries(refs.where("snapshot_id <= 3"), catalog.pack_of(spark, sf_dir)))


@query(
    with_tables(
        "chunk_refs",
        "SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM c) THEN 'committed' WHEN chunk_id IN (SELECT chunk_id FROM r) THEN 'recovered' WHEN chunk_id IN (SELECT chunk_id FROM p) THEN 'pending' ELSE 'new' END AS found_in FROM (SELECT DISTINCT chunk_id FROM chunk_refs)",
        c="SELECT * FROM chunk_refs WHERE snapshot_id = 0",
        r="SELECT * FROM chunk_refs WHERE snapshot_id = 1",
        p="SELECT * FROM chunk_refs WHERE snapshot_id = 2",
    )
)
def dedup_lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = catalog.chunk_refs(spark, sf_dir)
    return index.lookup_chain(r, *(r.where(F.col("snapshot_id") == k) for k in range(3)))


@query(with_tables("chunk_refs packs", "SELECT DISTINCT pack_id FROM own WHERE pack_id NOT IN (SELECT pack_id FROM packs)", **_DELTA))
def delta_missing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.missing_packs_of(_entries(catalog.chunk_refs(spark, sf_dir).where("snapshot_id = 5"), catalog.pack_of(spark, sf_dir)), catalog.packs(spark, sf_dir))


@query(with_tables("chunk_refs packs", "SELECT chunk_id, pack_id FROM own WHERE pack_id IN (SELECT pack_id FROM packs) AND chunk_id NOT IN (SELECT chunk_id FROM base)", **_DELTA))
def journal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = catalog.chunk_refs(spark, sf_dir)
    journal = _entries(refs.where("snapshot_id = 5"), catalog.pack_of(spark, sf_dir)).select("chunk_id", "pack_id")
    return index.recover_journal(journal, catalog.packs(spark, sf_dir), _entries(refs.where("snapshot_id <= 3"), catalog.pack_of(spark, sf_dir))).select("chunk_id", "pack_id")


@query(with_tables("chunk_refs", "SELECT chunk_id, refcount FROM fresh WHERE chunk_id IN (SELECT chunk_id FROM chunk_refs WHERE snapshot_id = 6)", **_DELTA))
def journal_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.promote(_delta(spark, sf_dir)[1], catalog.chunk_refs(spark, sf_dir).where("snapshot_id = 6")).select("chunk_id", "refcount")


@query(with_tables("items", "SELECT path, 'drop' AS action FROM items WHERE snapshot_id = 1 AND path NOT IN (SELECT path FROM items WHERE snapshot_id = 2) UNION ALL SELECT path, 'load' FROM items WHERE snapshot_id = 2 AND path NOT IN (SELECT path FROM items WHERE snapshot_id = 1)"))
def cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.items(spark, sf_dir)
    return index.refresh(i.where("snapshot_id = 1"), i.where("snapshot_id = 2"), "path")


# Compaction

_ANALYSED = """SELECT pack_id, size, live, blobs, CASE WHEN size - 9 < live THEN 'corrupt' WHEN live = 0 THEN 'orphan' ELSE 'ok' END AS state, CASE WHEN size - 9 < live THEN 0 ELSE size - 9 - live END AS dead
FROM (SELECT p.pack_id, p.size, coalesce(live, 0) AS live, coalesce(blobs, 0) AS blobs FROM packs p LEFT JOIN (SELECT pack_id, CAST(sum(stored_size + 4) AS BIGINT) AS live, count(*) AS blobs FROM chunk_index GROUP BY pack_id) l ON p.pack_id = l.pack_id)"""
_CHOSEN = "SELECT pack_id, size, live, dead, blobs, CASE WHEN state = 'orphan' THEN 'delete' ELSE 'repack' END AS action FROM analysed WHERE state <> 'corrupt' AND dead > 0 AND (state = 'orphan' OR dead * 100.0 / (size - 9) >= 20)"
_CAPPED = "SELECT * EXCLUDE (before) FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY dead DESC, pack_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chosen) WHERE before < 1000000"


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.analyse(catalog.packs(spark, sf_dir), catalog.chunk_index(spark, sf_dir))


@query(with_tables("packs", "SELECT pack_id, size, live, blobs, state, dead FROM analysed", analysed=_ANALYSED))
def compact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("pack_id", "size", "live", "blobs", "state", "dead")


@query(with_tables("packs", "SELECT * FROM chosen", analysed=_ANALYSED, chosen=_CHOSEN))
def compact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.candidates(_analysed(spark, sf_dir), 20.0)


@query(with_tables("packs", _CAPPED, analysed=_ANALYSED, chosen=_CHOSEN))
def compact_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.candidates(_analysed(spark, sf_dir), 20.0, cap=1_000_000)


@query(with_tables("packs", "SELECT count(*) AS packs, count(*) FILTER (WHERE state = 'corrupt') AS corrupt, count(*) FILTER (WHERE state = 'orphan') AS orphan, CAST(sum(blobs) AS BIGINT) AS live_blobs, CAST(sum(dead) AS BIGINT) AS dead_bytes FROM analysed", analysed=_ANALYSED))
def compact_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.counters(_analysed(spark, sf_dir))


_OFFSETS = "SELECT chunk_id, refcount, stored_size, pack_id, CAST(9 + coalesce(sum(stored_size + 4) OVER (PARTITION BY pack_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4 AS BIGINT) AS pack_offset FROM {}"


@query(with_tables("chunk_index", "SELECT chunk_id, pack_id, pack_offset FROM o", o=_OFFSETS.format("chunk_index")))
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.pack_offsets(catalog.chunk_index(spark, sf_dir)).select("chunk_id", "pack_id", "pack_offset")


@query(
    with_tables(
        "packs",
        "SELECT chunk_id, pack_id, pack_offset FROM stay UNION ALL SELECT chunk_id, pack_id, pack_offset FROM moved",
        analysed=_ANALYSED,
        chosen=_CHOSEN,
        o=_OFFSETS.format("chunk_index"),
        stay="SELECT * FROM o WHERE pack_id NOT IN (SELECT pack_id FROM chosen)",
        m="SELECT chunk_id, refcount, stored_size, pack_id || '-new' AS pack_id FROM o WHERE pack_id IN (SELECT pack_id FROM chosen WHERE action = 'repack')",
        moved=_OFFSETS.format("m"),
    )
)
def compact_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.relocate(catalog.chunk_index(spark, sf_dir), compaction.candidates(_analysed(spark, sf_dir), 20.0)).select("chunk_id", "pack_id", "pack_offset")


@query(with_tables("chunk_index", "SELECT pack_id, CAST(CASE WHEN count(stored_size) FILTER (WHERE refcount > 3) = 0 THEN 0 ELSE 9 + sum(stored_size + 4) FILTER (WHERE refcount > 3) END AS BIGINT) AS output_size FROM chunk_index GROUP BY pack_id"))
def repack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("refcount") > 3, F.col("stored_size"))
    return catalog.chunk_index(spark, sf_dir).groupBy("pack_id").agg(compaction.estimate_size(kept))


# Integrity

_MISSING = "SELECT pack_id, count(*) AS chunks FROM chunk_index WHERE pack_id NOT IN (SELECT pack_id FROM packs) GROUP BY pack_id"
_HIT = "SELECT snapshot_id, item_index, count(DISTINCT chunk_id) AS chunks, string_agg(DISTINCT i.pack_id, ',' ORDER BY i.pack_id) AS packs FROM chunk_refs r JOIN chunk_index i USING (chunk_id) WHERE i.pack_id IN (SELECT pack_id FROM missing) GROUP BY snapshot_id, item_index"
_PART = "SELECT * FROM chunk_index WHERE substring(chunk_id, 3, 2) <> '0f'"
_INVALID = """SELECT * FROM (SELECT i.snapshot_id, i.item_index, CASE WHEN entry_type = 'file' AND coalesce(b, 0) <> size THEN 'chunk sizes don''t make up the size' WHEN entry_type = 'symlink' THEN 'symlink without target' END AS reason
FROM items i LEFT JOIN (SELECT snapshot_id, item_index, sum(size) AS b FROM chunk_refs GROUP BY ALL) r ON i.snapshot_id = r.snapshot_id AND i.item_index = r.item_index) WHERE reason IS NOT NULL"""
_REMOVED = "SELECT chunk_id FROM chunk_index WHERE substring(pack_id, 1, 2) IN ('a0', 'b1') OR substring(chunk_id, 1, 4) = 'ffff'"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_index(spark, sf_dir).where("substring(chunk_id, 3, 2) <> '0f'")


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.chunk_index(spark, sf_dir)
    gone = check.missing_packs(i, catalog.packs(spark, sf_dir))
    corrupt = _analysed(spark, sf_dir).where("state = 'corrupt'")
    return check.chunks_to_remove(i, gone, corrupt, i.where("substring(chunk_id, 1, 4) = 'ffff'"))


@query(with_tables("chunk_refs chunk_index", "SELECT snapshot_id, item_index, pos, chunk_id FROM chunk_refs WHERE chunk_id NOT IN (SELECT chunk_id FROM part)", part=_PART))
def dangling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.dangling_chunks(catalog.chunk_refs(spark, sf_dir), _part(spark, sf_dir)).select("snapshot_id", "item_index", "pos", "chunk_id")


@query(with_tables("packs", _MISSING))
def missing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.missing_packs(catalog.chunk_index(spark, sf_dir), catalog.packs(spark, sf_dir))


@query(with_tables("packs", "SELECT pack_id, size FROM packs WHERE pack_id NOT IN (SELECT pack_id FROM chunk_index)"))
def orphan_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.orphan_packs(catalog.chunk_index(spark, sf_dir), catalog.packs(spark, sf_dir)).select("pack_id", F.col("size").cast("long").alias("size"))


@query(with_tables("packs", _HIT, missing=_MISSING))
def items_in_missing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.chunk_index(spark, sf_dir)
    return check.items_in_packs(catalog.chunk_refs(spark, sf_dir), i, check.missing_packs(i, catalog.packs(spark, sf_dir)))


@query(with_tables("items chunk_refs", _INVALID))
def invalid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.validate_items(catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir))


@query(
    with_tables(
        "packs items",
        """SELECT 'dangling_file_chunk' AS kind, snapshot_id, item_index, chunk_id, NULL AS pack_id, NULL AS detail FROM chunk_refs WHERE chunk_id NOT IN (SELECT chunk_id FROM part)
UNION ALL SELECT 'missing_pack', NULL, NULL, NULL, pack_id, chunks || ' chunks' FROM missing
UNION ALL SELECT 'orphan_pack', NULL, NULL, NULL, pack_id, NULL FROM packs WHERE pack_id NOT IN (SELECT pack_id FROM part)
UNION ALL SELECT 'item_in_missing_pack', snapshot_id, item_index, NULL, NULL, packs FROM hit
UNION ALL SELECT 'invalid_item', snapshot_id, item_index, NULL, NULL, reason FROM invalid""",
        part=_PART,
        missing=_MISSING.replace("chunk_index", "part"),
        hit=_HIT.replace("chunk_index", "part"),
        invalid=_INVALID,
    )
)
def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.scan(catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir), _part(spark, sf_dir), catalog.packs(spark, sf_dir))


@query(with_tables("chunk_refs packs", "SELECT (SELECT count(DISTINCT snapshot_id) FROM chunk_refs) AS snapshots, (SELECT count(*) FROM (SELECT DISTINCT snapshot_id, item_index FROM chunk_refs)) AS items, (SELECT count(*) FROM chunk_refs) AS refs, count(*) AS chunks, count(p.pack_id) AS chunks_present FROM chunk_index i LEFT JOIN packs p ON i.pack_id = p.pack_id"))
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.counters(catalog.chunk_refs(spark, sf_dir), catalog.chunk_index(spark, sf_dir), catalog.packs(spark, sf_dir))


@query(with_tables("packs", _REMOVED))
def chunks_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark, sf_dir)


@query(with_tables("packs", "SELECT snapshot_id, count(DISTINCT chunk_id) AS lost_chunks FROM chunk_refs WHERE chunk_id IN (SELECT chunk_id FROM removed) GROUP BY snapshot_id", removed=_REMOVED))
def doomed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.doomed_snapshots(catalog.chunk_refs(spark, sf_dir), _removed(spark, sf_dir))


@query(
    with_tables(
        "packs items",
        """SELECT snapshot_id, CASE WHEN snapshot_id = 4 THEN 'remove_snapshot' WHEN coalesce(lost_items, 0) = 0 THEN 'keep' WHEN lost_items >= files THEN 'remove_snapshot' ELSE 'drop_items' END AS action, items, coalesce(lost_items, 0) AS lost_items, coalesce(lost_chunks, 0) AS lost_chunks
FROM (SELECT snapshot_id, count(*) AS items, count(*) FILTER (WHERE entry_type = 'file') AS files FROM items GROUP BY snapshot_id) LEFT JOIN (SELECT snapshot_id, count(DISTINCT item_index) AS lost_items, count(DISTINCT chunk_id) AS lost_chunks FROM chunk_refs WHERE chunk_id IN (SELECT chunk_id FROM removed) GROUP BY snapshot_id) USING (snapshot_id)""",
        removed=_REMOVED,
    )
)
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.createDataFrame([(4,)], "snapshot_id bigint")
    return check.repair_plan(catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir), _removed(spark, sf_dir), bad)


@query(
    with_tables(
        "packs items",
        "SELECT snapshot_id, count(*) AS nfiles, CAST(sum(size) AS BIGINT) AS original_size FROM items WHERE entry_type = 'file' AND (snapshot_id, item_index) NOT IN (SELECT (snapshot_id, item_index) FROM chunk_refs WHERE chunk_id IN (SELECT chunk_id FROM removed)) GROUP BY snapshot_id",
        removed=_REMOVED,
    )
)
def rewritten_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.rewritten_stats(catalog.items(spark, sf_dir), catalog.chunk_refs(spark, sf_dir), _removed(spark, sf_dir))


@query("SELECT count(*) AS sampled FROM (SELECT row_number() OVER () AS n FROM lineitem) WHERE n <= greatest(1, (SELECT CAST(ceil(count(*) * 7 / 100) AS BIGINT) FROM lineitem))")
def sampled_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.sample_exact(catalog.table(spark, sf_dir, "lineitem"), 7, F.struct("l_orderkey", "l_linenumber")).agg(F.count("*").alias("sampled"))


_VERIFY = {
    "expected": "SELECT o_orderkey AS pack_key FROM orders WHERE o_orderkey % 3 <> 0",
    "answers": "SELECT o_orderkey AS pack_key, 1 AS ordinal, o_orderkey % 5 <> 0 AS ok FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 2, true FROM orders WHERE o_orderkey % 11 = 0",
}


@query(
    "WITH "
    + ", ".join(f"{k} AS ({v})" for k, v in _VERIFY.items())
    + """ SELECT coalesce(e.pack_key, a.pack_key) AS pack_key, CASE WHEN e.pack_key IS NULL THEN 'unexpected' WHEN a.n IS NULL THEN 'missing' WHEN a.n > 1 THEN 'duplicate' WHEN a.ok THEN 'verified' ELSE 'failed' END AS outcome
FROM expected e FULL JOIN (SELECT *, row_number() OVER (PARTITION BY pack_key ORDER BY ordinal) AS n FROM answers) a ON e.pack_key = a.pack_key"""
)
def verify_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = catalog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_key"))
    ok, yes = F.col("pack_key") % 5 != 0, F.lit(True)
    first = k.where("pack_key % 4 <> 0").select("pack_key", F.lit(1).alias("ordinal"), ok.alias("hash_valid"), yes.alias("header_valid"), yes.alias("blobs_valid"))
    again = k.where("pack_key % 11 = 0").select("pack_key", F.lit(2).alias("ordinal"), yes.alias("hash_valid"), yes.alias("header_valid"), yes.alias("blobs_valid"))
    return check.verify_reconcile(k.where("pack_key % 3 <> 0"), first.unionByName(again))


# Restore


@query(with_tables("chunk_refs chunk_index", "SELECT snapshot_id, item_index, pos, r.chunk_id, i.pack_id, i.stored_size FROM chunk_refs r LEFT JOIN part i ON r.chunk_id = i.chunk_id WHERE snapshot_id = 2", part=_PART))
def restore_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.locate(catalog.chunk_refs(spark, sf_dir).where("snapshot_id = 2"), _part(spark, sf_dir)).select("snapshot_id", "item_index", "pos", "chunk_id", "pack_id", "stored_size")


_PLACED = "SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY snapshot_id, item_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM chunk_refs"


@query(with_tables("chunk_refs", "SELECT snapshot_id, item_index, pos, file_offset FROM p", p=_PLACED))
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.file_offsets(catalog.chunk_refs(spark, sf_dir)).select("snapshot_id", "item_index", "pos", "file_offset")


@query(with_tables("chunk_refs", "SELECT chunk_id, count(*) AS targets, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS least, max(size) AS most FROM chunk_refs GROUP BY chunk_id"))
def chunk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.chunk_targets(catalog.chunk_refs(spark, sf_dir))


@query("SELECT chunk_id, min(size) AS least, max(size) AS most FROM (SELECT CAST(l_partkey AS VARCHAR) AS chunk_id, CAST(l_quantity AS BIGINT) AS size FROM lineitem) GROUP BY chunk_id HAVING min(size) <> max(size)")
def inconsistent_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = catalog.table(spark, sf_dir, "lineitem")
    return restore.inconsistent_sizes(li.select(F.col("l_partkey").cast("string").alias("chunk_id"), F.col("l_quantity").cast("long").alias("size")))


_PRINTS = "SELECT snapshot_id, item_index, sha256(string_agg(chunk_id, '' ORDER BY pos)) AS fingerprint, CAST(sum(size) AS BIGINT) AS size FROM chunk_refs GROUP BY snapshot_id, item_index"


@query(with_tables("chunk_refs", _PRINTS))
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.fingerprints(catalog.chunk_refs(spark, sf_dir))


_LINKS = """SELECT snapshot_id, item_index, CASE WHEN row_number() OVER w = 1 THEN 'primary' WHEN first_value(size) OVER w = size AND first_value(fingerprint) OVER w = fingerprint THEN 'link' ELSE 'copy' END AS kind, size
FROM prints WINDOW w AS (PARTITION BY item_index % 50 ORDER BY snapshot_id, item_index)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = restore.fingerprints(catalog.chunk_refs(spark, sf_dir)).withColumns({"dev": F.lit(1), "ino": F.col("item_index") % 50, "ordinal": F.struct("snapshot_id", "item_index")})
    return restore.hard_links(files)


@query(with_tables("chunk_refs", _LINKS, prints=_PRINTS))
def hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("snapshot_id", "item_index", "kind", "size")


@query(with_tables("chunk_refs", "SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY kind", prints=_PRINTS, k=_LINKS))
def hard_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.link_counts(_linked(spark, sf_dir))


@query(with_tables("items", "SELECT count(*) FILTER (WHERE entry_type = 'file') AS files, count(*) FILTER (WHERE entry_type = 'dir') AS dirs, count(*) FILTER (WHERE entry_type = 'symlink') AS symlinks, CAST(sum(CASE WHEN entry_type = 'file' THEN size ELSE 0 END) AS BIGINT) AS bytes FROM items"))
def restore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.stats(catalog.items(spark, sf_dir))


@query(with_tables("chunk_refs", "SELECT * FROM (SELECT snapshot_id, item_index, pos, chunk_id, greatest(file_offset, 700) - file_offset AS chunk_start, least(file_offset + size, 2200) - greatest(file_offset, 700) AS length FROM p) WHERE length > 0", p=_PLACED))
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.range_read(catalog.chunk_refs(spark, sf_dir), 700, 1500)


_GAPS = """SELECT chunk_id, pack_id, pack_offset, CAST(sum(fresh) OVER (PARTITION BY pack_id ORDER BY pack_offset) AS BIGINT) AS read_group FROM (
  SELECT *, CASE WHEN pack_offset - max(pack_offset + stored_size) OVER (PARTITION BY pack_id ORDER BY pack_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 600 OR row_number() OVER (PARTITION BY pack_id ORDER BY pack_offset) = 1 THEN 1 ELSE 0 END AS fresh FROM o WHERE chunk_id IN (SELECT chunk_id FROM chunk_refs WHERE snapshot_id = 2))"""


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a restore of a snapshot reads, placed."""
    refs = catalog.chunk_refs(spark, sf_dir).where("snapshot_id = 2")
    return compaction.pack_offsets(catalog.chunk_index(spark, sf_dir)).join(refs, "chunk_id", "left_semi")


@query(with_tables("chunk_index", _GAPS, o=_OFFSETS.format("chunk_index")))
def read_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.gap_groups(_wanted(spark, sf_dir), 600).select("chunk_id", "pack_id", "pack_offset", "read_group")


@query(
    with_tables(
        "chunk_index",
        """SELECT pack_id, s AS read_start, max(e) AS read_end, count(*) AS blobs FROM fold GROUP BY pack_id, s""",
        o=_OFFSETS.format("chunk_index"),
        wanted="SELECT pack_id, pack_offset AS a, pack_offset + stored_size AS b, row_number() OVER (PARTITION BY pack_id ORDER BY pack_offset) AS n FROM o WHERE chunk_id IN (SELECT chunk_id FROM chunk_refs WHERE snapshot_id = 2)",
        fold="""SELECT pack_id, n, a AS s, b AS e FROM wanted WHERE n = 1 UNION ALL
  SELECT w.pack_id, w.n, CASE WHEN w.a - f.e <= 600 AND greatest(w.b, f.e) - f.s <= 4096 THEN f.s ELSE w.a END, CASE WHEN w.a - f.e <= 600 AND greatest(w.b, f.e) - f.s <= 4096 THEN greatest(w.b, f.e) ELSE w.b END FROM fold f JOIN wanted w ON w.pack_id = f.pack_id AND w.n = f.n + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.read_groups(_wanted(spark, sf_dir), 600, 4096)


@query(with_tables("items", "SELECT snapshot_id, item_index, CAST(segment AS BIGINT) AS segment, CAST(segment * 1000 AS BIGINT) AS start, CAST(least(size - segment * 1000, 1000) AS BIGINT) AS length FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(size / 1000) AS BIGINT), 1))) AS segment FROM items)"))
def file_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.segments(catalog.items(spark, sf_dir), 1000).select("snapshot_id", "item_index", "segment", "start", "length")


# Trees

_PATHS = "SELECT DISTINCT path FROM items"
_UP = "SELECT path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS up FROM paths"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.items(spark, sf_dir).select("path").distinct()


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.regexp_extract("path", r"doc_(\d+)$", 1).try_cast("long")
    return _paths(spark, sf_dir).withColumns({"checked": (id_ % 10 != 3) | F.col("path").startswith("src1/"), "origin": id_ % 4})


_MARKS = "SELECT path, id % 10 <> 3 OR starts_with(path, 'src1/') AS checked, id % 4 AS origin FROM (SELECT path, CAST(regexp_extract(path, 'doc_(\\d+)$', 1) AS BIGINT) AS id FROM paths)"


@query(with_tables("items", "SELECT DISTINCT up AS path FROM up WHERE up NOT IN (SELECT path FROM paths)", paths=_PATHS, up=_UP))
def implicit_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.implicit_dirs(_paths(spark, sf_dir))


_NODES = "SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, CAST(len(string_split(path, '/')) AS INTEGER) AS depth, is_dir, files FROM (SELECT path, false AS is_dir, CAST(1 AS BIGINT) AS files FROM paths UNION ALL SELECT up, true, count(*) FROM up GROUP BY up)"


@query(with_tables("items", _NODES, paths=_PATHS, up=_UP))
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(_paths(spark, sf_dir))


@query(with_tables("items", "SELECT path, is_dir, files FROM n WHERE parent = 'src5'", paths=_PATHS, up=_UP, n=_NODES))
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(tree.nodes(_paths(spark, sf_dir)), "src5").select("path", "is_dir", "files")


@query(with_tables("items", "SELECT up AS path, count(DISTINCT origin) AS origins, count(DISTINCT origin) > 1 AS mixed FROM up JOIN marks USING (path) GROUP BY up", paths=_PATHS, up=_UP, marks=_MARKS))
def mixed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.mixed_origins(_marks(spark, sf_dir))


_STATE = "SELECT up AS path, CASE WHEN bool_and(checked) THEN 'all' WHEN bool_or(checked) THEN 'some' ELSE 'none' END AS state FROM up JOIN marks USING (path) GROUP BY up"


@query(with_tables("items", _STATE, paths=_PATHS, up=_UP, marks=_MARKS))
def check_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.check_state(_marks(spark, sf_dir))


@query(
    with_tables(
        "items",
        "SELECT path FROM full_ WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) NOT IN (SELECT path FROM full_) AND regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) NOT IN (SELECT path FROM full_) UNION ALL SELECT path FROM marks WHERE checked AND path NOT IN (SELECT path FROM up WHERE up IN (SELECT path FROM full_))",
        paths=_PATHS,
        up=_UP,
        marks=_MARKS,
        full_=f"SELECT path FROM ({_STATE}) WHERE state = 'all'",
    )
)
def minimal_checked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.minimal_checked(_marks(spark, sf_dir))


@query(with_tables("items", "SELECT path, depth FROM n WHERE depth = 1 OR (parent = 'src2') OR (parent = 'src2/en') OR parent = 'src7'", paths=_PATHS, up=_UP, n=_NODES))
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = spark.createDataFrame([("src2",), ("src2/en",), ("src7",), ("src9/fr",)], "path string")
    return tree.visible(tree.nodes(_paths(spark, sf_dir)), open_).select("path", "depth")


@query(with_tables("items", "SELECT 'src3/en' AS prefix FROM (SELECT count(*) AS n FROM paths WHERE starts_with(path, 'src3/en/')) WHERE n > 1", paths=_PATHS))
def common_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.common_prefix(_paths(spark, sf_dir).where("startswith(path, 'src3/en/')"))


# Sessions and sets


@query(
    """SELECT user_id, count(*) AS beats, min(ts) AS registered, max(ts) AS last_refresh FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(catalog.table(spark, sf_dir, "events"))


@query("SELECT user_id, max(ts) AS last_refresh, count(*) AS beats, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 45 MINUTES AS stale FROM events GROUP BY user_id")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return sessions.latest_state(e).withColumn("stale", sessions.stale(F.col("last_refresh"), F.lit(now).cast("timestamp_ntz")))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_id % 4 <> 1 THEN 'rebooted' WHEN user_id % 3 = 0 AND event_id % 7 NOT IN (1, 2) THEN 'dead process' WHEN ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 6 HOURS THEN 'expired' ELSE 'held' END AS state FROM events")
def lock_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "events")
    locks = e.select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("hostname"), (F.col("event_id") % 7).alias("pid"), F.col("ts").alias("time"), F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("boot_id"))
    return sessions.lock_state(locks, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "h0", "b1", [1, 2]).select("event_id", "state")


@query("SELECT c_name AS name, count(DISTINCT repo) AS repos, min(repo) AS repo, CASE WHEN count(DISTINCT repo) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM (SELECT o_orderkey // 3 AS c_name, o_orderpriority AS repo FROM orders) GROUP BY c_name")
def snapshot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders")
    return sessions.resolve_targets(o.select(F.floor(F.col("o_orderkey") / 3).alias("name"), F.col("o_orderpriority").alias("repo")))


@query("SELECT DISTINCT o_orderpriority AS repo FROM orders WHERE o_custkey % 500 = 7 INTERSECT SELECT o_orderpriority FROM orders WHERE o_custkey % 500 = 8")
def diff_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("name"), F.col("o_orderpriority").alias("repo"))
    return sessions.diff_targets(o, 7, 8)


@query("SELECT path, side FROM (SELECT path, 'before' AS side FROM (SELECT path FROM a EXCEPT ALL SELECT path FROM b) UNION ALL SELECT path, 'after' FROM (SELECT path FROM b EXCEPT ALL SELECT path FROM a))".join([with_tables("items", "", a="SELECT path FROM items WHERE snapshot_id = 3", b="SELECT path FROM items WHERE snapshot_id = 4"), ""]))
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.items(spark, sf_dir)
    return sessions.changed_sets(i.where("snapshot_id = 3").select("path"), i.where("snapshot_id = 4").select("path"))


@query(with_tables("items", "SELECT b.path, a.path IS NOT NULL AS unchanged FROM (SELECT * FROM items WHERE snapshot_id = 4) b LEFT JOIN (SELECT * FROM items WHERE snapshot_id = 3) a ON a.path = b.path AND a.mtime_ns = b.mtime_ns AND a.size = b.size"))
def file_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = catalog.items(spark, sf_dir).withColumns({"device": F.lit(1), "inode": F.col("item_index"), "ctime_ns": F.col("mtime_ns")})
    return sessions.reuse(i.where("snapshot_id = 4"), i.where("snapshot_id = 3")).select("path", "unchanged")


# Statistics of runs


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = catalog.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("phase"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("duration_s"), F.col("l_extendedprice").cast("long").cast("double").alias("bytes"), F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0).alias("exit_status"), (F.col("l_discount") < 0.05).alias("ok"), F.col("l_orderkey").alias("ordinal"))


_RUNS = "SELECT l_returnflag AS tool, l_linestatus AS phase, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS duration_s, CAST(trunc(l_extendedprice) AS DOUBLE) AS bytes, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS exit_status, l_discount < 0.05 AS ok, l_orderkey AS ordinal FROM lineitem"


@query(f"SELECT tool, phase, round(avg(duration_s), 6) AS duration_mean, round(coalesce(stddev_samp(duration_s), 0), 6) AS duration_std, round(avg(bytes), 3) AS bytes_mean, round(coalesce(stddev_samp(bytes), 0), 3) AS bytes_std, count(*) AS run_count, count(*) FILTER (WHERE exit_status <> 0) AS failed_runs FROM ({_RUNS}) GROUP BY tool, phase")
def bench_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = benchstats.records(_runs(spark, sf_dir))
    return r.select("tool", "phase", *(F.round(c, 6).alias(c) for c in ("duration_mean", "duration_std")), *(F.round(c, 3).alias(c) for c in ("bytes_mean", "bytes_std")), "run_count", "failed_runs")


@query(f"SELECT count(duration_s) AS count, round(avg(duration_s), 6) AS duration_mean, round(stddev_samp(duration_s), 6) AS duration_std, min(duration_s) AS least, max(duration_s) AS most FROM ({_RUNS})")
def bench_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = benchstats.timing(_runs(spark, sf_dir))
    return r.select("count", F.round("duration_mean", 6).alias("duration_mean"), F.round("duration_std", 6).alias("duration_std"), "least", "most")


@query(f"SELECT tool AS action, phase AS label, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, min(ordinal) AS first FROM ({_RUNS}) GROUP BY tool, phase")
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.summary(_runs(spark, sf_dir).withColumnsRenamed({"tool": "action", "phase": "label"}))


@query(
    """SELECT coalesce(a.op, b.op) AS op, CASE WHEN a.run_count > 0 THEN a.run_count ELSE coalesce(b.run_count, a.run_count) END AS run_count, CASE WHEN a.run_count > 0 THEN a.total ELSE coalesce(b.total, a.total) END AS total
FROM (SELECT o_custkey AS op, count(*) FILTER (WHERE o_orderstatus = 'F') AS run_count, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders WHERE o_orderpriority < '3' GROUP BY o_custkey) a
FULL JOIN (SELECT o_custkey AS op, count(*) AS run_count, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders WHERE o_orderpriority >= '3' GROUP BY o_custkey) b ON a.op = b.op"""
)
def bench_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders").withColumn("p", F.floor("o_totalprice").cast("long"))
    own = o.where("o_orderpriority < '3'").groupBy(F.col("o_custkey").alias("op")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("run_count"), F.sum("p").alias("total"))
    other = o.where("o_orderpriority >= '3'").groupBy(F.col("o_custkey").alias("op")).agg(F.count("*").alias("run_count"), F.sum("p").alias("total"))
    return benchstats.merge(own, other)


@query(with_tables("items", "SELECT entry_type, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM items GROUP BY entry_type"))
def corpus_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.type_counts(catalog.items(spark, sf_dir))


# Scalars


@query(
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN k < 102400 THEN k // 100 || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || ' KiB' ELSE m // 100 || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') || ' MiB' END AS size,
  CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' WHEN s >= 60 THEN s // 60 || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration,
  CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h' WHEN s >= 3600 THEN s // 3600 || 'h' WHEN s >= 60 THEN s // 60 || 'm' ELSE s || 's' END AS age, format('{:,}', n) AS grouped, round((1 - CAST(n AS DOUBLE) / 600000) * 100, 1) + 0.0 AS savings
FROM (SELECT o_orderkey, n, s, (n * 100 + 512) // 1024 AS k, (n * 100 + 524288) // 1048576 AS m FROM (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 100000) AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders))"""
)
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 100000).cast("long").alias("n"), F.floor("o_totalprice").cast("long").alias("s"))
    return o.select("o_orderkey", S.format_bytes("n").alias("size"), S.format_duration("s").alias("duration"), S.format_age("s").alias("age"), S.format_count("n").alias("grouped"), S.savings_percent("n", F.lit(600000)).alias("savings"))


@query(
    """SELECT o_orderkey, CAST(n * CASE u WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 604800 WHEN 3 THEN 2592000 WHEN 4 THEN 31536000 ELSE 86400 END AS BIGINT) AS timespan,
  CAST(CASE WHEN n = 0 THEN NULL ELSE n * CASE u WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 3 THEN 60 WHEN 5 THEN 86400 END END AS BIGINT) AS schedule, CAST((n * 10 + 5) * CASE u WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END // 10 AS BIGINT) AS bytes
FROM (SELECT o_orderkey, o_orderkey % 40 AS n, o_orderkey % 6 AS u FROM orders)"""
)
def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = catalog.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).cast("string").alias("n"), (F.col("o_orderkey") % 6).cast("int").alias("u"))
    unit = F.element_at(F.array(*map(F.lit, ("h", "d", "w", "m", "y", ""))), F.col("u") + 1)
    size = F.element_at(F.array(*map(F.lit, ("K", "MiB", " gb", "B", "", ""))), F.col("u") + 1)
    return o.select("o_orderkey", S.timespan_seconds(F.concat("n", unit)).alias("timespan"), S.interval_seconds(F.concat("n", unit)).alias("schedule"), S.parse_size(F.concat("n", F.lit(".5"), size)).alias("bytes"))


@query(
    with_tables(
        "items",
        """SELECT snapshot_id, item_index, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, CAST(3 AS INTEGER) AS depth, CAST(mode // 512 % 8 AS VARCHAR) || CAST(mode // 64 % 8 AS VARCHAR) || CAST(mode // 8 % 8 AS VARCHAR) || CAST(mode % 8 AS VARCHAR) AS mode,
  strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d %H:%M:%S') AS mtime, '''' || path || '''' AS quoted, 'packs/' || substring(sha256(path), 1, 2) || '/' || sha256(path) AS pack_key, substring(sha256(path), 1, 16) AS short FROM items""",
    )
)
def item_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("path", 256)
    return catalog.items(spark, sf_dir).select(
        "snapshot_id", "item_index", S.file_name("path").alias("name"), S.parent_path("path").alias("parent"), S.depth("path").alias("depth"), S.octal_mode("mode").alias("mode"), S.mtime_string("mtime_ns").alias("mtime"), S.shell_escape("path").alias("quoted"), S.pack_key(h).alias("pack_key"), S.short_id(h).alias("short")
    )


_KEYS = ("config", "manifest", "snapshots/ab", "packs/0f/", "../packs/x", "locks/a.json", ".tmp.1", "packs//x", "index", "a/./b")


@query(
    """SELECT p_partkey, k IN ('config', 'manifest', 'index') OR regexp_matches(k, '^(snapshots|locks|sessions|keys|packs|pending_index)/.+$') AS known, NOT list_has_any(string_split(k, '/'), ['', '.', '..']) AS safe, starts_with(list_extract(string_split(rtrim(k, '/'), '/'), -1), '.tmp') AS temp,
  regexp_matches('packs/' || substring(h, 1, 2) || '/' || h, '^/*packs/[0-9a-fA-F]{2}/[0-9a-fA-F]{64}/*$') AS pack, CASE WHEN starts_with(k, '/') THEN 'absolute' WHEN list_contains(string_split(k, '/'), '..') THEN 'escapes' ELSE 'safe' END AS target
FROM (SELECT p_partkey, list_extract(['config', 'manifest', 'snapshots/ab', 'packs/0f/', '../packs/x', 'locks/a.json', '.tmp.1', 'packs//x', 'index', 'a/./b'], p_partkey % 10 + 1) AS k, substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 60 + CAST(p_partkey % 2 AS INTEGER) * 4) AS h FROM part)"""
)
def key_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    h = F.expr("substring(sha2(CAST(p_partkey AS STRING), 256), 1, 60 + CAST(p_partkey % 2 AS INT) * 4)")
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", k.alias("k"), h.alias("h"))
    return p.select("p_partkey", S.known_repo_key("k").alias("known"), S.safe_relative_path("k").alias("safe"), S.temp_file("k").alias("temp"), S.valid_pack_key(S.pack_key("h")).alias("pack"), S.symlink_class("k").alias("target"))


@query("SELECT n AS packs, CAST(least(greatest(floor(33554432 * sqrt(CAST(n AS DOUBLE) / 50)), 33554432), 201326592) AS BIGINT) AS target FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def pack_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select(F.col("n").alias("packs"), S.pack_target("n", F.lit(32 << 20), F.lit(192 << 20)).alias("target"))
