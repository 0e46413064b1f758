"""Sessions, locks, configuration sets, and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds after which a session, and a lock, are stale.
SESSION_STALE, LOCK_STALE = 45 * 60, 6 * 3600
#: Repositories of a configuration.
MOST_REPOS = 10_000


def sessions(events: DataFrame, gap: str = "45 minutes") -> DataFrame:
    """Heartbeats grouped into sessions that end after a gap."""
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"), F.min("ts").alias("registered"), F.max("ts").alias("last_refresh"))
    return w.drop("w")


def stale(last_refresh: Column, now: Column, seconds: int = SESSION_STALE) -> Column:
    """Strictly older than the limit."""
    return last_refresh < now - F.make_dt_interval(secs=F.lit(float(seconds)))


def latest_state(events: DataFrame) -> DataFrame:
    """The last heartbeat of each session."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_refresh"), F.count("*").alias("beats"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))


def lock_state(locks: DataFrame, now: Column, host: str, boot_id: str, live_pids: list[int]) -> DataFrame:
    """held, or why a lock may go: another boot of this host, a dead process of it, or its age."""
    here = F.col("hostname") == host
    state = (
        F.when(here & F.col("boot_id").isNotNull() & (F.col("boot_id") != boot_id), "rebooted")
        .when(here & ~F.col("pid").isin(live_pids), "dead process")
        .when(stale(F.col("time"), now, LOCK_STALE), "expired")
        .otherwise("held")
    )
    return locks.withColumn("state", state)


def journal_points(packs: DataFrame, every: int = 8) -> DataFrame:
    """(session, seq, journal): the packs after which a session's journal is written."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    return packs.withColumn("_n", n).where(F.col("_n") % every == 0).withColumn("journal", F.floor(F.col("_n") / every)).drop("_n")


def oldest_lock(locks: DataFrame) -> DataFrame:
    """The lock that wins: of the least key."""
    return locks.agg(F.min_by(F.struct(*locks.columns), "key").alias("l")).where("l IS NOT NULL").select("l.*")


MARKER = "hostname string, pid bigint, time timestamp_ntz, boot_id string"


def parse_markers(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON markers; a malformed one has null fields and malformed set."""
    m = raw.withColumn("m", F.from_json(value, MARKER))
    return m.select(*[c for c in raw.columns if c != value], "m.*", F.col("m.hostname").isNull().alias("malformed"))


def resolve_targets(matches: DataFrame) -> DataFrame:
    """Per snapshot name: unique, or ambiguous across repositories."""
    return matches.groupBy("name").agg(F.count_distinct("repo").alias("repos"), F.min("repo").alias("repo")).withColumn("outcome", F.when(F.col("repos") == 1, "unique").otherwise("ambiguous"))


def diff_targets(matches: DataFrame, a: str, b: str) -> DataFrame:
    """The repositories that have both snapshots."""
    return matches.where(F.col("name") == a).select("repo").intersect(matches.where(F.col("name") == b).select("repo"))


def assign_sources(sources: DataFrame, repos: DataFrame) -> DataFrame:
    """(source, repo): a source without repositories goes to all of them. Repositories are entries of one configuration file, so their names are one array that is exploded for each such source."""
    listed = sources.where(F.size("repos") > 0).select("label", F.explode(F.array_distinct("repos")).alias("repo")).join(repos, "repo", "left_semi").select("label", "repo")
    names = F.array(*(F.lit(r.repo) for r in repos.select("repo").distinct().orderBy("repo").limit(MOST_REPOS).collect()))
    everywhere = sources.where(F.size("repos") == 0).select("label", F.explode(names).alias("repo"))
    return listed.unionByName(everywhere)


def first_of(sources: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key, and how many there are."""
    return sources.groupBy(key).agg(F.min(ordinal).alias("first"), F.count("*").alias("sources"))


def select_labels(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, known) of requested labels, each once."""
    known = labels.select(F.col("label").alias("name"), F.lit(True).alias("known")).distinct()
    return asked.distinct().join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


def select_repos(asked: DataFrame, repos: DataFrame) -> DataFrame:
    """(name, repo): the repository of that label, else the one of that URL, else null."""
    by_url = repos.groupBy(F.col("url").alias("name")).agg(F.min("repo").alias("by_url"))
    by_label = repos.select(F.col("repo").alias("name"), F.col("repo").alias("by_label")).distinct()
    return asked.join(by_label, "name", "left").join(by_url, "name", "left").select("name", F.coalesce("by_label", "by_url").alias("repo"))


def unknown_repos(sources: DataFrame, repos: DataFrame) -> DataFrame:
    return sources.select("label", F.explode("repos").alias("repo")).join(repos, "repo", "left_anti").select("label", "repo")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def changed_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def reuse(items: DataFrame, cache: DataFrame, with_ctime: bool = True) -> DataFrame:
    """Items with whether the file cache has them unchanged: path and all of device, inode, mtime, size and ctime equal."""
    keys = ["path", "device", "inode", "mtime_ns", "size", *(["ctime_ns"] if with_ctime else [])]
    hit = cache.select(*keys, F.lit(True).alias("_hit")).dropDuplicates(keys)
    return items.join(hit, keys, "left").withColumn("unchanged", F.coalesce("_hit", F.lit(False))).drop("_hit")


def metadata_equal(prefix_a: str, prefix_b: str) -> Column:
    """Equal size, mtime, ctime, device and inode of two sets of columns: a file that changed while it was read fails this."""
    out = F.lit(True)
    for c in ("size", "mtime_ns", "ctime_ns", "device", "inode"):
        out &= F.col(prefix_a + c).eqNullSafe(F.col(prefix_b + c))
    return out


def section_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root each path lies in, by exploded ancestors instead of a range join."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hit = paths.select("path", F.explode(up).alias("root")).join(roots.select("root"), "root", "left_semi")
    return hit.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def parent_snapshot(snapshots: DataFrame, unit: str = "MONTH") -> DataFrame:
    """Per source label and host: the newest snapshot before each one, which a backup may reuse. Rows are sorted in parts of a time unit; the first of a part takes the last of the part before, so that a label's history isn't one task's."""
    key = ["source_label", "hostname"]
    s = snapshots.select(*key, "name", "time", "ordinal").withColumn("part", F.date_trunc(unit, "time"))
    ends = s.groupBy(*key, "part").agg(F.max_by("name", F.struct("time", "ordinal")).alias("end"))
    ends = ends.select(*key, "part", F.lag("end").over(Window.partitionBy(*key).orderBy("part")).alias("before"))
    own = F.lag("name").over(Window.partitionBy(*key, "part").orderBy("time", "ordinal"))
    return s.withColumn("own", own).join(ends, [*key, "part"]).select("name", F.coalesce("own", "before").alias("parent"))


def parent_by_paths(snapshots: DataFrame) -> DataFrame:
    """Per set of source paths, in whatever order: the newest snapshot before each one."""
    by = Window.partitionBy("paths").orderBy("time", "ordinal")
    return snapshots.withColumn("paths", F.array_sort("source_paths")).select("name", F.lag("name").over(by).alias("parent"))
