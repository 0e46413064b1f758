"""Search for items across snapshots, their timelines, and listings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S


@dataclass
class ItemFilter:
    """Criteria that all must hold; those left out aren't in the plan. Sizes and ``since`` (seconds) are inclusive."""

    path_glob: str | None = None
    ignore_case: bool = False
    prefix: str | None = None
    entry_type: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    since: int | None = None

    def column(self) -> Column:
        c = []
        if self.entry_type is not None:
            c.append(F.col("entry_type") == self.entry_type)
        if self.min_size is not None:
            c.append(F.col("size") >= self.min_size)
        if self.max_size is not None:
            c.append(F.col("size") <= self.max_size)
        if self.since is not None:
            c.append(F.col("mtime_ns") >= self.since * 1_000_000_000)
        if self.prefix is not None:
            c.append(S.under("path", self.prefix))
        if self.path_glob is not None:
            c.append(S.glob_matches("path", self.path_glob, self.ignore_case))
        return reduce(lambda a, b: a & b, c, F.lit(True))


def scope(snapshots: DataFrame, label: str | None = None, last: int | None = None) -> DataFrame:
    """Snapshots of a label, then the newest of them."""
    s = snapshots if label is None else snapshots.where(F.col("source_label") == label)
    return s if last is None else s.orderBy(F.desc("time"), F.desc("ordinal")).limit(last)


def hits(items: DataFrame, criteria: ItemFilter) -> DataFrame:
    return items.where(criteria.column())


def timeline(found: DataFrame, version: str = "content") -> DataFrame:
    """Each hit with its status against the previous snapshot that has the path: added, modified or unchanged."""
    by = Window.partitionBy("path").orderBy("snapshot_id")
    own = found.withColumn("_v", F.sha2(F.col(version).cast("binary"), 256)).drop(version)  # a hash goes through the shuffle, not the contents
    before, size = F.lag("_v").over(by), F.lag("size").over(by)
    same = before.eqNullSafe(F.col("_v")) & (size == F.col("size"))
    return own.withColumn("status", F.when(F.lag("snapshot_id").over(by).isNull(), "added").when(same, "unchanged").otherwise("modified")).drop("_v")


def timelines(annotated: DataFrame) -> DataFrame:
    """A row a path: its hits in order, joined as snapshot:status."""
    entry = F.struct("snapshot_id", "status")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e.snapshot_id.cast("string"), F.lit(":"), e.status)), ",")
    return annotated.groupBy("path").agg(F.count("*").alias("hits"), joined.alias("history"))


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("path").alias("paths"), F.count("*").alias("hits"), F.count_distinct("snapshot_id").alias("snapshots"))


def by_snapshot(found: DataFrame) -> DataFrame:
    return found.groupBy("snapshot_id").agg(F.count("*").alias("hits"), F.sum("size").alias("bytes"))


def effective_label() -> Column:
    """The source's label, else the snapshot's, else a dash."""
    return F.coalesce(F.nullif("source_label", F.lit("")), F.nullif("label", F.lit("")), F.lit("-"))


def listing(snapshots: DataFrame, last: int, labels: list[str] | None = None) -> DataFrame:
    """The newest snapshots, oldest first, with a repeated (host, label) blanked. The number of rows is the report's."""
    s = snapshots.withColumn("shown", effective_label()).withColumn("host", S.host_label("hostname"))
    if labels is not None:
        s = s.where(F.col("shown").isin(labels))
    s = s.orderBy(F.desc("time"), F.desc("ordinal")).limit(last)
    by = Window.orderBy("time", "ordinal")  # over the rows of a report
    again = F.coalesce((F.lag("host").over(by) == F.col("host")) & (F.lag("shown").over(by) == F.col("shown")), F.lit(False))
    return s.select("name", "time", F.when(again, "").otherwise(F.col("host")).alias("host"), F.when(again, "").otherwise(F.col("shown")).alias("label"), F.when(F.col("format_version") <= 1, "ok").otherwise("unsupported").alias("state"))


def resolve(snapshots: DataFrame, name: str) -> DataFrame:
    """The snapshot of a name; ``latest`` in any case is the newest."""
    if name.lower() != "latest":
        return snapshots.where(F.col("name") == name)
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), F.struct("time", "ordinal")).alias("s")).where("s IS NOT NULL").select("s.*")


def sort_contents(items: DataFrame, field: str) -> DataFrame:
    """A snapshot's contents by name, size (largest first) or mtime (newest first)."""
    return items.orderBy(*{"name": ["path"], "size": [F.desc("size"), "path"], "mtime": [F.desc("mtime_ns"), "path"]}[field])


def sort_snapshots(snapshots: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By any column; what isn't known comes last, and first in descending order. Ties keep the order of ``ordinal``, which is turned too."""
    c, tie = F.col(column), F.col("ordinal")
    return snapshots.orderBy(c.asc_nulls_last(), tie) if ascending else snapshots.orderBy(c.desc_nulls_first(), tie.desc())


def recent(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The newest of all repositories, of which each task keeps so many."""
    return snapshots.orderBy(F.desc("time"), F.desc("ordinal")).limit(n)


def by_id(skipped: DataFrame) -> DataFrame:
    return skipped.orderBy("id_hex")


def states(snapshots: DataFrame, newest: int = 1) -> DataFrame:
    """Snapshots with whether their format can be read."""
    return snapshots.withColumn("state", F.when(F.col("format_version") <= newest, "ok").otherwise("unsupported"))


def restore_selection(items: DataFrame, pattern: str | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Items a restore takes: by glob over whole paths, or those that are, or lie below, a selected path."""
    if pattern is not None:
        return items.where(S.restore_matches("path", pattern))
    own = items.withColumn("_up", F.explode(F.array_append(S.ancestors("path"), F.col("path"))))
    return own.join(selected.select(F.col("path").alias("_up")), "_up", "left_semi").drop("_up").dropDuplicates(["snapshot_id", "item_index"])
