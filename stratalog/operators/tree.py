"""Directory trees over path strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S


def implicit_dirs(paths: DataFrame) -> DataFrame:
    """Ancestors that have no row of their own."""
    up = paths.select(F.explode(S.ancestors("path")).alias("path")).distinct()
    return up.join(paths.select("path"), "path", "left_anti")


def nodes(paths: DataFrame) -> DataFrame:
    """Every node once: path, parent, depth from 1, whether it is a directory, and the number of files below."""
    files = paths.select("path").distinct()
    dirs = files.select(F.explode(S.ancestors("path")).alias("path")).groupBy("path").agg(F.count("*").alias("files"))
    both = files.join(dirs, "path", "full_outer")
    return both.select("path", S.parent_path("path").alias("parent"), S.depth("path").alias("depth"), F.col("files").isNotNull().alias("is_dir"), F.coalesce("files", F.lit(1).cast("long")).alias("files"))


def children(tree: DataFrame, path: str) -> DataFrame:
    """A directory's listing: directories first, then by name regardless of case."""
    return tree.where(F.col("parent") == path).orderBy(F.desc("is_dir"), F.lower(S.file_name("path")), "path")


def html_lines(tree: DataFrame) -> DataFrame:
    """Nodes with the line that a directory's page has for them."""
    name = S.file_name("path")
    slash = F.when(F.col("is_dir"), "/").otherwise("")
    line = F.concat(F.lit('<li><a href="'), S.percent_encode_path(name), slash, F.lit('">'), S.html_escape(name), slash, F.lit("</a> "), F.col("files").cast("string"), F.lit("</li>"))
    return tree.withColumn("line", line)


def lookup(tree: DataFrame, path: str) -> DataFrame:
    return tree.where(F.col("path") == path)


def mixed_origins(rows: DataFrame) -> DataFrame:
    """Directories whose files come from more than one origin."""
    up = rows.select(F.explode(S.ancestors("path")).alias("path"), "origin")
    return up.groupBy("path").agg(F.count_distinct("origin").alias("origins")).withColumn("mixed", F.col("origins") > 1)


def check_state(rows: DataFrame) -> DataFrame:
    """all, some or none of the files below each directory are checked."""
    up = rows.select(F.explode(S.ancestors("path")).alias("path"), "checked")
    every, some = F.bool_and("checked"), F.bool_or("checked")
    return up.groupBy("path").agg(F.when(every, "all").when(some, "some").otherwise("none").alias("state"))


def minimal_checked(rows: DataFrame) -> DataFrame:
    """The fewest paths that cover what is checked: checked directories and files below no other checked directory."""
    full = check_state(rows).where("state = 'all'").select("path")
    marked = rows.where("checked").select("path").unionByName(full).distinct()
    covered = marked.select("path", F.explode(S.ancestors("path")).alias("up")).join(full.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    return marked.join(covered, "path", "left_anti")


def visible(tree: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are expanded."""
    hidden = tree.select("path", F.explode(S.ancestors("path")).alias("up")).join(expanded.select(F.col("path").alias("up")), "up", "left_anti").select("path")
    return tree.join(hidden, "path", "left_anti")


def common_prefix(paths: DataFrame) -> DataFrame:
    """The deepest directory that all paths lie in, '' if none: what the least and the greatest path share."""
    low, high = F.split(F.col("low"), "/"), F.split(F.col("high"), "/")
    n = F.least(F.size(low), F.size(high)) - 1
    at = F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    same = F.filter(at, lambda i: F.slice(low, F.lit(1), i) == F.slice(high, F.lit(1), i))
    return paths.agg(F.min("path").alias("low"), F.max("path").alias("high")).select(F.array_join(F.slice(low, F.lit(1), F.size(same)), "/").alias("prefix"))


def nested_roots(roots: DataFrame) -> DataFrame:
    """Pairs of source roots where one lies in the other."""
    up = roots.select(F.col("path").alias("inner"), F.explode(F.filter(S.ancestors("path"), lambda a: a != "")).alias("outer"))
    return up.join(roots.select(F.col("path").alias("outer")), "outer", "left_semi").select("outer", "inner")


def display_paths(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths below the source whose base name is their first component, else as they are."""
    first = F.substring_index("path", "/", 1)
    j = items.withColumn("base", first).join(sources.select("base", "root"), "base", "left")
    return j.withColumn("shown", F.when(F.col("root").isNull(), F.col("path")).otherwise(F.concat("root", F.expr("substring(path, length(base) + 1)")))).drop("base", "root")


def excluded_by_marker(items: DataFrame, marker: str) -> DataFrame:
    """Items that aren't in or below a directory with a marker file."""
    marked = items.where(S.file_name("path") == marker).select(S.parent_path("path").alias("up")).distinct()
    below = items.select("path", F.explode(S.ancestors("path")).alias("up")).join(marked, "up", "left_semi").select("path").distinct()
    return items.join(below, "path", "left_anti")
