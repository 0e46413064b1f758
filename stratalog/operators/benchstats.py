"""Statistics of benchmark and scenario runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mean_std(c: str, name: str) -> list[Column]:
    """Mean and sample deviation; nulls are skipped, one value deviates by 0."""
    return [F.avg(c).alias(f"{name}_mean"), F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))).alias(f"{name}_std")]


def records(runs: DataFrame) -> DataFrame:
    """A row a tool and phase."""
    return runs.groupBy("tool", "phase").agg(*mean_std("duration_s", "duration"), *mean_std("bytes", "bytes"), F.count("*").alias("run_count"), F.count_if(F.col("exit_status") != 0).alias("failed_runs"))


def timing(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("duration_s").alias("count"), *mean_std("duration_s", "duration"), F.min("duration_s").alias("least"), F.max("duration_s").alias("most"))


def seconds_per_gib(duration: Column, n: Column) -> Column:
    return F.when(n > 0, duration / (n / (1 << 30)))


def summary(steps: DataFrame) -> DataFrame:
    """By action and label: passed and failed steps, and the first place, by which a report is ordered."""
    return steps.groupBy("action", "label").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.min("ordinal").alias("first"))


def merge(own: DataFrame, other: DataFrame) -> DataFrame:
    """Records with gaps filled from others: an operation's own where it ran, else the other's."""
    a = own.select("op", F.struct(*[c for c in own.columns if c != "op"]).alias("a"))
    b = other.select("op", F.struct(*[c for c in own.columns if c != "op"]).alias("b"))
    j = a.join(b, "op", "full_outer")
    return j.select("op", F.when(F.col("a.run_count") > 0, F.col("a")).otherwise(F.coalesce("b", "a")).alias("r")).select("op", "r.*")


def type_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("entry_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def key_values(lines: DataFrame) -> DataFrame:
    """'name: value' lines of a report as (run, name, value)."""
    part = F.split("value", ": ", 2)
    return lines.where(F.contains("value", F.lit(": "))).select("run", F.btrim(part[0], F.lit(" \t")).alias("name"), F.btrim(part[1], F.lit(" \t")).alias("value"))


def wide(values: DataFrame, names: list[str]) -> DataFrame:
    """(run, a column a name): the first value of each name, null where there is none. The names are given, so the plan needs no pass to find them."""
    return values.groupBy("run").agg(*(F.min(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def schedule_brief(repos: DataFrame, *by: str) -> DataFrame:
    """Off where all are paused, else the cadence all repositories share, else per-repo."""
    one = F.when(F.min("schedule") == F.max("schedule"), F.min("schedule")).otherwise(F.lit("per-repo"))
    return repos.groupBy(*by).agg(F.when(F.bool_and("paused"), "Off").otherwise(one).alias("brief"))


def next_wake(plans: DataFrame, *by: str) -> DataFrame:
    """The earliest next run; plans without one don't count."""
    return plans.groupBy(*by).agg(F.min("next_run").alias("next_wake"))


def status_json(snapshots: DataFrame, by: str) -> DataFrame:
    """A JSON object for each repository."""
    s = snapshots.groupBy(by).agg(F.count("*").alias("snapshots"), F.date_format(F.max("time"), "yyyy-MM-dd HH:mm:ss").alias("newest"), F.sum("original_size").alias("bytes"))
    return s.select(by, F.to_json(F.struct(F.col(by).alias("repo"), "snapshots", "newest", "bytes")).alias("status"))


def report_lines(records: DataFrame) -> DataFrame:
    """Records as lines of TSV, markdown and JSON."""
    cells = [F.concat_ws(".", "tool", "phase"), F.col("run_count").cast("string"), F.col("failed_runs").cast("string"), F.format_string("%.2f", F.round("duration_mean", 2)), F.format_string("%.0f", F.round("bytes_mean", 0))]
    blank = [F.coalesce(c, F.lit("NA")) for c in cells]
    whole = F.to_json(F.struct(cells[0].alias("op"), F.col("run_count").alias("runs"), "failed_runs"))
    return records.select(cells[0].alias("op"), F.concat_ws("\t", *blank).alias("tsv"), F.concat(F.lit("| "), F.concat_ws(" | ", *blank), F.lit(" |")).alias("markdown"), whole.alias("json"))
