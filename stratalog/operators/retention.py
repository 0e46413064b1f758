"""Which snapshots a policy keeps, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The bucket rules in the order of their reasons, with the unit a time is cut to. Weeks begin on Monday.
BUCKETS = (("hourly", "HOUR"), ("daily", "DAY"), ("weekly", "WEEK"), ("monthly", "MONTH"), ("yearly", "YEAR"))


def decide(snapshots: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """(source_label, name, time, decision, reasons) of each snapshot.

    Each rule counts by itself. keep_last takes the newest; keep_within those not
    older than its days before ``now``; a bucket rule the newest of each bucket, in
    the first so many buckets. Ties keep the order of ``ordinal``. A label without a
    rule, or without a policy, keeps everything.

    A label may have any number of snapshots, so none is sorted whole in one task. The
    newest snapshot of each hour comes from an aggregate that combines before the
    shuffle, and the bucket rules are windows over these hours. Ranks are only taken
    in the newest hours, which hold the snapshots that a keep_last can reach.
    """
    rules = ["keep_within_days", "keep_last", *(f"keep_{n}" for n, _ in BUCKETS)]
    p = policies.select("source_label", *rules)
    s = snapshots.select("source_label", "name", "time", "ordinal").withColumn("hour", F.date_trunc("HOUR", "time"))
    hours = s.groupBy("source_label", "hour").agg(F.count("*").alias("n"), F.max_by(F.struct("time", "ordinal"), F.struct("time", (-F.col("ordinal")).alias("o"))).alias("newest"))
    hours = hours.join(p, "source_label")
    by = Window.partitionBy("source_label").orderBy(F.desc("hour"))
    kept = []
    for name, unit in BUCKETS:
        cut = F.date_trunc(unit, "hour")
        hours = hours.withColumn(f"new_{name}", F.coalesce(cut != F.lag(cut).over(by), F.lit(True)))
        hours = hours.withColumn(f"nth_{name}", F.sum(F.col(f"new_{name}").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        kept.append(F.when(F.col(f"new_{name}") & (F.col(f"nth_{name}") <= F.col(f"keep_{name}")), F.concat(F.lit(f"{name} #"), F.col(f"nth_{name}").cast("string"))))
    newer = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumn("found", F.array_compact(F.array(*kept))).withColumn("newer", newer)
    first = hours.where(F.size("found") > 0).select("source_label", F.col("newest.time").alias("time"), F.col("newest.ordinal").alias("ordinal"), "found")
    near = s.join(hours.where(F.col("newer") < F.col("keep_last")).select("source_label", "hour", "newer", "keep_last"), ["source_label", "hour"])
    rank = F.col("newer") + F.row_number().over(Window.partitionBy("source_label", "hour").orderBy(F.desc("time"), "ordinal"))
    last = near.withColumn("rank", rank).where(F.col("rank") <= F.col("keep_last")).select("source_label", "time", "ordinal", "rank")
    key = ["source_label", "time", "ordinal"]
    d = s.drop("hour").join(p, "source_label", "left").join(last, key, "left").join(first, key, "left")
    reasons = [
        F.when(F.col("time") >= now - F.make_dt_interval(F.col("keep_within_days")), F.lit("within")),
        F.when(F.col("rank").isNotNull(), F.concat(F.lit("last #"), F.col("rank").cast("string"))),
    ]
    own = F.concat(F.array_compact(F.array(*reasons)), F.coalesce("found", F.array().cast("array<string>")))
    d = d.withColumn("why", F.when(F.coalesce(*rules).isNull(), F.array(F.lit("no policy"))).otherwise(own))
    return d.select("source_label", "name", "time", F.when(F.size("why") > 0, "keep").otherwise("prune").alias("decision"), F.array_join("why", ", ").alias("reasons"))


def check_policies(policies: DataFrame) -> None:
    """Raise where a rule is zero or no label has any: a policy must keep something."""
    rules = [c for c in policies.columns if c.startswith("keep_")]
    rows = policies.select(*rules).collect()  # a row a configured label
    if any(r[c] is not None and r[c] <= 0 for r in rows for c in rules):
        raise ValueError("a retention rule must keep at least one snapshot")
    if not any(r[c] is not None for r in rows for c in rules):
        raise ValueError("no retention rule is set")


def totals(decisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots and deduplicated bytes by decision."""
    return decisions.join(snapshots.select("name", "deduplicated_size"), "name").groupBy("decision").agg(F.count("*").alias("snapshots"), F.sum("deduplicated_size").alias("bytes"))
