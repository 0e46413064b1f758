"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import stored

#: So many edges fit one task, whatever the input had.
TASK_EDGES = 15_000


def _in_one_task(batches):
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    out = np.array([(v, find(v)) for v in list(parent)], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["v", "c"])


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, c) of every vertex of the edges (a, b): c is one vertex of its component, the same for all.

    Each round every vertex joins the first of its neighbours, itself included, in a
    random order of the round, and the edges between what is joined go on; their
    number falls by a factor. The last few are done in one task. Only a count comes
    to the driver.
    """

    def between(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, steps = stored(between(edges), "edges"), []
    while left.count() > task_edges:
        both = left.union(left.select("b", "a"))
        order = F.lit(len(steps))
        first = F.min(F.struct(F.xxhash64("b", order).alias("h"), "b")).alias("m")
        own = F.xxhash64("v", order)
        step = stored(both.groupBy(F.col("a").alias("v")).agg(first).select("v", F.when(own <= F.col("m.h"), F.col("v")).otherwise(F.col("m.b")).alias("c")), "labels")
        steps.append(step)
        x, y = step.toDF("a", "x"), step.toDF("b", "y")
        left = stored(between(left.join(x, "a").join(y, "b").selectExpr("x AS a", "y AS b")), "edges")
    steps.append(left.coalesce(1).mapInArrow(_in_one_task, "v bigint, c bigint"))
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.toDF("c", "next"), "c", "left").select("v", F.coalesce("next", "c").alias("c"))
    return labels
