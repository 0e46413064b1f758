"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text handled at once. The batch itself is bounded by spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch, and by one row at least.
SLICE_CHARS = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that the texts of each part have about ``limit`` bytes (one row at least). An integer column gives the bytes itself."""
    c = batch.column(column)
    size = pc.fill_null(c if pa.types.is_integer(c.type) else pc.binary_length(c), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns can't clash with its own. Ids are integers."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], pa.RecordBatch]], schema: str, column: int = 1) -> DataFrame:
    """Apply a function of (ids, texts) to each slice of each batch. ``make`` runs once in a task and holds its caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, column):
                yield f(*(c.to_pylist() for c in part.columns))

    return df.mapInArrow(run, schema)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, a local one, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/stratalog-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
