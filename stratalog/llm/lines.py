"""Exact line deduplication over levelled sorted runs of line hashes.

Batches of documents come in descending doc_id order. Each batch's distinct line
hashes are merge-anti-joined with the runs: a hash that no run holds yet is
owned by the largest doc_id of this batch, and the batch's counts become a new
sorted run. When a level has enough runs they are merged into one of the next
level, so a hash is rewritten once a level and a lookup reads few runs.

Runs are dealt in buckets by hash and sorted in each, so lookups and merges read
them as they lie: no run is shuffled again, and its sort finds it in order. A manifest beside them names
the runs of each level; it is written when a change is whole, so runs can be opened
again, by another session too, and take further batches.

At the end the runs give each hash its owner and the number of documents that
hold it; hashes held by enough documents lose their lines everywhere but in the
owner. Keys are 128-bit hashes. Hashes that hold a thousandth of all rows or more,
of which there are a thousand at most, are looked up instead of joined.

Null and empty texts are one empty line. A null doc_id counts as the least.
Rows that repeat a doc_id count as documents of their own and are treated alike.
An empty table gives no rows. Texts of any length are split whole. Further columns,
whatever their names, aren't read but by ``carry``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow import slices, stored, work_dir

#: White space that keys lose at both ends.
BLANK = " \t\n\x0b\x0c\r"
LEAST = -(1 << 63)


def line_key(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key, None where the key is too short."""
    if len(line) < min_chars or len(s := line.strip(BLANK)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower())  # of bytes, lower() changes A-Z only


def rows_of(df: DataFrame, id_col: str, text_col: str) -> list:
    """The columns (doc_id, text, d, x) of a row: d is the doc_id, LEAST for null; x tells texts of one d apart."""
    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [i.alias("doc_id"), t.alias("text"), F.coalesce(i, F.lit(LEAST)).alias("d"), F.xxhash64(t).alias("x")]


def line_hashes(df: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, x, k): the distinct keys of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                ids, own_x, keys = [], [], []
                for t, d, x in zip(*(c.to_pylist() for c in part.columns)):
                    own = {k for y in (t or "").split("\n") if (k := line_key(y, min_chars))}
                    keys += own
                    ids += [d] * len(own)
                    own_x += [x] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own_x, pa.int64()), pa.array(keys, pa.binary())], ["d", "x", "k"])

    return df.select(*rows_of(df, id_col, text_col)[1:]).mapInArrow(run, "d bigint, x bigint, k binary")


class LineRuns:
    """Levelled runs of (k, n documents, owner), dealt in buckets by k and sorted in each. The owner is null where an older run has it."""

    FORM = "k binary, n bigint, owner bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, buckets: int | None = None):
        """New runs, or those that lie at a path already, as the last whole change left them."""
        self.spark, self.fanout, self.path = spark, fanout, path or work_dir(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made = self.version = 0
        self.views: dict[str, str] = {}
        if path and self._fs().exists(self._at(f"{path}/manifest")):
            rows = spark.read.json(f"{path}/manifest", schema="version bigint, buckets bigint, made bigint, levels array<array<string>>")
            last = rows.agg(F.max_by(F.struct("*"), "version").alias("m")).first().m
            self.version, self.buckets, self.made, self.levels = last.version, last.buckets, last.made, [list(x) for x in last.levels]

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, gone: list[str]) -> None:
        """Write the manifest, then forget runs that it no longer names."""
        self.version += 1
        row = [(self.version, self.buckets, self.made, self.levels)]
        self.spark.createDataFrame(row, "version bigint, buckets bigint, made bigint, levels array<array<string>>").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.views.pop(run)}")
            self._fs().delete(self._at(f"{self.path}/{run}"), True)

    def _write(self, df: DataFrame, level: int) -> str:
        """A run, as a table with its buckets. Rows that an aggregate or join by k dealt in as many parts are a file a bucket."""
        self.made += 1
        run, name = f"level-{level}-run-{self.made:05d}", f"line_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "k").sortBy("k").option("path", f"{self.path}/{run}").saveAsTable(name)
        self.views[run] = name
        return run

    def run(self, name: str) -> DataFrame:
        """A run as a table that knows its buckets."""
        if name not in self.views:
            self.views[name] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.views[name]} ({self.FORM}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.views[name])

    def _merged(self, runs: list[str]) -> DataFrame:
        """(k, n, owner) of some runs, merged as they lie."""
        out = self.run(runs[0])
        for r in runs[1:]:
            b = self.run(r).toDF("k", "m", "other")
            out = out.hint("merge").join(b, "k", "full_outer").select("k", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("owner", "other").alias("owner"))
        return out

    def add(self, hashes: DataFrame) -> None:
        """Take a batch with a row for each key of each document in, and merge levels that are full."""
        batch = hashes.groupBy("k").agg(F.count("*").alias("n"), F.max("d").alias("owner"))
        for name in [r for level in self.levels for r in level]:
            known = self.run(name).where("owner IS NOT NULL").select("k", F.lit(True).alias("known"))
            batch = batch.hint("merge").join(known, "k", "left").select("k", "n", F.when(F.col("known").isNull(), F.col("owner")).alias("owner"))
        levels, gone, level = [list(x) for x in self.levels], [], 0
        levels[0].append(self._write(batch, 0))
        while len(levels[level]) >= self.fanout:
            runs, levels[level] = levels[level], []
            if len(levels) == level + 1:
                levels.append([])
            levels[level + 1].append(self._write(self._merged(runs), level + 1))
            gone += runs
            level += 1
        self.levels = levels
        self._commit(gone)

    def totals(self) -> DataFrame:
        """(k, n, owner) of every hash."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], self.FORM)

    def close(self) -> None:
        """Take the runs' names out of the session's catalog; their files stay."""
        for name in self.views.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.views = {}


def dropped(hashes: DataFrame, totals: DataFrame, min_docs: int, rows: int) -> DataFrame:
    """(d, x, drop): the keys that each row loses."""
    common = stored(totals.where(F.col("n") >= min_docs).select("k", "owner", "n"), "line-common")
    hot = F.broadcast(common.where(F.col("n") * 1000 >= rows).select("k", "owner"))  # a thousand at most, as their rows are disjoint
    cold = common.where(F.col("n") * 1000 < rows).select("k", "owner")
    rest = hashes.join(hot.select("k"), "k", "left_anti").join(cold, "k")
    lost = hashes.join(hot, "k").unionByName(rest).where("d < owner")
    return lost.groupBy("d", "x").agg(F.collect_set("k").alias("drop"))


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): what is left of each text; ``carry`` names columns that come along in a struct ``carried``. With ``runs``, lines known from there count too; their documents must have greater ids."""
    spark = df.sparkSession
    hashes = stored(line_hashes(df, min_chars, id_col, text_col), "line-hashes")
    bounds = sorted({int(x) for x in hashes.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)}, reverse=True) if batches > 1 else []
    runs = runs or LineRuns(spark)
    for high, low in zip([None, *bounds], [*bounds, None]):
        part = hashes if high is None else hashes.where(F.col("d") <= high)
        runs.add(part if low is None else part.where(F.col("d") > low))
    drop = dropped(hashes, runs.totals(), min_docs, hashes.count())
    runs.close()

    docs = df.select(*rows_of(df, id_col, text_col), *([] if carry is None else [F.struct(*carry).alias("carried")]))
    docs = docs.join(drop, ["d", "x"], "left").drop("d", "x")
    columns = [c for c in docs.columns if c != "drop"]

    def run(batches):
        at = docs_columns.index("drop")
        for batch in batches:
            for part in slices(batch, 1):
                texts, lines, dropped = [], [], []
                for t, keys in zip(part.column(1).to_pylist(), part.column(at).to_pylist()):
                    own = (t or "").split("\n")
                    lines.append(len(own))
                    if keys:
                        gone = set(keys)
                        own = [x for x in own if line_key(x, min_chars) not in gone]
                    texts.append("\n".join(own))
                    dropped.append(lines[-1] - len(own))
                more = [part.column(i) for i, c in enumerate(docs_columns) if c == "carried"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string()), *more], ["doc_id", "n_lines", "n_dropped", "text", *["carried"] * len(more)])

    docs_columns = docs.columns
    more = f", carried {docs.schema['carried'].dataType.simpleString()}" if "carried" in columns else ""
    return docs.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, text string" + more)
