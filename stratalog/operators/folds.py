"""Ordered folds whose state resets: packs that close, batches that fill, ignore rules, truncation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import glob_regex

MAX_BLOBS, MAX_AGE = 10_000, 300.0


def assign_packs(blobs: DataFrame, target: int, max_blobs: int = MAX_BLOBS, max_age: float = MAX_AGE) -> DataFrame:
    """(session, seq, pack): a pack closes once it has the target bytes, the most blobs, or its first blob is too old; a session's blobs are streamed in order, never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, pack, size, count, began = object(), 0, 0, 0, 0.0
        for batch in batches:
            out = []
            for s, _, n, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != session:
                    session, pack, size, count, began = s, 0, 0, 0, at
                elif size >= target or count >= max_blobs or at - began > max_age:
                    pack, size, count, began = pack + 1, 0, 0, at
                size, count = size + 4 + n, count + 1
                out.append(pack)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["session", "seq", "pack"])

    rows = blobs.select(F.col("session").cast("long"), F.col("seq").cast("long"), F.col("size").cast("long"), F.col("at").cast("double"))
    return rows.repartition("session").sortWithinPartitions("session", "seq", "size").mapInArrow(run, "session bigint, seq bigint, pack bigint")


def stream_chunks(items: DataFrame, average: int) -> DataFrame:
    """(stream, seq, chunk): items in order; a chunk of their stream closes once it has the average size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, chunk, held = object(), 0, 0
        for b in batches:
            out = []
            for s, _, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != stream:
                    stream, chunk, held = s, 0, 0
                elif held >= average:
                    chunk, held = chunk + 1, 0
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["stream", "seq", "chunk"])

    rows = items.select(F.col("stream").cast("long"), F.col("seq").cast("long"), F.col("size").cast("long"))
    return rows.repartition("stream").sortWithinPartitions("stream", "seq", "size").mapInArrow(run, "stream bigint, seq bigint, chunk bigint")


def batch_plans(ops: DataFrame, limit: int = 2 << 30) -> DataFrame:
    """(repo, seq, batch): operations in order, a new batch where one more would pass the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, number, size = object(), 0, 0
        for b in batches:
            out = []
            for r, _, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if r != repo:
                    repo, number, size = r, 0, 0
                elif size and size + n > limit:
                    number, size = number + 1, 0
                size += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["repo", "seq", "batch"])

    rows = ops.select("repo", F.col("seq").cast("long"), F.col("size").cast("long"))
    return rows.repartition("repo").sortWithinPartitions("repo", "seq", "size").mapInArrow(run, "repo string, seq bigint, batch bigint")


class IgnoreRules:
    """Ignore patterns in order: the last that matches a path, or a directory above it, decides; ! takes an earlier one back, a trailing / is for directories, a leading one for the root. Their plain form; ignored() is the same as an expression."""

    def __init__(self, patterns: list[str]):
        self.rules = []
        for p in patterns:
            p = p.rstrip()
            if not p or p.startswith("#"):
                continue
            negate = p.startswith("!")
            p = p[negate:]
            only_dir, p = p.endswith("/"), p.rstrip("/")
            anchored = "/" in p
            p = p.lstrip("/")
            self.rules.append((negate, only_dir, re.compile(glob_regex(p if anchored else "**/" + p))))

    def _own(self, path: str, is_dir: bool) -> bool | None:
        for negate, only_dir, regex in reversed(self.rules):
            if (is_dir or not only_dir) and regex.match(path):
                return not negate
        return None

    def ignored(self, path: str, is_dir: bool) -> bool:
        parts = path.split("/")
        if any(self._own("/".join(parts[:i]), True) for i in range(1, len(parts))):
            return True  # nothing below an ignored directory comes back
        return bool(self._own(path, is_dir))


def _verdict(patterns: list[str], path: Column, is_dir: Column) -> Column:
    """Whether the last rule that matches a path excludes it, null where none matches."""
    out = F.lit(None).cast("boolean")
    for negate, only_dir, regex in IgnoreRules(patterns).rules:
        hit = path.rlike(regex.pattern)
        out = F.when(hit & is_dir if only_dir else hit, F.lit(not negate)).otherwise(out)
    return out


def _above(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def ignored(patterns: list[str], path: Column, is_dir: Column) -> Column:
    """Whether the rules exclude a path, or a directory above it, below which nothing comes back."""
    below = F.exists(_above(path), lambda up: F.coalesce(_verdict(patterns, up, F.lit(True)), F.lit(False)))
    return below | F.coalesce(_verdict(patterns, path, is_dir), F.lit(False))


def ignored_by_files(files: dict[str, list[str]], path: Column, is_dir: Column) -> Column:
    """The same by ignore files in directories ('' is the root): of those above a path, the deepest with a rule that matches it, or a directory below the file, decides."""
    out = F.lit(False)
    for folder, patterns in sorted(files.items(), key=lambda x: x[0].count("/") + bool(x[0])):
        inside = path.startswith(folder + "/") if folder else F.lit(True)
        rest = F.substring(path, len(folder) + 2, 1 << 30) if folder else path
        # The nearest to the path decides: itself, else the directories above it from below.
        own = _verdict(patterns, rest, is_dir)
        above = F.filter(F.transform(F.reverse(_above(rest)), lambda up: _verdict(patterns, up, F.lit(True))), lambda v: v.isNotNull())
        verdict = F.coalesce(own, F.try_element_at(above, F.lit(1)))
        out = F.when(inside & verdict.isNotNull(), verdict).otherwise(out)
    return out


def _width(c: str) -> int:
    import unicodedata

    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def truncate_middle(text: str, columns: int) -> str:
    """At most so many terminal columns: the ends of the text around three dots."""
    if sum(map(_width, text)) <= columns:
        return text
    room = max(0, columns - 3)
    left, right, used = [], [], 0
    for c in text:
        if used + _width(c) > (room + 1) // 2:
            break
        left.append(c)
        used += _width(c)
    for c in reversed(text):
        if used + _width(c) > room:
            break
        right.append(c)
        used += _width(c)
    return ("".join(left) + "..." + "".join(reversed(right)))[: max(columns, 0)]


def truncated(columns: int):
    @F.pandas_udf("string")
    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else truncate_middle(t, columns))

    return f
