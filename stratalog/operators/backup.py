"""Walking a source: what is skipped, reused, and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S


def other_filesystem(items: DataFrame, one_file_system: bool, root_dev: int) -> DataFrame:
    """Items left when directories on another device, and what is below them, are skipped; files on another device by themselves stay."""
    if not one_file_system:
        return items
    away = items.where((F.col("entry_type") == "dir") & (F.col("device") != root_dev)).select("path")
    up = items.select("path", F.explode(F.array_append(S.ancestors("path"), F.col("path"))).alias("up"))
    gone = up.join(away.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return items.join(gone, "path", "left_anti")


#: Kinds of files that aren't stored.
UNSUPPORTED = {"socket": "socket", "fifo": "named pipe", "block": "block device", "char": "character device"}


def unsupported(kind: Column) -> Column:
    """Why a kind of file is skipped, null where it isn't."""
    return F.create_map(*(F.lit(x) for kv in UNSUPPORTED.items() for x in kv))[kind]


#: Errors of single files after which a walk goes on.
SOFT_ERRORS = ("NotFound", "PermissionDenied", "StaleHandle", "InvalidFilename", "Interrupted")


def soft_error(code: Column) -> Column:
    return F.coalesce(code.isin(*SOFT_ERRORS), F.lit(False))


def legacy_reuse(parent_items: DataFrame, *by: str) -> DataFrame:
    """Whether a parent's items may be reused: none if any file lacks a ctime."""
    return parent_items.groupBy(*by).agg(F.coalesce(~F.bool_or((F.col("entry_type") == "file") & F.col("ctime_ns").isNull()), F.lit(False)).alias("usable"))


def absolute_paths(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Snapshot paths as paths of the file system: the root whose prefix is the longest that a path begins with, by exploded ancestors. An empty prefix is any path's."""
    up = F.array_append(F.array_prepend(S.ancestors("path"), F.lit("")), F.col("path"))
    hit = items.select("path", F.explode(up).alias("prefix")).join(roots.select("prefix", "root"), "prefix")
    best = hit.groupBy("path").agg(F.max_by(F.struct("prefix", "root"), F.length("prefix")).alias("b"))
    rest = F.when(F.col("b.prefix") == "", F.col("path")).otherwise(F.expr("substring(path, length(b.prefix) + 2)"))
    return best.select("path", F.rtrim(F.concat_ws("/", "b.root", rest), F.lit("/")).alias("absolute"))


def merged_excludes(every: Column, own: Column) -> Column:
    """Patterns for all sources, then a source's own, in order and with repeats."""
    return F.concat(F.coalesce(every, F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>")))


def string_or_list(c: Column) -> Column:
    """A configuration value that is a string or a list of strings, as a list."""
    many = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.ltrim(c).startswith("["), many).otherwise(F.array(F.trim(c, F.lit('"'))))


SOURCE = "path string, paths array<string>, label string, exclude array<string>, repos array<string>"


def normalise_sources(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Sources given as a bare path or an object: label (the path's name where none is given), paths, excludes and repositories; ``keep`` names columns that come along."""
    bare = ~F.ltrim(F.col(value)).startswith("{")
    s = raw.withColumn("s", F.when(~bare, F.from_json(value, SOURCE))).withColumn("bare", F.trim(F.col(value), F.lit('"')))
    paths = F.when(F.col("s").isNull(), F.array("bare")).otherwise(F.coalesce("s.paths", F.array("s.path")))
    none = F.array().cast("array<string>")
    return s.select(*(keep or []), F.coalesce("s.label", S.file_name(F.rtrim(paths[0], F.lit("/")))).alias("label"), paths.alias("paths"), F.coalesce("s.exclude", none).alias("exclude"), F.coalesce("s.repos", none).alias("repos"))


def attributes(items: DataFrame, *keys: str) -> DataFrame:
    """Of each item's extended attributes (a map of names to bytes): how many, their bytes, and the names that users set, sorted."""
    m = F.col("xattrs")
    size = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda n, v: n + F.octet_length(v))
    own = F.array_sort(F.map_keys(F.map_filter(m, lambda k, _: k.startswith("user."))))
    return items.select(*keys, F.coalesce(F.size(F.map_keys(m)), F.lit(0)).cast("long").alias("names"), F.coalesce(size, F.lit(0)).alias("bytes"), F.array_join(own, ",").alias("user_names"))


def expected_blobs_missing(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """Expected (pack_key, offset, length) that a scan of the packs didn't find."""
    return expected.join(scanned.select(F.col("path").alias("pack_key"), "offset", "length"), ["pack_key", "offset", "length"], "left_anti")


def structure_summary(packs: DataFrame) -> DataFrame:
    """Packs, bytes and errors of a structure check; structure_errors() lists them."""
    return packs.agg(F.count("*").alias("packs"), F.sum("length").alias("bytes"), F.count(structure_error()).alias("errors"))


def structure_error() -> Column:
    """Malformed keys, and files too short for a header."""
    return F.when(~S.valid_pack_key("path"), F.concat(F.lit("bad key: "), F.col("path"))).when(F.col("length") < 9, F.concat(F.lit("too short: "), F.col("path")))


def structure_errors(packs: DataFrame) -> DataFrame:
    """(path, error) of the packs that fail it."""
    return packs.select("path", structure_error().alias("error")).where("error IS NOT NULL")


def hidden_summary(states: DataFrame) -> DataFrame:
    """A sentence on the snapshots that a listing leaves out."""
    new, bad = F.count_if(F.col("state") == "unsupported"), F.count_if(F.col("state") == "unreadable")
    parts = F.array_compact(F.array(F.when(new > 0, F.concat(new.cast("string"), F.lit(" of a newer format"))), F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" unreadable")))))
    return states.agg(F.array_join(parts, ", ").alias("hidden"))


def fingerprint(*parts: Column) -> Column:
    """A repository's identity: a hash of its parts, separated so that they can't run together."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def path_hash(path: Column) -> Column:
    """16 bytes that stand for a path, as digits."""
    return F.substring(F.sha2(path, 256), 1, 32)


def verify_chunks(index: DataFrame, packs: DataFrame, key: bytes) -> DataFrame:
    """(chunk_id, pack_id, outcome): each stored chunk read by its range and hashed again: ok, short, or mismatch. ``packs`` has pack_id and content."""
    blob = F.substring(F.col("content"), F.col("pack_offset").cast("int") + 1, F.col("stored_size").cast("int"))
    rows = index.join(packs.select("pack_id", "content"), "pack_id").select("chunk_id", "pack_id", "stored_size", blob.alias("blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, n, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                d = data.as_py() or b""
                out.append("short" if len(d) != n else "ok" if hashlib.blake2b(d, key=key, digest_size=32).hexdigest() == c else "mismatch")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["chunk_id", "pack_id", "outcome"])

    return rows.mapInArrow(run, "chunk_id string, pack_id string, outcome string")


def reordered(entries: DataFrame) -> DataFrame:
    """A session's entries in the order of the walk, whatever order they were finished in, numbered."""
    by = Window.partitionBy("session").orderBy("seq")
    return entries.withColumn("item_index", F.row_number().over(by) - 1)


def walk_order(entries: DataFrame, by_inode: bool) -> DataFrame:
    """Entries as a walk reads them."""
    return entries.orderBy("inode", "path") if by_inode else entries.orderBy("path")


def ordinals(streams: DataFrame) -> DataFrame:
    """(stream, item_index, item): the items of each stream by their place in it."""
    return streams.select("stream", F.posexplode("items").alias("item_index", "item"))


def next_run(cron: str, after) -> object:
    """The first minute after a time that a five-field cron expression matches (a datetime); fields are *, numbers, ranges, lists and steps."""
    import datetime as dt

    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    fields = []
    for text, (low, high) in zip(cron.split(), bounds, strict=True):
        own: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            start, end = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
            own |= set(range(start, end + 1, int(step or 1)))
        fields.append(own)
    fields[4] = {x % 7 for x in fields[4]}
    day_free, week_free = (cron.split()[i] == "*" for i in (2, 4))
    t = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(366 * 5):
        day, week = t.day in fields[2], (t.weekday() + 1) % 7 in fields[4]
        if t.month in fields[3] and (day and week if day_free or week_free else day or week):
            for minute in range(t.hour * 60 + t.minute, 1440):
                if minute // 60 in fields[1] and minute % 60 in fields[0]:
                    return t.replace(hour=minute // 60, minute=minute % 60)
        t = (t + dt.timedelta(days=1)).replace(hour=0, minute=0)
    return None
