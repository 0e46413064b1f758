"""Integrity: what doesn't resolve, and what a repair would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ISSUE = ["kind", "snapshot_id", "item_index", "chunk_id", "pack_id", "detail"]
_TYPES = {"kind": "string", "snapshot_id": "long", "item_index": "long", "chunk_id": "string", "pack_id": "string", "detail": "string"}


def issue(df: DataFrame, kind: str, detail: Column | None = None) -> DataFrame:
    """Rows in the common form of issues."""
    cols = [F.lit(kind).alias("kind")]
    for c in ISSUE[1:]:
        have = detail if c == "detail" else F.col(c) if c in df.columns else None
        cols.append((F.lit(None) if have is None else have).cast(_TYPES[c]).alias(c))
    return df.select(*cols)


def dangling_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.join(index.select("chunk_id"), "chunk_id", "left_anti")


def missing_packs(index: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs the index refers to that storage lacks, with how many chunks they held."""
    return index.groupBy("pack_id").agg(F.count("*").alias("chunks")).join(packs.select("pack_id"), "pack_id", "left_anti")


def orphan_packs(index: DataFrame, packs: DataFrame) -> DataFrame:
    return packs.join(index.select("pack_id"), "pack_id", "left_anti")


def items_in_packs(refs: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """Items that need a chunk of some packs, with how many and which packs, sorted."""
    hit = index.join(packs.select("pack_id"), "pack_id", "left_semi").select("chunk_id", "pack_id")
    return refs.join(hit, "chunk_id").groupBy("snapshot_id", "item_index").agg(F.count_distinct("chunk_id").alias("chunks"), F.array_join(F.array_sort(F.collect_set("pack_id")), ",").alias("packs"))


def item_reason() -> Column:
    """Why an item is invalid, null where it isn't: files have chunks that make up their size and no target; directories neither; symlinks a target."""
    n, total = F.coalesce("n_chunks", F.lit(0)), F.coalesce("chunk_bytes", F.lit(0))
    t = F.col("link_target")
    return (
        F.when((F.col("entry_type") == "file") & t.isNotNull(), "file has a link target")
        .when((F.col("entry_type") == "file") & (total != F.col("size")), "chunk sizes don't make up the size")
        .when((F.col("entry_type") != "file") & (n > 0), "chunks on what is no file")
        .when((F.col("entry_type") == "dir") & t.isNotNull(), "directory has a link target")
        .when((F.col("entry_type") == "symlink") & (t.isNull() | (t == "")), "symlink without target")
        .when((F.col("entry_type") == "symlink") & (F.contains(t, F.lit("\x00")) | (F.octet_length(t) > 4096)), "symlink target is malformed")
        .when((F.col("entry_type") != "file") & F.col("hardlink").isNotNull(), "hard link on what is no file")
    )


def validate_items(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Invalid items and why; items may have link_target and hardlink columns."""
    for c in ("link_target", "hardlink"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    own = refs.groupBy("snapshot_id", "item_index").agg(F.count("*").alias("n_chunks"), F.sum("size").alias("chunk_bytes"))
    return items.join(own, ["snapshot_id", "item_index"], "left").withColumn("reason", item_reason()).where("reason IS NOT NULL").select("snapshot_id", "item_index", "reason")


def dangling_item_ptrs(ptrs: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks of item streams that the index lacks."""
    return ptrs.join(index.select("chunk_id"), "chunk_id", "left_anti")


#: The newest format of snapshots that is read.
FORMAT = 1
SNAPSHOT_KEY = r"^snapshots/[0-9a-f]{64}$"


def snapshot_kind() -> Column:
    """What is wrong with a snapshot object, null where nothing is. A read that failed, a newer format and an envelope of another length say nothing about the object itself."""
    outcome = F.col("outcome")
    return (
        F.when(~F.col("key").rlike(SNAPSHOT_KEY), "invalid_snapshot_key")
        .when(outcome.isin("io_error", "items_io_error"), "snapshot_read_failed")
        .when(outcome == "other_length", "incompatible_snapshot_envelope")
        .when(outcome == "undecodable", "corrupt_snapshot")
        .when(F.col("format_version") > FORMAT, "unsupported_snapshot_version")
        .when(outcome == "items_undecodable", "unreadable_snapshot")
    )


def snapshot_issues(objects: DataFrame) -> DataFrame:
    """Issues of snapshot objects (key, snapshot_id, outcome of reading them, format_version)."""
    found = objects.withColumn("kind", snapshot_kind()).where("kind IS NOT NULL")
    detail = F.when(F.col("kind") == "invalid_snapshot_key", F.col("key")).when(F.col("kind") == "unsupported_snapshot_version", F.concat(F.lit("version "), F.col("format_version").cast("string"))).otherwise(F.col("outcome"))
    return with_kinds(found.withColumn("detail", detail))


def with_kinds(df: DataFrame) -> DataFrame:
    """Rows that name their own kind, in the common form."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in ISSUE))


def pack_issues(index: DataFrame, checks: DataFrame) -> DataFrame:
    """Issues of the packs an index refers to, by what a check of each found (pack_id, outcome): missing where none was made, io_error where presence isn't known, anything but ok is bad content."""
    refs = index.groupBy("pack_id").agg(F.count("*").alias("chunks"))
    j = refs.join(checks, "pack_id", "left")
    kind = F.when(F.col("outcome").isNull(), "missing_pack").when(F.col("outcome") == "io_error", "pack_existence_check_failed").when(F.col("outcome") != "ok", "corrupt_pack_content")
    detail = F.when(F.col("outcome").isNull(), F.concat(F.col("chunks").cast("string"), F.lit(" chunks"))).otherwise(F.col("outcome"))
    return with_kinds(j.withColumn("kind", kind).withColumn("detail", detail).where("kind IS NOT NULL"))


def chunk_issues(verified: DataFrame, bad_packs: DataFrame) -> DataFrame:
    """Chunks that fail by themselves (chunk_id, pack_id, outcome); those of bad packs are counted there."""
    return issue(verified.where("outcome <> 'ok'").join(bad_packs.select("pack_id"), "pack_id", "left_anti"), "corrupt_chunk", F.col("outcome"))


def full_scan(objects: DataFrame, items: DataFrame, refs: DataFrame, ptrs: DataFrame, index: DataFrame, tree_index: DataFrame, checks: DataFrame, verified: DataFrame) -> DataFrame:
    """The issues of all phases: snapshots, item streams and items, packs, and chunks where data was verified."""
    packs = pack_issues(index, checks)
    bad = packs.where("kind <> 'pack_existence_check_failed'")
    return (
        snapshot_issues(objects)
        .unionByName(issue(dangling_item_ptrs(ptrs, tree_index), "dangling_item_ptr"))
        .unionByName(issue(validate_items(items, refs), "invalid_item", F.col("reason")))
        .unionByName(issue(dangling_chunks(refs, index), "dangling_file_chunk"))
        .unionByName(packs)
        .unionByName(chunk_issues(verified, bad))
    )


#: What a message says of each kind.
MESSAGES = {
    "corrupt_snapshot": "can't be decoded",
    "invalid_snapshot_key": "isn't the key of a snapshot",
    "dangling_item_ptr": "has an item stream with a chunk that isn't indexed",
    "dangling_file_chunk": "has a file with a chunk that isn't indexed",
    "missing_pack": "isn't in storage",
    "corrupt_pack_content": "has bad content",
    "corrupt_chunk": "has bad content",
    "pack_existence_check_failed": "couldn't be looked up",
    "unreadable_snapshot": "has items that can't be decoded",
    "snapshot_read_failed": "couldn't be read",
    "unsupported_snapshot_version": "has a newer format",
    "incompatible_snapshot_envelope": "has an envelope of another length",
    "invalid_item": "has an invalid item",
}


def messages(issues: DataFrame) -> DataFrame:
    """(context, message) of each issue, for people."""
    says = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))[F.col("kind")]
    context = (
        F.when(F.col("kind") == "invalid_snapshot_key", F.col("detail"))
        .when(F.col("snapshot_id").isNotNull(), F.concat(F.lit("snapshot "), F.col("snapshot_id").cast("string")))
        .when(F.col("chunk_id").isNotNull(), F.concat(F.lit("chunk "), F.substring("chunk_id", 1, 16)))
        .otherwise(F.concat(F.lit("pack "), F.col("pack_id")))
    )
    return issues.select("kind", context.alias("context"), F.concat(says, F.coalesce(F.when(F.col("kind") != "invalid_snapshot_key", F.concat(F.lit(": "), F.col("detail"))), F.lit(""))).alias("message"))


def scan(items: DataFrame, refs: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """What a catalog's own tables tell, in one form, with orphan packs and the items that missing packs hit."""
    gone = missing_packs(index, packs)
    return (
        issue(dangling_chunks(refs, index), "dangling_file_chunk")
        .unionByName(issue(gone, "missing_pack", F.concat(F.col("chunks").cast("string"), F.lit(" chunks"))))
        .unionByName(issue(orphan_packs(index, packs), "orphan_pack"))
        .unionByName(issue(items_in_packs(refs, index, gone), "item_in_missing_pack", F.col("packs")))
        .unionByName(issue(validate_items(items, refs), "invalid_item", F.col("reason")))
    )


def counters(refs: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """What a scan looked at; chunks count as checked only in packs whose presence is known."""
    a = refs.agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count_distinct("snapshot_id", "item_index").alias("items"), F.count("*").alias("refs"))
    b = index.join(packs.select("pack_id", F.lit(1).alias("there")), "pack_id", "left").agg(F.count("*").alias("chunks"), F.count("there").alias("chunks_present"))
    return a.crossJoin(b)  # a row each


def sample_exact(df: DataFrame, percent: int, key: Column) -> DataFrame:
    """ceil(n * percent / 100) rows, one at least, in the order of a random key.

    The cut is a quantile of the key's hash found by counting its leading bits, so
    only the rows of one of 4096 classes are ranked.
    """
    n = df.count()
    want = min(n, max(1, -(-n * percent // 100)))
    d = df.withColumn("_h", F.xxhash64(key)).withColumn("_c", F.shiftrightunsigned("_h", 52).cast("int"))
    taken, edge = 0, -1
    for r in d.groupBy("_c").count().orderBy("_c").collect():  # 4096 rows at most
        edge = r["_c"]
        if taken + r["count"] >= want:
            break
        taken += r["count"]
    last = d.where(F.col("_c") == edge).orderBy("_h", key).limit(want - taken)
    return d.where(F.col("_c") < edge).unionByName(last).drop("_h", "_c")


def chunks_to_remove(index: DataFrame, missing: DataFrame, corrupt_packs: DataFrame, corrupt_chunks: DataFrame) -> DataFrame:
    """Chunks of missing or corrupt packs, and corrupt ones, each once."""
    bad = missing.select("pack_id").unionByName(corrupt_packs.select("pack_id")).distinct()
    return index.join(bad, "pack_id", "left_semi").select("chunk_id").unionByName(corrupt_chunks.select("chunk_id")).distinct()


def doomed_snapshots(refs: DataFrame, removed: DataFrame) -> DataFrame:
    """How many removed chunks each snapshot needs."""
    return refs.join(removed, "chunk_id", "left_semi").groupBy("snapshot_id").agg(F.count_distinct("chunk_id").alias("lost_chunks"))


def repair_plan(items: DataFrame, refs: DataFrame, removed: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, action, items, lost_items, lost_chunks): drop items where others survive, remove a snapshot none of whose files do or that can't be read, else keep."""
    lost = refs.join(removed, "chunk_id", "left_semi").groupBy("snapshot_id").agg(F.count_distinct("item_index").alias("lost_items"), F.count_distinct("chunk_id").alias("lost_chunks"))
    total = items.groupBy("snapshot_id").agg(F.count("*").alias("items"), F.count_if(F.col("entry_type") == "file").alias("files"))
    plan = total.join(lost, "snapshot_id", "left").na.fill(0, ["lost_items", "lost_chunks"])
    bad = F.lit(False)
    if unreadable is not None:
        plan = plan.join(unreadable.select("snapshot_id", F.lit(True).alias("bad")).distinct(), "snapshot_id", "left")
        bad = F.coalesce("bad", F.lit(False))
    action = F.when(bad, "remove_snapshot").when(F.col("lost_items") == 0, "keep").when(F.col("lost_items") >= F.col("files"), "remove_snapshot").otherwise("drop_items")
    return plan.select("snapshot_id", action.alias("action"), "items", "lost_items", "lost_chunks")


def gated_drops(drops: DataFrame, items: DataFrame, declared: DataFrame, ptrs: DataFrame, refs: DataFrame, removed: DataFrame) -> DataFrame:
    """(snapshot_id, drops, items, gate, action) of each snapshot with items to drop (snapshot_id, item_index): drop_items where every gate holds, else remove_snapshot and the first that doesn't.

    Gates: data, all declared items (snapshot_id, items) are known and so is each to be
    dropped; count, some item stays; pointers, its item stream needs no removed chunk;
    survivors, nor do the items that stay.
    """
    drops = drops.select("snapshot_id", "item_index").distinct()
    own = items.select("snapshot_id", "item_index", F.lit(True).alias("known"))
    known = drops.join(own, ["snapshot_id", "item_index"], "left").groupBy("snapshot_id").agg(F.count("*").alias("drops"), F.count("known").alias("known"))
    have = items.groupBy("snapshot_id").agg(F.count("*").alias("have"))
    stream = ptrs.join(removed.withColumn("hit", F.lit(1)), "chunk_id", "left").groupBy("snapshot_id").agg(F.count("hit").alias("stream_hits"))
    left = refs.join(removed, "chunk_id", "left_semi").join(drops, ["snapshot_id", "item_index"], "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("left_hits"))
    j = known.join(declared.select("snapshot_id", "items"), "snapshot_id", "left").join(have, "snapshot_id", "left").join(stream, "snapshot_id", "left").join(left, "snapshot_id", "left")
    zero = F.lit(0)
    gate = (
        F.when(F.col("items").isNull() | (F.col("items") != F.coalesce("have", zero)) | (F.col("known") < F.col("drops")), "data")
        .when(F.col("drops") >= F.col("items"), "count")
        .when(F.col("stream_hits").isNull() | (F.col("stream_hits") > 0), "pointers")
        .when(F.coalesce("left_hits", zero) > 0, "survivors")
    )
    return j.withColumn("gate", gate).select("snapshot_id", "drops", "items", "gate", F.when(F.col("gate").isNull(), "drop_items").otherwise("remove_snapshot").alias("action"))


#: The order in which a repair is carried out: what would leave references to nothing comes after what makes them.
STEPS = (
    "remove_corrupt_snapshot",
    "remove_invalid_snapshot_key",
    "remove_dangling_index_entries",
    "remove_corrupt_pack",
    "remove_corrupt_chunks",
    "drop_items",
    "remove_snapshot",
    "rebuild_refcounts",
)


def steps(issues: DataFrame, gated: DataFrame) -> DataFrame:
    """(step, action, target): a repair's actions in the order of their steps. Nothing is planned for snapshots that couldn't be read or are of a newer format: refuse_unreadable() stops such a repair."""
    by = {"corrupt_snapshot": ("remove_corrupt_snapshot", F.col("snapshot_id").cast("string")), "invalid_snapshot_key": ("remove_invalid_snapshot_key", F.col("detail")), "missing_pack": ("remove_dangling_index_entries", F.col("pack_id")), "corrupt_pack_content": ("remove_corrupt_pack", F.col("pack_id")), "corrupt_chunk": ("remove_corrupt_chunks", F.col("pack_id"))}
    action, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, of) in by.items():
        action, target = F.when(F.col("kind") == kind, name).otherwise(action), F.when(F.col("kind") == kind, of).otherwise(target)
    own = issues.select(action.alias("action"), target.alias("target")).where("action IS NOT NULL").distinct()
    both = own.unionByName(gated.select("action", F.col("snapshot_id").cast("string").alias("target")))
    last = issues.sparkSession.createDataFrame([("rebuild_refcounts", None)], "action string, target string")
    place = F.create_map(*(F.lit(x) for i, n in enumerate(STEPS, 1) for x in (n, i)))[F.col("action")]
    return both.unionByName(last).select(place.alias("step"), "action", "target")


def survivors(items: DataFrame, refs: DataFrame, removed: DataFrame) -> DataFrame:
    """Items that need no removed chunk."""
    return items.join(refs.join(removed, "chunk_id", "left_semi").select("snapshot_id", "item_index").distinct(), ["snapshot_id", "item_index"], "left_anti")


def rewritten_stats(items: DataFrame, refs: DataFrame, removed: DataFrame) -> DataFrame:
    """Files and bytes of each snapshot once damaged items are dropped."""
    return survivors(items, refs, removed).where("entry_type = 'file'").groupBy("snapshot_id").agg(F.count("*").alias("nfiles"), F.sum("size").alias("original_size"))


def refuse_unreadable(issues: DataFrame, kinds: tuple[str, ...] = ("unsupported_snapshot", "unsupported_snapshot_version", "incompatible_snapshot_envelope", "unreadable_snapshot", "snapshot_read_failed")) -> None:
    """Raise where snapshots of a newer format, or that couldn't be read, are about: a repair could lose them."""
    if not issues.where(F.col("kind").isin(*kinds)).isEmpty():
        raise ValueError("a repair needs every snapshot to be readable")


def full_check_due(last: Column, now: Column, interval_seconds: Column) -> Column:
    """Due where none is known, or the interval has passed."""
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(last) >= interval_seconds, F.lit(True))


def check_share(percent: Column, due: Column) -> Column:
    """The percentage of a catalog that a check covers: all where a full one is due or no share is set."""
    return F.when(F.coalesce(due, F.lit(True)) | percent.isNull(), F.lit(100)).otherwise(percent)


def verify_reconcile(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """(pack_key, outcome): what a verification asked for and what it got: verified, failed, missing, unexpected or duplicate (each answer after the first)."""
    by = Window.partitionBy("pack_key").orderBy("ordinal")
    a = answers.withColumn("n", F.row_number().over(by))
    j = expected.select("pack_key", F.lit(True).alias("asked")).join(a, "pack_key", "full_outer")
    outcome = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("hash_valid") & F.col("header_valid") & F.col("blobs_valid"), "verified").otherwise("failed")
    return j.select("pack_key", outcome.alias("outcome"))
