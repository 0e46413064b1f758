"""Cases with known answers, and invariants, of operators that SQL doesn't check."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalars as S
from stratalog.operators import check, compaction, diff, find, folds, index, restore, retention, sessions, tree
from stratalog.plans.extras import QUERIES
from stratalog.sources import formats
from stratalog.streaming import streams


def snaps(spark, times, label="a"):
    return spark.createDataFrame([(label, f"s{i}", t, i) for i, t in enumerate(times)], "source_label string, name string, time timestamp_ntz, ordinal bigint")


def policy(spark, **rules):
    names = ["keep_within_days", "keep_last", "keep_hourly", "keep_daily", "keep_weekly", "keep_monthly", "keep_yearly"]
    return spark.createDataFrame([("a", *(rules.get(n) for n in names))], "source_label string, " + ", ".join(f"{n} int" for n in names))


def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def test_hourly_keeps_newest(spark):
    t = [dt.datetime(2024, 6, 1, h) for h in range(7, 12)]
    kept = {r.name for r in retention.decide(snaps(spark, t), policy(spark, keep_hourly=3), now()).where("decision = 'keep'").collect()}
    assert kept == {"s2", "s3", "s4"}


def test_reasons_add_up(spark):
    t = [dt.datetime(2024, 5, d, 10) for d in (29, 30, 31)]
    got = {r.name: r.reasons for r in retention.decide(snaps(spark, t), policy(spark, keep_last=1, keep_daily=2), now()).collect()}
    assert got == {"s2": "last #1, daily #1", "s1": "daily #2", "s0": ""}


def test_rule_of_zero_is_an_error(spark):
    with pytest.raises(ValueError):
        retention.check_policies(policy(spark, keep_last=0))
    with pytest.raises(ValueError):
        retention.check_policies(policy(spark))


def test_glob_and_separators():
    import re

    m = lambda p, s, **k: bool(re.search(S.glob_regex(p, **k), s))
    assert not m("src/*.rs", "src/a/b.rs") and m("src/**/*.rs", "src/a/b.rs") and m("src/**/*.rs", "src/b.rs")
    assert m("src/*.rs", "src/a/b.rs", separator_literal=False)
    assert m("[!a]?", "bc") and not m("[!a]?", "ac") and m("A*", "abc", ignore_case=True)


def items(spark, rows):
    return spark.createDataFrame([(k, i, p, t, c, len(c)) for k, i, p, t, c in rows], "snapshot_id bigint, item_index bigint, path string, entry_type string, content string, size bigint")


def test_diff_cases(spark):
    it = items(spark, [(1, 1, "same", "file", "x"), (1, 2, "mod", "file", "ab"), (1, 3, "gone", "file", "c"), (1, 4, "d", "dir", ""), (2, 1, "same", "file", "x"), (2, 2, "mod", "file", "ba"), (2, 3, "new", "file", "n"), (2, 4, "e", "symlink", "")])
    got = {(r.path, r.change, r.delta) for r in diff.diff(it, 1, 2).collect()}
    assert got == {("mod", "modified", 0), ("gone", "removed", -1), ("new", "added", 1)}
    assert [r.change for r in diff.sort_rows(diff.diff(it, 1, 2), "change").collect()] == ["added", "removed", "modified"]
    with pytest.raises(ValueError):
        diff.diff(it, 1, 1)


def test_last_duplicate_path_wins(spark):
    it = items(spark, [(1, 1, "p", "file", "x"), (1, 2, "p", "file", "yy"), (2, 1, "p", "file", "yy")])
    assert diff.diff(it, 1, 2).count() == 0


def test_timeline_statuses(spark):
    it = items(spark, [(1, 1, "p", "file", "x"), (2, 1, "p", "file", "y"), (3, 1, "p", "file", "y")])
    assert [r.status for r in find.timeline(it).orderBy("snapshot_id").collect()] == ["added", "modified", "unchanged"]


def test_cap_includes_the_row_that_crosses(spark):
    random.seed(5)
    rows = [(f"p{i:03d}", random.choice([10, 1000, 5000, 5000]), random.randrange(1, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "pack_id string, dead bigint, size bigint")
    got = {r.pack_id: r.before for r in compaction.running(df, "dead", "size").collect()}
    total, want = 0, {}
    for p, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[p] = total
        total += n
    assert got == want


def test_reconcile_then_apply_conserves_references(spark):
    random.seed(1)
    entry = lambda ids: [(f"c{i}", random.randrange(1, 5), 10, "p") for i in ids]
    schema = "chunk_id string, refcount bigint, stored_size bigint, pack_id string"
    now, new = spark.createDataFrame(entry(range(50)), schema), spark.createDataFrame(entry(range(30, 80)), schema)
    bumps = spark.createDataFrame([(f"c{i}", 2) for i in range(20)], "chunk_id string, n bigint")
    after = index.apply_delta(now, *index.reconcile(new, bumps, now))
    total = lambda d: d.agg(F.sum("refcount")).first()[0]
    assert total(after) == total(now) + total(new) + 40 and after.count() == 80


def test_repair_drops_items_or_snapshots(spark):
    it = items(spark, [(1, 1, "a", "file", "x"), (1, 2, "b", "file", "y"), (2, 1, "a", "file", "x")])
    refs = spark.createDataFrame([(1, 1, 0, "x", 1), (1, 2, 0, "y", 1), (2, 1, 0, "x", 1)], "snapshot_id bigint, item_index bigint, pos bigint, chunk_id string, size bigint")
    gone = spark.createDataFrame([("x",)], "chunk_id string")
    assert {r.snapshot_id: r.action for r in check.repair_plan(it, refs, gone).collect()} == {1: "drop_items", 2: "remove_snapshot"}
    with pytest.raises(ValueError):
        check.refuse_unreadable(check.issue(refs, "unsupported_snapshot"))


def test_samples_are_exact(spark):
    for n, p in ((1, 1), (10, 25), (101, 7)):
        assert check.sample_exact(spark.range(n), p, F.col("id")).count() == max(1, -(-n * p // 100))


def test_read_groups_fold(spark):
    random.seed(2)
    blobs, at = [], 9
    for _ in range(200):
        at += random.choice([0, 0, 10, 500])
        n = random.randrange(1, 300)
        blobs.append((at, n))
        at += n
    df = spark.createDataFrame([("p", o, n) for o, n in blobs], "pack_id string, pack_offset bigint, stored_size bigint")
    want, cur = [], None
    for o, n in blobs:
        if cur and o - cur[1] <= 100 and o + n - cur[0] <= 1000:
            cur[1] = max(cur[1], o + n)
            cur[2] += 1
        else:
            cur = [o, o + n, 1]
            want.append(cur)
    got = [(r.read_start, r.read_end, r.blobs) for r in restore.read_groups(df, 100, 1000).orderBy("read_start").collect()]
    assert got == [tuple(w) for w in want]


def test_segments_have_no_gaps(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 25)], "f bigint, size bigint")
    parts = restore.segments(df, 10)
    assert restore.segment_gaps(parts, ["f"]).count() == 0 and parts.agg(F.sum("length")).first()[0] == 35
    assert restore.segment_gaps(parts.where("segment <> 1"), ["f"]).count() == 1


def test_packs_close(spark):
    rows = [(1, i, 100, float(i)) for i in range(10)] + [(2, i, 1, i * 200.0) for i in range(4)]
    df = spark.createDataFrame(rows, "session bigint, seq bigint, size bigint, at double")
    got = {(r.session, r.seq): r.pack for r in folds.assign_packs(df, 300).collect()}
    assert [got[1, i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and [got[2, i] for i in range(4)] == [0, 0, 1, 1]


def test_ignore_rules():
    r = folds.IgnoreRules(["*.o", "!keep.o", "build/", "/top"])
    assert r.ignored("a/x.o", False) and not r.ignored("a/keep.o", False)
    assert r.ignored("build/keep.o", False) and not r.ignored("build", False)
    assert r.ignored("top", False) and not r.ignored("a/top", False)


def test_truncation():
    assert folds.truncate_middle("abcdefghij", 10) == "abcdefghij" and folds.truncate_middle("abcdefghijk", 9) == "abc...ijk"
    assert len(folds.truncate_middle("日本語日本語", 7)) <= 7


def test_chunks_cover_and_repeat():
    random.seed(4)
    data = random.randbytes(200_000)
    ends = formats.cut_points(data, 512, 2048, 8192)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= 8192 and min(sizes[:-1]) >= 512 and 1000 < len(data) / len(ends) < 4500
    assert ends == formats.cut_points(data, 512, 2048, 8192)
    moved = formats.cut_points(b"x" * 777 + data, 512, 2048, 8192)
    assert len({e - 777 for e in moved} & set(ends)) > len(ends) // 2
    assert formats.cut_points(b"", 512, 2048, 8192) == [] and formats.cut_points(b"abc", 512, 2048, 8192) == [3]


def test_packs_scan_back(spark):
    id_, data, offsets = formats.write_pack([b"one", b"three"])
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data + b"x")), ("c", bytearray(b"no"))], "path string, content binary")
    rows = formats.scan_packs(df).collect()
    assert [(r.offset, r.length) for r in rows if r.path == "a"] == [(offsets[0], 3), (offsets[1], 5)]
    assert {r.path: r.error for r in rows if r.error} == {"b": "trailing bytes", "c": "bad header"}


def test_objects_open_by_type_only(spark, sf):
    r = QUERIES["sealed_objects"](spark, sf).agg(F.bool_and("equal"), F.bool_and("refused"), F.min("kind")).first()
    assert tuple(r) == (True, True, "chunk_data")


def test_decompression_is_capped(spark, sf):
    r = QUERIES["compressed_texts"](spark, sf).agg(*(F.bool_and(f"{c}_equal") for c in ("none", "lz4", "zstd"))).first()
    assert all(r)
    d = spark.createDataFrame([(bytearray(b"a" * 1000),)], "b binary").select(formats.compress("zstd")("b").alias("z"))
    assert d.select(formats.decompress(100)("z").alias("x")).first().x is None


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(S.format_bytes(F.lit(1023))) == "1023 B" and v(S.format_bytes(F.lit(1048575))) == "1.00 MiB" and v(S.format_bytes(F.lit(1536))) == "1.50 KiB"
    assert v(S.format_delta(F.lit(-2048))) == "-2.00 KiB"
    assert v(S.timespan_seconds(F.lit("2m"))) == 60 * 86400 and v(S.interval_seconds(F.lit("2m"))) == 120 and v(S.interval_seconds(F.lit("0"))) is None
    assert v(S.parse_size(F.lit("1.5K"))) == 1536 and v(S.parse_size(F.lit("x"))) is None
    assert v(S.elapsed_seconds(F.lit("1:02:03.5"))) == 3723.5 and v(S.elapsed_seconds(F.lit("2:03"))) == 123
    assert v(S.html_escape(F.lit("<a&'"))) == "&lt;a&amp;&#39;" and v(S.percent_encode_path(F.lit("a b/ü"))) == "a%20b/%C3%BC"
    assert v(S.shell_escape(F.lit("it's"))) == "'it'\\''s'"
    assert v(S.id_prefix_number(F.lit("0100000000000000" + "0" * 48))) == 1
    assert v(S.is_newer(F.lit("v1.10.0"), F.lit("1.9.9"))) and not v(S.is_newer(F.lit("x"), F.lit("1.0.0")))
    assert v(S.size_delta(F.lit(5), F.lit(9))) == -4 and v(S.display_width(F.lit("a日"))) == 3
    assert [v(S.repo_url_kind(F.lit(u))) for u in ("s3://b/k", "sftp://h/p", "https://h", "file:///x", "/x", "ftp://h")] == ["s3", "sftp", "rest", "local", "local", "invalid"]
    assert v(S.compact_threshold(F.lit(float("nan")))) == 20.0


def test_trees(spark):
    p = spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/z",)], "path string")
    assert tree.common_prefix(p).first().prefix == "a"
    assert {r.path for r in tree.implicit_dirs(p).collect()} == {"a", "a/b"}
    m = p.withColumn("checked", F.col("path") != "a/z")
    assert {r.path for r in tree.minimal_checked(m).collect()} == {"a/b"}
    assert {(r.outer, r.inner) for r in tree.nested_roots(spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "path string")).collect()} == {("/a", "/a/b")}


def test_sources_and_sections(spark):
    src = spark.createDataFrame([("s1", ["r1", "r9"]), ("s2", [])], "label string, repos array<string>")
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo string")
    assert {tuple(r) for r in sessions.assign_sources(src, repos).collect()} == {("s1", "r1"), ("s2", "r1"), ("s2", "r2")}
    assert {tuple(r) for r in sessions.unknown_repos(src, repos).collect()} == {("s1", "r9")}
    got = sessions.section_of(spark.createDataFrame([("/a/b/c",)], "path string"), spark.createDataFrame([("/a",), ("/a/b",)], "root string"))
    assert got.first().root == "/a/b"


def test_markers_tolerate_malformed_json(spark):
    raw = spark.createDataFrame([("k1", '{"hostname":"h","pid":3,"time":"2024-01-01T00:00:00"}'), ("k2", "{")], "key string, value string")
    assert {r.key: r.malformed for r in sessions.parse_markers(raw).collect()} == {"k1": False, "k2": True}


def test_keyed_state_registers_once_and_goes_stale(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=10)), (2, t + dt.timedelta(hours=3))]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "user_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.discover(spark, str(tmp_path / "in"), "user_id bigint, ts timestamp", files_per_trigger=1)
    q = streams.session_state(s).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.user_id, r.event) for r in spark.table("states").collect()]
    assert got.count((1, "registered")) == 1 and got.count((2, "registered")) == 1 and (2, "stale") not in got
