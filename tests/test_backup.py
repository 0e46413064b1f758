"""Walks, configuration and verification."""

import datetime as dt

from pyspark.sql import functions as F

from stratalog.operators import backup, compaction
from stratalog.sources import formats


def test_other_filesystems_are_skipped_as_trees(spark):
    it = spark.createDataFrame([("a", "dir", 1), ("a/m", "dir", 2), ("a/m/f", "file", 2), ("a/g", "file", 2)], "path string, entry_type string, device int")
    assert {r.path for r in backup.other_filesystem(it, True, 1).collect()} == {"a", "a/g"}
    assert backup.other_filesystem(it, False, 1).count() == 4


def test_kinds_and_errors(spark):
    d = spark.createDataFrame([("fifo", "NotFound"), ("file", None)], "kind string, code string")
    got = d.select(backup.unsupported(F.col("kind")).alias("u"), backup.soft_error(F.col("code")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("named pipe", True), (None, False)]


def test_absolute_paths(spark):
    it = spark.createDataFrame([("home/x/f",), ("etc/g",), ("home",)], "path string")
    roots = spark.createDataFrame([("home", "/mnt/home"), ("", "/")], "prefix string, root string")
    got = {r.path: r.absolute for r in backup.absolute_paths(it, roots).collect()}
    assert got["home/x/f"] == "/mnt/home/x/f" and got["home"] == "/mnt/home"


def test_configuration_values(spark):
    d = spark.createDataFrame([('"a"',), ('["a","b"]',), (None,)], "v string")
    assert [r[0] for r in d.select(backup.string_or_list(F.col("v"))).collect()] == [["a"], ["a", "b"], []]
    s = spark.createDataFrame([("/data/x/",), ('{"paths":["/p","/q"],"label":"l","exclude":["*.o"]}',)], "value string")
    got = {r.label: (r.paths, r.exclude) for r in backup.normalise_sources(s).collect()}
    assert got == {"x": (["/data/x/"], []), "l": (["/p", "/q"], ["*.o"])}


def test_verification(spark):
    import hashlib

    blobs = [b"one", b"three"]
    pack, data, offsets = formats.write_pack(blobs)
    ids = [hashlib.blake2b(b, key=b"k", digest_size=32).hexdigest() for b in blobs]
    index = spark.createDataFrame([(ids[0], pack, 3, offsets[0]), ("0" * 64, pack, 5, offsets[1]), (ids[1], pack, 9, offsets[1])], "chunk_id string, pack_id string, stored_size bigint, pack_offset bigint")
    packs = spark.createDataFrame([(pack, bytearray(data))], "pack_id string, content binary")
    assert sorted(r.outcome for r in backup.verify_chunks(index, packs, b"k").collect()) == ["mismatch", "ok", "short"]
    want = spark.createDataFrame([(pack, offsets[0], 3), (pack, 1, 1)], "pack_key string, offset bigint, length bigint")
    assert backup.expected_blobs_missing(want, formats.scan_packs(packs, path="pack_id")).count() == 1
    assert compaction.PACK_HEADER == len(formats.HEADER)


def test_summaries(spark):
    p = spark.createDataFrame([("packs/ab/" + "a" * 64, 20), ("x", 20), ("packs/ab/" + "b" * 64, 3)], "path string, length bigint")
    r = backup.structure_summary(p).first()
    assert (r.packs, r.bytes, r.errors) == (3, 43, 2) and backup.structure_errors(p).count() == 2
    s = spark.createDataFrame([("unsupported",), ("unreadable",), ("unsupported",), ("ok",)], "state string")
    assert backup.hidden_summary(s).first().hidden == "2 of a newer format, 1 unreadable"


def test_cron():
    t = dt.datetime(2024, 2, 28, 23, 59, 30)
    assert backup.next_run("*/15 * * * *", t) == dt.datetime(2024, 2, 29, 0, 0)
    assert backup.next_run("30 4 1 * *", t) == dt.datetime(2024, 3, 1, 4, 30)
    assert backup.next_run("0 9 * * 1-5", dt.datetime(2024, 6, 1, 10)) == dt.datetime(2024, 6, 3, 9, 0)
