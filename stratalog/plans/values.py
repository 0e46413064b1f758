"""Queries of scalar functions, configuration and walks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import accounting, backup, benchstats, index, restore, sessions, tree
from ..sources import catalog
from ..sources.catalog import with_tables
from .queries import query

# Numbers and sizes


@query(
    """SELECT o_orderkey, CAST(CASE k WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE n * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1125899906842624 END END AS BIGINT) AS report,
  CAST(CASE WHEN k = 1 THEN n * 1024 WHEN k = 2 THEN n * 1048576 END AS BIGINT) AS corpus, CASE WHEN k = 0 THEN NULL ELSE CAST(n % 50 * 60 + k AS DOUBLE) + CASE WHEN k % 2 = 0 THEN n % 7 * 3600 ELSE 0 END END AS elapsed,
  CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' ELSE '' END || abs(d) || ' B' AS delta, CASE WHEN k = 0 THEN '-' ELSE n || ' B' END AS optional,
  CAST(greatest(1, ceil(n / 64.0)) AS BIGINT) AS chunks, CAST(n + n // 255 + 17 AS BIGINT) AS bound, CASE WHEN k > 0 THEN round(n / 1048576.0 / k, 9) END AS mib_s, CASE WHEN k > 0 THEN round(k / (n * 1024 / 1073741824.0), 6) END AS s_gib, CASE WHEN k <> 6 THEN CAST(k * 12.5 AS DOUBLE) END AS cpu,
  round(greatest(0.0, CASE WHEN k > 0 THEN n / CAST(k * 100 AS DOUBLE) ELSE 0.0 END - 2.0), 9) AS sleep, CASE WHEN k = 6 OR n > 100 THEN 20.0 ELSE CAST(n AS DOUBLE) END AS threshold,
  CASE WHEN n * n < 1024 THEN n * n || ' B' ELSE format('{:.1f} KiB', n * n / 1024.0) END AS mounted
FROM (SELECT o_orderkey, 1 + o_orderkey % 900 AS n, o_orderkey % 7 AS k, o_orderkey % 900 - 450 AS d FROM orders)"""
)
def size_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, times and rates as reports and settings write them."""
    key = F.col("o_orderkey")
    o = catalog.table(spark, sf_dir, "orders").select("o_orderkey", (1 + key % 900).alias("n"), (key % 7).alias("k"), (key % 900 - 450).alias("d"))
    n, k = F.col("n"), F.col("k")
    at = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.when(k == 0, "soon").when(k % 2 == 0, F.concat_ws(":", (n % 7).cast("string"), pad(n % 50), pad(k))).otherwise(F.concat_ws(":", (n % 50).cast("string"), pad(k)))
    return o.select(
        "o_orderkey",
        S.parse_bench_size(F.concat(F.when(k == 5, "x").when(k == 6, "").otherwise(n.cast("string")), F.when(k == 6, "NA").otherwise(at("", "K", "MiB", "g", "PB", "", "")))).alias("report"),
        S.parse_corpus_size(F.concat(n.cast("string"), at("", "kb", " MB", "x", "", "k", "m"))).alias("corpus"),
        S.elapsed_seconds(clock).alias("elapsed"),
        S.format_delta("d").alias("delta"),
        S.format_optional_size(F.when(k != 0, n)).alias("optional"),
        S.chunk_count_estimate("n", F.lit(64)).alias("chunks"),
        S.compressed_bound("n").alias("bound"),
        F.round(S.throughput_mib_s("n", "k"), 9).alias("mib_s"),
        F.round(benchstats.seconds_per_gib(k, F.when(k > 0, n * 1024)), 6).alias("s_gib"),
        S.cpu_percent(F.when(k == 6, "?").otherwise(F.concat((k * 12.5).cast("string"), F.lit("%")))).alias("cpu"),
        F.round(S.limiter_sleep("n", k * 100, F.lit(2.0)), 9).alias("sleep"),
        S.compact_threshold(F.when(k != 6, n.cast("double"))).alias("threshold"),
        S.format_mount_size(n * n).alias("mounted"),
    )


# Ids, keys and versions


@query(
    """SELECT p_partkey, CASE WHEN k <> 0 THEN lower(h) END AS parsed, CAST(('0x' || substring(h, 15, 2) || substring(h, 13, 2) || substring(h, 11, 2) || substring(h, 9, 2) || substring(h, 7, 2) || substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2)) AS UBIGINT) AS number,
  sha256('repo-' || k || chr(0) || h) AS fingerprint, substring(sha256(p_name), 1, 32) AS path_hash, p_partkey % 13 > 1 OR (p_partkey % 13 = 1 AND p_partkey % 17 > 2) OR (p_partkey % 13 = 1 AND p_partkey % 17 = 2 AND k > 3) AS newer,
  CASE WHEN k > 1 THEN 'not supported' ELSE 'ok' END AS protocol, n > 0 AND n <= 4294967295 AS blob, CAST(CASE WHEN k % 2 = 0 THEN least(k * 5 * 3, 24) ELSE least(k * 5, 8) END AS BIGINT) AS listing, CAST(least(k * 5, 4) AS BIGINT) AS verifying,
  CAST(CASE WHEN k % 2 = 1 THEN least(p_partkey % 12 + 1, 8) WHEN p_partkey % 12 = 0 THEN 1 ELSE greatest(2, least(4, ceil((p_partkey % 12 + 1) / 2.0))) END AS INTEGER) AS threads
FROM (SELECT *, p_partkey % 5 AS k, sha256(CAST(p_partkey AS VARCHAR)) AS h, (p_partkey % 3) * 3000000000 AS n FROM part)"""
)
def id_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, versions, fingerprints and derived settings."""
    key = F.col("p_partkey")
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name", (key % 5).alias("k"), F.sha2(key.cast("string"), 256).alias("h"), ((key % 3) * 3_000_000_000).alias("n"))
    k, h = F.col("k"), F.col("h")
    version = F.concat(F.when(k % 2 == 0, "v").otherwise(""), F.concat_ws(".", (key % 13).cast("string"), (key % 17).cast("string"), k.cast("string")))
    return p.select(
        "p_partkey",
        F.lower(F.hex(S.parse_id(F.when(k == 0, F.substring(h, 1, 63)).otherwise(F.when(k % 2 == 0, F.upper(h)).otherwise(h))))).alias("parsed"),
        S.id_prefix_number("h").alias("number"),
        backup.fingerprint(F.concat(F.lit("repo-"), k.cast("string")), h).alias("fingerprint"),
        backup.path_hash(F.col("p_name")).alias("path_hash"),
        S.is_newer(version, F.lit("1.2.3")).alias("newer"),
        S.protocol_state("k").alias("protocol"),
        S.valid_blob(F.lit(9), "n").alias("blob"),
        S.listing_concurrency(k * 5, k % 2 == 0).cast("long").alias("listing"),
        S.verify_concurrency(k * 5).cast("long").alias("verifying"),
        S.backup_threads((key % 12 + 1).cast("int"), k % 2 == 0).alias("threads"),
    )


_URLS = ("s3://host/bucket", "s3+http://host/b", "sftp://h/p", "https://h", "http://h/x", "file:///x", "/x/y", "../x", "", "ftp://h", "s3://h")
_URL_KINDS = ("s3", "s3", "sftp", "rest", "rest", "local", "local", "local", "invalid", "invalid", "invalid")
_STORED = ("config", "manifest/x", "index.gen", "snapshots", "snapshots/a", "snapshots/a/b", "packs", "packs/0f", "packs/0f/x", "locks/.tmp.x.1", "a/b", "keys/../x", "/sessions/a/", "", "pending_index//a", "keys/a\\b")
_STORED_OK = (True, False, True, True, True, False, True, True, False, False, False, False, True, True, False, False)


def _list(values) -> str:
    return "[" + ", ".join(str(v).lower() if isinstance(v, bool) else "'" + v + "'" for v in values) + "]"


@query(f"SELECT p_partkey, list_extract({_list(_URL_KINDS)}, p_partkey % {len(_URLS)} + 1) AS kind, list_extract({_list(_STORED_OK)}, p_partkey % {len(_STORED)} + 1) AS stored, p_partkey % 2 = 1 AS pack FROM part")
def key_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of repository URLs, and keys that a server stores."""
    key = F.col("p_partkey")
    of = lambda v: F.element_at(F.array(*map(F.lit, v)), (key % len(v) + 1).cast("int"))
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", of(_URLS).alias("u"), of(_STORED).alias("s"), S.pack_key(F.expr("substring(sha2(CAST(p_partkey AS STRING), 256), 1, 63 + CAST(p_partkey % 2 AS INT))")).alias("pack"))
    return p.select("p_partkey", S.repo_url_kind("u").alias("kind"), S.valid_storage_key("s").alias("stored"), S.valid_storage_key("pack").alias("pack"))


# Texts


@query(
    """SELECT p_partkey, CAST(length(p_name) + length(w) * 2 AS INTEGER) AS width, '&lt;' || replace(p_name, ' ', '&amp; ') || '&quot;' AS html, replace(p_name, ' ', '%20') || '/a%2Bb~/%25' AS url,
  CASE WHEN k = 0 THEN NULL ELSE 'to /srv/' || p_name || ' by x' END AS expanded, 'run ''' || p_name || ''' ''it''\\''''s''' AS command, CASE k WHEN 0 THEN '/home/u' WHEN 1 THEN '/home/u/' || p_name ELSE '~' || p_name END AS home, CASE k WHEN 0 THEN '/' ELSE p_name END AS label,
  CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:5] || '...' || p_name[-4:] END AS short
FROM (SELECT p_partkey, p_partkey % 3 AS k, p_name, repeat(chr(26085), CAST(p_partkey % 3 AS INTEGER)) AS w FROM part)""".replace("\\\\", "\\")
)
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as terminals, pages, addresses, commands and settings show them."""
    from ..operators import folds

    name, k = F.col("p_name"), F.col("p_partkey") % 3
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name", k.cast("int").alias("k"))
    k = F.col("k")
    p = p.withColumn("t", F.when(k == 0, "~").when(k == 1, F.concat(F.lit("~/"), name)).otherwise(F.concat(F.lit("~"), name)))
    return p.select(
        "p_partkey",
        S.display_width(F.concat(name, F.expr("repeat('日', k)"))).alias("width"),
        S.html_escape(F.concat(F.lit("<"), F.replace(name, F.lit(" "), F.lit("& ")), F.lit('"'))).alias("html"),
        S.percent_encode_path(F.concat(name, F.lit("/a+b~/%"))).alias("url"),
        S.expand_placeholders(F.concat(F.lit("to ${ROOT}/"), name, F.when(k == 0, " by ${NOBODY}").otherwise(" by ${WHO}")), {"ROOT": F.lit("/srv"), "WHO": F.lit("x")}).alias("expanded"),
        S.substitute(F.lit("run {name} {who}"), {"name": name, "who": F.lit("it's")}).alias("command"),
        S.expand_tilde("t", F.lit("/home/u")).alias("home"),
        S.label_from_path(F.when(k == 0, "/").otherwise(F.concat(F.lit("/a/b/"), name, F.lit("/")))).alias("label"),
        folds.truncated(12)("p_name").alias("short"),
    )


# Configuration: a source a supplier, some given as bare paths, some with repositories of their own


_SOURCES = """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'src' || s_suppkey ELSE 'l' || s_suppkey % 60 END AS label, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN ['r' || s_suppkey % 7, 'r' || s_suppkey % 9] ELSE [] END AS repos,
  CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 2 = 0 THEN ['*.o', 'x' || s_suppkey] ELSE [] END AS exclude, CASE WHEN s_suppkey % 4 = 0 THEN ['/data/src' || s_suppkey] ELSE ['/p' || s_suppkey, '/q'] END AS paths FROM supplier"""
_REPOS = "SELECT 'r' || r_regionkey AS repo, 'https://h/' || r_name AS url FROM region"


def _raw_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = catalog.table(spark, sf_dir, "supplier")
    text = k.cast("string")
    repos = F.when(k % 3 == 0, F.array(F.concat(F.lit("r"), (k % 7).cast("string")), F.concat(F.lit("r"), (k % 9).cast("string"))))
    exclude = F.when(k % 2 == 0, F.array(F.lit("*.o"), F.concat(F.lit("x"), text)))
    whole = F.to_json(F.struct(F.concat(F.lit("l"), (k % 60).cast("string")).alias("label"), F.array(F.concat(F.lit("/p"), text), F.lit("/q")).alias("paths"), repos.alias("repos"), exclude.alias("exclude")))
    return s.select(k.alias("k"), F.when(k % 4 == 0, F.concat(F.lit("/data/src"), text, F.lit("/"))).otherwise(whole).alias("value"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.normalise_sources(_raw_sources(spark, sf_dir), keep=["k"])


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("repo"), F.concat(F.lit("https://h/"), "r_name").alias("url"))


def _config(body: str, **more: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {"sources": _SOURCES, "repos": _REPOS, **more}.items()) + " " + body


@query(_config("SELECT k, label, array_to_string(list_transform(paths, lambda p: CASE WHEN k % 4 = 0 THEN p || '/' ELSE p END), '|') AS paths, array_to_string(list_concat(['*.tmp', '*.o'], exclude), '|') AS exclude, len(repos) AS repos FROM sources"))
def source_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources given as bare paths or objects, with the excludes of all sources before their own."""
    every = backup.string_or_list(F.lit('["*.tmp", "*.o"]'))
    s = _sources(spark, sf_dir)
    return s.select("k", "label", F.array_join("paths", "|").alias("paths"), F.array_join(backup.merged_excludes(every, F.col("exclude")), "|").alias("exclude"), F.size("repos").cast("long").alias("repos"))


@query(_config("SELECT s.k, r.repo FROM sources s, repos r WHERE len(s.repos) = 0 OR list_contains(s.repos, r.repo)"))
def source_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source and the repositories it goes to."""
    s = _sources(spark, sf_dir).withColumn("label", F.col("k"))
    return sessions.assign_sources(s, _repos(spark, sf_dir)).select(F.col("label").alias("k"), "repo")


@query(_config("SELECT k, r AS repo FROM (SELECT k, unnest(list_distinct(repos)) AS r FROM sources) WHERE r NOT IN (SELECT repo FROM repos)"))
def unknown_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).withColumn("label", F.col("k"))
    return sessions.unknown_repos(s, _repos(spark, sf_dir)).select(F.col("label").alias("k"), "repo").distinct()


@query(_config("SELECT label, count(*) AS n FROM sources GROUP BY label HAVING count(*) > 1"))
def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.duplicates(_sources(spark, sf_dir), "label")


@query(_config("SELECT label, min(k) AS first, count(*) AS sources FROM sources GROUP BY label"))
def source_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a label: the first source that has it."""
    return sessions.first_of(_sources(spark, sf_dir), "label", "k")


_ASKED = "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'l' || c_custkey % 80 WHEN c_custkey % 3 = 1 THEN 'r' || c_custkey % 9 ELSE 'https://h/' || n_name END AS name, c_custkey AS ordinal FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.table(spark, sf_dir, "customer").join(catalog.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("l"), (k % 80).cast("string"))).when(k % 3 == 1, F.concat(F.lit("r"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("https://h/"), "n_name"))
    return c.select(name.alias("name"), k.alias("ordinal"))


@query(_config("SELECT name, min(ordinal) AS ordinal FROM asked GROUP BY name", asked=_ASKED))
def delete_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requested name once, at its first place."""
    return accounting.delete_names(_asked(spark, sf_dir))


@query(_config("SELECT a.name, s.label IS NOT NULL AS known FROM (SELECT DISTINCT name FROM asked) a LEFT JOIN (SELECT DISTINCT label FROM sources) s ON s.label = a.name", asked=_ASKED))
def selected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested labels, and whether a source has them: an unknown one is an error."""
    return sessions.select_labels(_asked(spark, sf_dir).select("name"), _sources(spark, sf_dir).select("label"))


@query(_config("SELECT DISTINCT a.name, coalesce(r.repo, u.repo) AS repo FROM asked a LEFT JOIN repos r ON r.repo = a.name LEFT JOIN (SELECT url, min(repo) AS repo FROM repos GROUP BY url) u ON u.url = a.name", asked=_ASKED.replace("n_name END", "upper(n_name) END")))
def selected_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested repositories by label, else by URL."""
    return sessions.select_repos(_asked(spark, sf_dir).select("name").distinct(), _repos(spark, sf_dir))


@query(_config("SELECT DISTINCT a.path AS outer, b.path AS inner FROM roots a JOIN roots b ON starts_with(b.path, a.path || '/')", roots="SELECT '/d/' || s_nationkey || CASE WHEN s_suppkey % 3 > 0 THEN '/' || s_suppkey % 5 ELSE '' END AS path FROM supplier"))
def nested_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source roots that lie in other ones."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/d/"), F.col("s_nationkey").cast("string"), F.when(k % 3 > 0, F.concat(F.lit("/"), (k % 5).cast("string"))).otherwise(""))
    return tree.nested_roots(catalog.table(spark, sf_dir, "supplier").select(path.alias("path"))).distinct()


# Walks


_WALKED = "SELECT *, item_index % 5 AS device, CASE item_index % 9 WHEN 0 THEN 'fifo' WHEN 1 THEN 'socket' ELSE entry_type END AS kind, CASE item_index % 8 WHEN 0 THEN 'NotFound' WHEN 1 THEN 'OutOfSpace' END AS code FROM items"


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = catalog.items(spark, sf_dir).drop("content"), F.col("item_index")
    return i.withColumns({"device": k % 5, "kind": F.when(k % 9 == 0, "fifo").when(k % 9 == 1, "socket").otherwise(F.col("entry_type")), "code": F.when(k % 8 == 0, "NotFound").when(k % 8 == 1, "OutOfSpace")})


@query(with_tables("items", "SELECT snapshot_id, item_index, CASE kind WHEN 'fifo' THEN 'named pipe' WHEN 'socket' THEN 'socket' END AS skipped, coalesce(code = 'NotFound', false) AS soft FROM walked", walked=_WALKED))
def walk_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that aren't stored, and errors after which a walk goes on."""
    return _walked(spark, sf_dir).select("snapshot_id", "item_index", backup.unsupported(F.col("kind")).alias("skipped"), backup.soft_error(F.col("code")).alias("soft"))


@query(with_tables("items", "SELECT snapshot_id, item_index FROM walked WHERE path NOT IN (SELECT path FROM walked WHERE entry_type = 'dir' AND device <> 2)", walked=_WALKED))
def one_filesystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.other_filesystem(_walked(spark, sf_dir), True, 2).select("snapshot_id", "item_index")


@query(with_tables("items", "SELECT path FROM paths WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) NOT IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM paths WHERE regexp_matches(path, '/doc_1$')) ", paths="SELECT DISTINCT path FROM items"))
def marked_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths outside of directories that hold a marker file."""
    return tree.excluded_by_marker(catalog.items(spark, sf_dir).select("path").distinct(), "doc_1")


_ROOTS = [("src1", "/mnt/one"), ("src1/en", "/mnt/english"), ("src2", "/srv/two"), ("", "/")]
_ROOTS_SQL = "SELECT * FROM (VALUES ('src1', '/mnt/one'), ('src1/en', '/mnt/english'), ('src2', '/srv/two'), ('', '/')) AS r(prefix, root)"


@query(
    with_tables(
        "items",
        """SELECT path, CASE WHEN prefix = '' THEN '/' || path WHEN path = prefix THEN root ELSE root || substring(path, length(prefix) + 1) END AS absolute FROM (
  SELECT path, prefix, root, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS n FROM paths JOIN roots ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/')) WHERE n = 1""",
        paths="SELECT DISTINCT path FROM items",
        roots=_ROOTS_SQL,
    )
)
def absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot paths as paths of the file system, by the longest root."""
    paths = catalog.items(spark, sf_dir).select("path").distinct()
    a = backup.absolute_paths(paths, spark.createDataFrame(_ROOTS, "prefix string, root string"))
    return a.select("path", F.when(F.col("absolute").startswith("//"), F.expr("substring(absolute, 2)")).otherwise(F.col("absolute")).alias("absolute"))


@query(with_tables("items", "SELECT path, max(prefix) AS root FROM paths JOIN roots ON prefix <> '' AND (path = prefix OR starts_with(path, prefix || '/')) GROUP BY path", paths="SELECT DISTINCT path FROM items", roots=_ROOTS_SQL))
def section_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of the file cache that each path belongs to."""
    paths = catalog.items(spark, sf_dir).select("path").distinct()
    return sessions.section_of(paths, spark.createDataFrame([(p,) for p, _ in _ROOTS if p], "root string"))


@query(with_tables("items", "SELECT path, CASE WHEN starts_with(path, 'src1/') THEN '/mnt/one' || substring(path, 5) WHEN starts_with(path, 'src2/') THEN '/srv/two' || substring(path, 5) ELSE path END AS shown FROM (SELECT DISTINCT path FROM items)"))
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([(p, r) for p, r in _ROOTS if p and "/" not in p], "base string, root string")
    return tree.display_paths(catalog.items(spark, sf_dir).select("path").distinct(), sources).select("path", "shown")


@query(with_tables("items", "SELECT snapshot_id, NOT bool_or(entry_type = 'file' AND item_index % 997 = 5) AS usable FROM items GROUP BY snapshot_id"))
def reusable_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents whose items may be reused: none if a file lacks its ctime."""
    i = catalog.items(spark, sf_dir).withColumn("ctime_ns", F.when(F.col("item_index") % 997 != 5, F.col("mtime_ns")))
    return backup.legacy_reuse(i, "snapshot_id")


@query(with_tables("items", "SELECT b.item_index, a.size = b.size AND a.mtime_ns = b.mtime_ns AS same FROM (SELECT * FROM items WHERE snapshot_id = 3) a JOIN (SELECT * FROM items WHERE snapshot_id = 4) b USING (item_index)"))
def drifted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose metadata is the same before and after."""
    i = catalog.items(spark, sf_dir).select("snapshot_id", "item_index", "size", "mtime_ns", F.col("mtime_ns").alias("ctime_ns"), F.lit(1).alias("device"), F.col("item_index").alias("inode"))

    def side(k: int, prefix: str) -> DataFrame:
        return i.where(F.col("snapshot_id") == k).select(F.col("item_index"), *(F.col(c).alias(prefix + c) for c in i.columns[2:]))

    return side(3, "before_").join(side(4, "after_"), "item_index").select("item_index", sessions.metadata_equal("before_", "after_").alias("same"))


@query(with_tables("chunk_refs", "SELECT count(DISTINCT chunk_id) AS entries FROM chunk_refs"))
def index_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a checksum of the index covers; the checksum itself doesn't depend on their order."""
    i = catalog.chunk_index(spark, sf_dir)
    a, b = index.checksum(i), index.checksum(i.repartition(3, "stored_size"))
    return a.join(b, ["entries", "checksum"]).select("entries")


@query(
    """SELECT o_custkey AS repo, count(*) AS files, CAST(sum(CASE WHEN hit THEN 0 ELSE size END) AS BIGINT) AS deduplicated, CAST(sum(size) AS BIGINT) AS original, CAST(sum(size // 2) AS BIGINT) AS compressed
FROM (SELECT o_custkey, o_orderkey % 3 <> 0 AS hit, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders) GROUP BY o_custkey"""
)
def cache_hit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of files taken from the cache count as original and compressed, not as deduplicated."""
    o = catalog.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 3 != 0).alias("hit"), F.floor("o_totalprice").cast("long").alias("size"))
    return accounting.cache_hits(o.withColumn("stored", F.floor(F.col("size") / 2)), "repo")


@query(
    """WITH s AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 5 = 0 THEN '/p' || o_custkey ELSE '/a,/p' || o_custkey END AS paths FROM orders)
SELECT s.o_orderkey, max_by(p.o_orderkey, (p.o_orderdate, p.o_orderkey)) AS parent FROM s JOIN s p USING (paths) WHERE (p.o_orderdate, p.o_orderkey) < (s.o_orderdate, s.o_orderkey) GROUP BY s.o_orderkey"""
)
def parents_by_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot before each one that was taken of the same paths, in whatever order they are given."""
    o, c = catalog.table(spark, sf_dir, "orders"), F.col("o_custkey")
    own = F.concat(F.lit("/p"), c.cast("string"))
    paths = F.when(c % 5 == 0, F.array(own)).when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("/a"), own)).otherwise(F.array(own, F.lit("/a")))
    s = o.select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("ordinal"), paths.alias("source_paths"))
    return sessions.parent_by_paths(s).where("parent IS NOT NULL").select(F.col("name").alias("o_orderkey"), "parent")


@query("SELECT p_partkey, len(map_keys(m)) AS names, CAST(list_sum(list_transform(map_values(m), lambda v: length(v))) AS BIGINT) AS bytes, array_to_string(list_sort(list_filter(map_keys(m), lambda k: starts_with(k, 'user.'))), ',') AS user_names FROM (SELECT p_partkey, MAP {'user.name': p_name, 'user.brand': p_brand, 'security.x': p_type} AS m FROM part)")
def attribute_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended attributes of items, as maps."""
    p = catalog.table(spark, sf_dir, "part")
    m = F.create_map(F.lit("user.name"), F.col("p_name").cast("binary"), F.lit("user.brand"), F.col("p_brand").cast("binary"), F.lit("security.x"), F.col("p_type").cast("binary"))
    return backup.attributes(p.select("p_partkey", m.alias("xattrs")), "p_partkey")


@query(with_tables("items", "SELECT snapshot_id, item_index, segment FROM (SELECT *, lag(segment) OVER (PARTITION BY snapshot_id, item_index ORDER BY segment) AS b FROM (SELECT snapshot_id, item_index, unnest(range(0, greatest(CAST(ceil(size / 1000) AS BIGINT), 1))) AS segment FROM items) WHERE segment % 4 <> 2) WHERE segment <> coalesce(b + 1, 0)"))
def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that don't follow the one before."""
    parts = restore.segments(catalog.items(spark, sf_dir).drop("content"), 1000).where("segment % 4 <> 2")
    return restore.segment_gaps(parts, ["snapshot_id", "item_index"]).select("snapshot_id", "item_index", "segment")

