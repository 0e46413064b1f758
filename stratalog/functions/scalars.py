"""Scalar functions of a file catalog, as Column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SECONDS = {"h": 3600, "d": 86400, "w": 7 * 86400, "m": 30 * 86400, "y": 365 * 86400}
SCHEDULE_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_unit(c: Column, pattern: str, table: dict[str, int]) -> Column:
    """The factor of a unit, null where it is none of the table's."""
    unit = F.regexp_extract(c, pattern, 2)
    return reduce(lambda out, kv: out.when(unit == kv[0], F.lit(kv[1]).cast("long")), table.items(), F.when(F.lit(False), F.lit(0).cast("long")))


def timespan_seconds(c) -> Column:
    """Retention and find durations: h, d, w, m (30 days), y (365 days); a bare number is days; null if malformed."""
    c = F.trim(col(c))
    n = F.regexp_extract(c, r"^(\d+)([hdwmy]?)$", 1).try_cast("long")
    return n * _by_unit(c, r"^(\d+)([hdwmy]?)$", SECONDS | {"": 86400})


def interval_seconds(c) -> Column:
    """Schedule durations: s, m (minutes), h, d; a bare number is days; zero and malformed values are null."""
    c = F.trim(col(c))
    n = F.regexp_extract(c, r"^(\d+)([smhd]?)$", 1).try_cast("long")
    out = n * _by_unit(c, r"^(\d+)([smhd]?)$", SCHEDULE_SECONDS | {"": 86400})
    return F.when(out > 0, out)


def parse_size(c) -> Column:
    """Bytes of 10, 1.5G, 512 KiB: binary units, exact decimals, rounded down; null if malformed."""
    c = F.upper(F.trim(col(c)))
    pattern = r"^(\d+(?:\.\d+)?)\s*([KMGT]?)(?:I?B)?$"
    n = F.regexp_extract(c, pattern, 1).try_cast("decimal(24,6)")
    return F.floor(n * _by_unit(c, pattern, UNITS).cast("decimal(14,0)")).cast("long")


def parse_bench_size(c) -> Column:
    """Bytes of a report's size: digits, or a number with K, M, G, T or P, rounded down; null if malformed, empty or NA."""
    c = F.upper(F.trim(col(c)))
    pattern = r"^(\d+(?:\.\d+)?)([KMGTP]?)(?:I?B?)?$"
    n = F.regexp_extract(c, pattern, 1).try_cast("decimal(24,6)")
    return F.floor(n * _by_unit(c, pattern, UNITS | {"P": 1 << 50}).cast("decimal(17,0)")).cast("long")


def parse_corpus_size(c) -> Column:
    """Bytes of a corpus's size, whose unit (b, kb, mb, gb, tb) can't be left out; null if malformed."""
    c = F.lower(F.trim(col(c)))
    pattern = r"^(\d+(?:\.\d+)?)\s*(b|kb|mb|gb|tb)$"
    n = F.regexp_extract(c, pattern, 1).try_cast("decimal(24,6)")
    units = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40}
    return F.floor(n * _by_unit(c, pattern, units).cast("decimal(14,0)")).cast("long")


def elapsed_seconds(c) -> Column:
    """Seconds of h:mm:ss or m:ss."""
    part = F.reverse(F.split(col(c), ":"))
    number = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(F.size(part).between(2, 3), number(1) + 60 * number(2) + 3600 * number(3))


def format_bytes(c) -> Column:
    """B, KiB, MiB, GiB with two digits; what would round to 1024 of a unit is 1 of the next."""
    n = col(c).cast("long")

    def two(unit: int) -> Column:  # hundredths of the unit, rounded half up
        return F.floor((n.cast("decimal(38,0)") * 100 + unit // 2) / F.lit(unit).cast("decimal(20,0)")).cast("long")

    def shown(unit: int, name: str) -> Column:
        h = two(unit)
        return F.concat(F.floor(h / 100).cast("long").cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit(f" {name}"))

    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(two(1 << 10) < 102400, shown(1 << 10, "KiB"))
        .when(two(1 << 20) < 102400, shown(1 << 20, "MiB"))
        .otherwise(shown(1 << 30, "GiB"))
    )


def format_mount_size(c) -> Column:
    """One digit of the greatest unit that leaves 1 or more, as directory listings show it; ties go to the even digit."""
    n = col(c).cast("double")
    out = F.concat(F.format_string("%.1f", F.bround(n / (1 << 50), 1)), F.lit(" PiB"))
    for i, unit in reversed(list(enumerate(("KiB", "MiB", "GiB", "TiB"), 1))):
        out = F.when(n < float(1 << 10 * (i + 1)), F.concat(F.format_string("%.1f", F.bround(n / float(1 << 10 * i), 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(col(c).cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def format_delta(c) -> Column:
    """A signed size; zero has no sign."""
    n = col(c).cast("long")
    return F.concat(F.when(n > 0, "+").when(n < 0, "-").otherwise(""), format_bytes(F.abs(n)))


def format_optional_size(c) -> Column:
    return F.coalesce(format_bytes(c), F.lit("-"))


def format_count(c) -> Column:
    """Thousands in groups."""
    return F.format_number(col(c).cast("long"), 0)


def format_duration(c) -> Column:
    """1h 02m 03s, 2m 03s or 3s of whole seconds."""
    s = col(c).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), pad(m), F.lit("m "), pad(r), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), pad(r), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def format_age(c) -> Column:
    """3d 4h, 5h, 6m or 7s of whole seconds."""
    s = col(c).cast("long")
    d, h, m = F.floor(s / 86400).cast("long"), F.floor(s % 86400 / 3600).cast("long"), F.floor(s / 60).cast("long")
    return (
        F.when(d > 0, F.concat(d.cast("string"), F.lit("d "), h.cast("string"), F.lit("h")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def savings_percent(stored, original) -> Column:
    """Tenths of a percent saved, null where the original is zero. Tenths are rounded as whole numbers: 63.95 is a little less as a double, its ten times isn't."""
    a, b = col(stored).cast("double"), col(original).cast("double")
    return F.when(b != 0, F.round((1 - a / b) * 100 * 10, 0) / 10 + 0.0)


def display_width(c) -> Column:
    """Columns on a terminal: wide East Asian characters take two."""
    wide = F.regexp_count(col(c), F.lit("[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}\\x{1F300}-\\x{1F64F}\\x{1F900}-\\x{1F9FF}\\x{20000}-\\x{3FFFD}]"))
    return F.length(col(c)) + wide


def size_delta(new, old) -> Column:
    """new - old, clamped to the range of a long."""
    d = col(new).cast("decimal(38,0)") - col(old).cast("decimal(38,0)")
    return F.least(F.greatest(d, F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def file_name(c) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def parent_path(c) -> Column:
    """'' for a path at the root."""
    return F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)


def depth(c) -> Column:
    return F.size(F.split(col(c), "/"))


def ancestors(c) -> Column:
    """Proper ancestors of a relative path, outermost first."""
    parts = F.split(col(c), "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def host_label(c) -> Column:
    return F.substring_index(col(c), ".", 1)


def octal_mode(c) -> Column:
    return F.lpad(F.conv((col(c).cast("long").bitwiseAND(4095)).cast("string"), 10, 8), 4, "0")


def mtime_string(c) -> Column:
    """Nanoseconds since the epoch as text, in the session's zone. Whole numbers only: a quotient would round the last nanoseconds of a second up."""
    second = F.lit(1_000_000_000)
    return F.date_format(F.timestamp_seconds(F.call_function("div", col(c) - F.pmod(col(c), second), second)), "yyyy-MM-dd HH:mm:ss")


def html_escape(c) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_encode_path(c) -> Column:
    """Each component percent-encoded; blanks as %20, separators kept."""
    out = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def shell_escape(c) -> Column:
    """Single quotes around, inner ones closed, escaped and reopened."""
    return F.concat(F.lit("'"), F.replace(col(c), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def substitute(template, values: dict[str, Column]) -> Column:
    """{name} in a hook's command replaced by the shell-escaped value."""
    return reduce(lambda out, kv: F.replace(out, F.lit("{" + kv[0] + "}"), shell_escape(kv[1])), values.items(), col(template))


def expand_tilde(path, home) -> Column:
    """~ and what begins with ~/ in a home directory."""
    p = col(path)
    return F.when(p == "~", col(home)).when(p.startswith("~/"), F.concat(F.rtrim(col(home), F.lit("/")), F.expr("substring({}, 2)".format(path) if isinstance(path, str) else "NULL"))).otherwise(p)


def label_from_path(path) -> Column:
    """The last component of a path; the path itself where it has none."""
    p = col(path)
    name = file_name(F.regexp_replace(p, "/+$", ""))
    return F.when(name.isin("", ".."), p).otherwise(name)


def expand_placeholders(text, values: dict[str, Column]) -> Column:
    """${NAME} replaced by the value of NAME; null where a name has none."""
    out = reduce(lambda out, kv: F.replace(out, F.lit("${" + kv[0] + "}"), kv[1]), values.items(), col(text))
    return F.when(~out.rlike(r"\$\{[A-Za-z_][A-Za-z0-9_]*\}"), out)


def shard_prefix(hex_id) -> Column:
    return F.substring(F.lower(col(hex_id)), 1, 2)


def pack_key(hex_id) -> Column:
    return F.concat(F.lit("packs/"), shard_prefix(hex_id), F.lit("/"), F.lower(col(hex_id)))


def parse_id(c) -> Column:
    """64 hexadecimal digits as binary, else null."""
    return F.when(col(c).rlike("^[0-9a-fA-F]{64}$"), F.unhex(col(c)))


def short_id(hex_id) -> Column:
    return F.substring(F.lower(col(hex_id)), 1, 16)


def id_prefix_number(hex_id) -> Column:
    """The first eight bytes as a little-endian unsigned number."""
    h = col(hex_id)
    swapped = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def version_parts(c) -> Column:
    """(major, minor, patch) of a version, a leading v allowed; null if malformed."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)"
    number = lambda i: F.regexp_extract(col(c), pattern, i).cast("long")
    return F.when(col(c).rlike(pattern), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def is_newer(a, b) -> Column:
    return F.coalesce(version_parts(a) > version_parts(b), F.lit(False))


def protocol_state(version, least: int = 1, most: int = 1) -> Column:
    """ok, too old or not supported; a client that names no version (0) passes while the first one does."""
    v = col(version)
    return F.when(v == 0, "ok" if least <= 1 else "too old").when(v < least, "too old").when(v > most, "not supported").otherwise("ok")


def listing_concurrency(connections, remote) -> Column:
    """Requests at once in a listing: thrice the connections to a remote store, 24 at most; 8 at most to a local one."""
    return F.when(col(remote), F.least(col(connections) * 3, F.lit(24))).otherwise(F.least(col(connections), F.lit(8)))


def verify_concurrency(connections) -> Column:
    return F.least(col(connections), F.lit(4))


def backup_threads(cores, local, most: int = 8) -> Column:
    """Half of the cores, 2 to 4, on a local store (1 where there is one); up to ``most`` on a remote one."""
    half = F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(col(cores) / 2))).cast("int")
    return F.when(~col(local), F.least(col(cores), F.lit(most))).when(col(cores) == 1, 1).otherwise(half).cast("int")


def throughput_mib_s(n, seconds) -> Column:
    return F.when(col(seconds) > 0, col(n).cast("double") / 1048576 / col(seconds))


def cpu_percent(c) -> Column:
    return F.replace(col(c), F.lit("%"), F.lit("")).try_cast("double")


def limiter_sleep(consumed, rate, elapsed) -> Column:
    """Seconds to wait so that consumed bytes take at least their time at a rate."""
    return F.greatest(F.lit(0.0), F.when(col(rate) > 0, col(consumed).cast("double") / col(rate)).otherwise(0.0) - col(elapsed))


def compact_threshold(c) -> Column:
    """A percentage, 20 where it is none."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | ~c.between(0, 100), F.lit(20.0)).otherwise(c)


def pack_target(packs, low, high) -> Column:
    """The size new packs aim at: low times the root of a fiftieth of the packs, in bounds."""
    want = F.floor(col(low).cast("double") * F.sqrt(col(packs).cast("double") / 50)).cast("long")
    return F.least(F.greatest(want, col(low).cast("long")), col(high).cast("long"))


def compressed_bound(n) -> Column:
    """The most bytes a block of n can take when compressed, its tag included."""
    return col(n) + F.floor(col(n) / 255).cast("long") + 17


def chunk_count_estimate(size, average) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(col(size) / col(average)).cast("long"))


# Predicates on keys and paths


def known_repo_key(c) -> Column:
    return col(c).rlike(r"^(config|manifest|index(\.gen)?|(snapshots|locks|sessions|keys|packs|pending_index)/.+)$")


def valid_pack_key(c) -> Column:
    return col(c).rlike(r"^/*packs/[0-9a-fA-F]{2}/[0-9a-fA-F]{64}/*$")


def valid_storage_key(c) -> Column:
    """Keys that a server stores: known names in known folders, no temporary ones, nothing that leaves them."""
    k = F.regexp_replace(F.regexp_replace(col(c), "^/+", ""), "/+$", "")
    folder = k.rlike(r"\A(keys|snapshots|locks|sessions|pending_index)(/[^/]+)?\z")
    pack = k.rlike(r"\Apacks(/[0-9a-fA-F]{2}(/[0-9a-fA-F]{64})?)?\z")
    root = k.rlike(r"\A(config|manifest|index|index\.gen)\z")
    bad = F.contains(col(c), F.lit("\x00")) | F.contains(col(c), F.lit("\\")) | temp_file(c)
    return ~bad & ((k == "") | (safe_relative_path(k) & (folder | pack | root)))


def temp_file(c) -> Column:
    return file_name(F.regexp_replace(col(c), "/+$", "")).startswith(".tmp")


def safe_relative_path(c) -> Column:
    return ~F.exists(F.split(col(c), "/"), lambda x: x.isin("", ".", ".."))


def symlink_class(c) -> Column:
    return F.when(col(c).startswith("/"), "absolute").when(F.array_contains(F.split(col(c), "/"), ".."), "escapes").otherwise("safe")


def valid_blob(offset, length) -> Column:
    """A length of 1 to 2^32-1 whose end is an unsigned 64-bit number."""
    o, n = col(offset).cast("decimal(20,0)"), col(length).cast("decimal(20,0)")
    return (n > 0) & (n <= (1 << 32) - 1) & (o + n <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"))


def repo_url_kind(c) -> Column:
    c = F.trim(col(c))
    return (
        F.when(c == "", "invalid")
        .when(c.rlike("^s3(\\+https?)?://[^/]+/.+"), "s3")
        .when(c.rlike("^sftp://[^/]+/.*"), "sftp")
        .when(c.rlike("^https?://[^/]+"), "rest")
        .when(c.startswith("file://"), "local")
        .when(c.contains("://"), "invalid")
        .otherwise("local")
    )


def glob_regex(pattern: str, ignore_case: bool = False, separator_literal: bool = True) -> str:
    """A regular expression of a glob, over the whole text. With ``separator_literal``, *, ? and brackets stop at separators and ** doesn't."""
    out, i = [], 0
    one = "[^/]" if separator_literal else "."
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            i += 2
            if pattern.startswith("/", i):
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            own = inside[1:] if inside[0] in "!^" else inside
            own = own.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(("(?!/)" if separator_literal else "") + "[" + ("^" if inside[0] in "!^" else "") + own + "]")
            i = end
        else:
            out.append({"*": one + "*", "?": one}.get(c) or ("\\" + c if c in r"\.+^$(){}|[]" else c))
        i += 1
    return ("(?is)" if ignore_case else "(?s)") + r"\A" + "".join(out) + r"(?![\s\S])"


def glob_matches(path, pattern: str, ignore_case: bool = False) -> Column:
    """Find's rule: a pattern with a separator matches the whole path, another one the file name."""
    target = col(path) if "/" in pattern else file_name(path)
    return target.rlike(glob_regex(pattern, ignore_case))


def restore_matches(path, pattern: str) -> Column:
    """Restore's rule: the whole path, and * crosses separators."""
    return col(path).rlike(glob_regex(pattern, separator_literal=False))


def under(path, prefix: str) -> Column:
    """The path itself and what lies below it."""
    return (col(path) == prefix) | col(path).startswith(prefix.rstrip("/") + "/")


def normalise_path_filter(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"^(\./)+", ""), "/+$", "")
