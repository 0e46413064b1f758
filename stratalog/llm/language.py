"""Language identification by Bayesian evidence fusion.

For each row, over the languages and ``und`` (no language known here):

    posterior ~ text likelihood x P(declared language | language)
                x P(address suffix | language) x prior of the host

- Text: byte trigrams of the lower-cased text, hashed, by a multinomial model
  trained on a bounded sample of labelled rows. The mean over the text's trigrams
  counts as at most EFFECTIVE independent ones, for neighbours aren't independent.
  ``und`` is a uniform model.
- Declared: how often rows of each language declare each code, measured on all
  rows by their text posteriors. Codes that no language here has count as one.
- Suffix: how often rows of each language have an address with each suffix, measured
  the same way and smoothed towards the suffix's share of all rows with one.
- Host: grouped sums of text posteriors by host, smoothed towards those of its
  domain, and those towards the sums over all rows.

Null or empty text, declaration or address is no evidence: a row with none has the
prior of all rows. A row is rejected (``kept`` false) where ``und`` wins or no
language has half of the posterior. Rows that repeat an id are judged each by
itself; a null id stays null; an empty table gives no rows. Texts of any length are
read whole, a slice of bytes or one text at a time.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import slices, stored

BUCKETS = 1 << 15
#: Bytes of a text whose trigrams are looked up at once.
PIECE = 1 << 17
#: Trigrams that a text counts as at most.
EFFECTIVE = 60.0
#: Rows of the training sample, at most, and characters of a row in it, at least and at most.
TRAIN_ROWS, TRAIN_CHARS = 4000, (200, 20_000)
#: Weight of the parent's distribution at each level, and of all suffixes', in rows.
ALPHA = 20.0
UND = "und"
#: The weight of ``und`` before any evidence, against 1 of each language: a text too short to tell is no unknown language.
UND_WEIGHT = 0.02
TAG = re.compile(r"<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def counts(text: str) -> np.ndarray:
    """Hashed trigram buckets of a text, one a place."""
    return _buckets(np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8))


def mean_logs(logs: np.ndarray, text: str) -> tuple[int, np.ndarray]:
    """The trigrams of a text and the mean of their rows; long texts are tallied piece by piece."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    n = len(raw) - 2
    if n <= PIECE:
        return n, logs[_buckets(raw)].mean(0, dtype=np.float64)
    tally = np.zeros(BUCKETS, np.int64)
    for at in range(0, n, PIECE):
        tally += np.bincount(_buckets(raw[at : at + PIECE + 2]), minlength=BUCKETS)
    return n, tally @ logs.astype(np.float64) / n


def _buckets(raw: np.ndarray) -> np.ndarray:
    b = raw.astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def train(df: DataFrame, languages: list[str], text_col: str = "text", lang_col: str = "lang", seed_col: str = "doc_id") -> np.ndarray:
    """Log probabilities, a row a language and one for ``und``, from at most TRAIN_ROWS labelled rows chosen by the hash of their ids."""
    total = df.count()
    every = max(1, total // TRAIN_ROWS)
    text = F.col(text_col).cast("string")
    sample = df.where(F.pmod(F.xxhash64(F.col(seed_col)), F.lit(every)) == 0).where(F.col(lang_col).isin(languages) & F.length(text).between(*TRAIN_CHARS))
    c = np.full((len(languages) + 1, BUCKETS), 0.5)
    for r in sample.select(F.col(lang_col).alias("l"), text.alias("t")).limit(TRAIN_ROWS).collect():
        c[languages.index(r.l)] += np.bincount(counts(r.t), minlength=BUCKETS)
    c[-1] = 1.0
    return np.log(c / c.sum(1, keepdims=True)).astype(np.float32)


def domain_of(name: str) -> str:
    """The part of a host's name that was registered: two labels, three where a country's second one is short, as in co.uk."""
    labels = name.split(".")
    return ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else -2 :])


def plain(html: str) -> str:
    """The text of a page: no tags, scripts, styles or navigation."""
    import html as entities

    return entities.unescape(TAG.sub(" ", html))


def _read(df: DataFrame, model: np.ndarray, languages: list[str], id_col: str, text_col: str, declared_col: str | None = None, url_col: str | None = None, host_col: str | None = None, html: bool = False, carry: list[str] | None = None):
    """The columns that evidence is taken from, the function that takes it from their batches, and the type of what is carried."""
    none = F.lit(None).cast("string")
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets a language

    def string(c):
        return F.col(c).cast("string") if c else none

    within = text_col in (carry or []) and df.schema[text_col].dataType.simpleString() == "string"  # texts that are carried go to the worker once
    size = F.octet_length(F.col(text_col)).cast("long") if within else string(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), size.alias("text"), string(declared_col).alias("declared"), string(url_col).alias("url"), string(host_col).alias("host"), *([F.struct(*carry).alias("carried")] if carry else []))
    more = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    names = ["id", "text", "declared", "suffix", "domain", "host", *(["carried"] if carry else [])]

    def run(batches):
        logs = shared.value.T.copy()
        for batch in batches:
            for part in slices(batch, 1):
                ll, declared, suffix, domain, host = [], [], [], [], []
                texts = part.column(5).field(text_col) if within else part.column(1)
                for t, code, url, h in zip(*(c.to_pylist() for c in (texts, *part.columns[2:5]))):
                    t = t or ""
                    if html:
                        m = HTML_LANG.search(t)
                        code, t = m[1] if m else code, plain(t)
                    t = t.strip()
                    n, v = mean_logs(logs, t) if t else (0, np.zeros(logs.shape[1]))
                    v = v * min(n, EFFECTIVE)
                    v[-1] += np.log(UND_WEIGHT)
                    ll.append(v.tolist())
                    code = (code or "").strip().lower().split("-")[0]
                    declared.append(code if code in languages else "other" if code else "none")
                    at = HOST.match(url or "")
                    name = (at[1].lower() if at else h or "").strip(".")
                    labels = name.split(".")
                    suffix.append(labels[-1] if at and len(labels) > 1 else "")
                    domain.append(domain_of(name) if at else name)
                    host.append(name)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ll, pa.list_(pa.float64())), *(pa.array(c, pa.string()) for c in (declared, suffix, domain, host)), *part.columns[5:]], names)

    return rows, run, more


def evidence(df: DataFrame, model: np.ndarray, languages: list[str], id_col: str, text_col: str, declared_col: str | None = None, url_col: str | None = None, host_col: str | None = None, html: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(id, text array<double>, declared, suffix, domain, host): the text log likelihoods and the rest, as far as given. With ``html``, text and declared language come from the markup. ``carry`` names columns that come along in a struct ``carried``."""
    rows, run, more = _read(df, model, languages, id_col, text_col, declared_col, url_col, host_col, html, carry)
    return rows.mapInArrow(run, "id bigint, text array<double>, declared string, suffix string, domain string, host string" + more)


def _soft(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _weights(k: int):
    """The function of batches of (text, declared, suffix, domain, host) that makes posteriors by the text alone, and its schema."""
    p = [f"p{i}" for i in range(k)]

    def soft(batches):
        for batch in batches:
            m = _soft(_matrix(batch.column("text"), k)) if batch.num_rows else np.zeros((0, k))
            keys = ["declared", "suffix", "domain", "host"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), *(pa.array(m[:, i]) for i in range(k))], [*keys, *p])

    return soft, "declared string, suffix string, domain string, host string, " + ", ".join(f"{x} double" for x in p)


def fuse(rows: DataFrame, languages: list[str], weighed: DataFrame | None = None) -> DataFrame:
    """(id, language, probability, kept) from rows of evidence, and ``carried`` where they have it. ``weighed``: the rows' posteriors by the text alone, where they needn't be taken from ``rows``."""
    names = [*languages, UND]
    k = len(names)
    p = [f"p{i}" for i in range(k)]
    if weighed is None:
        weighed = rows.select("text", "declared", "suffix", "domain", "host").mapInArrow(*_weights(k))
    sums = [F.sum(x).alias(x) for x in p]
    hosts = stored(weighed.groupBy("declared", "suffix", "domain", "host").agg(*sums), "language-hosts")  # partial sums first: a hot host costs a row a task
    by_code = {r.declared: np.array([r[x] for x in p]) for r in hosts.groupBy("declared").agg(*sums).collect()}  # a row a language, and two
    codes = [*languages, "other", "none"]
    table = np.array([by_code.get(c, np.zeros(k)) for c in codes])
    all_rows = table.sum(0)
    prior = (all_rows + 1) / (all_rows + 1).sum()
    seen = table[:-1] + 0.5 + 5.0 * np.eye(k)[: len(codes) - 1]  # most pages declare what they are
    says = np.log(seen / seen.sum(0))
    with_suffix = [x or 0.0 for x in hosts.where("suffix <> ''").agg(*sums).first()]

    def level(keys: list[str], tag: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(*(F.sum(x).alias(f"{tag}{i}") for i, x in enumerate(p)))

    def total(tag: str):
        return sum((F.col(f"{tag}{i}") for i in range(k)), F.lit(0.0))

    tree = level(["suffix", "domain", "host"], "h").join(level(["suffix", "domain"], "d"), ["suffix", "domain"]).join(level(["suffix"], "s"), "suffix")
    share = [F.lit(float(x)) for x in prior]
    for t in "dh":
        share = [(F.col(f"{t}{i}") + F.lit(ALPHA) * b) / (total(t) + F.lit(ALPHA)) for i, b in enumerate(share)]
    # P(suffix | language) by its share of all rows with a suffix; that share is the same for all languages and falls out of an even ratio.
    own = total("s") / F.lit(max(sum(with_suffix), 1e-9))
    ends = [F.when(F.col("suffix") == "", 0.0).otherwise(F.log((F.col(f"s{i}") + F.lit(ALPHA) * own) / F.lit(n + ALPHA))) for i, n in enumerate(with_suffix)]
    priors = tree.select("suffix", "domain", "host", F.array(*share).alias("prior"), F.array(*ends).alias("ends"))

    # Bayes by expressions: a second worker beside each one that takes evidence would double their memory.
    told = reduce(lambda out, x: out.when(F.col("declared") == x[0], F.array(*(F.lit(float(v)) for v in x[1]))), zip(codes, says), F).otherwise(F.array(*[F.lit(0.0)] * k))
    carried = ["carried"] if "carried" in rows.columns else []
    joined = rows.join(priors, ["suffix", "domain", "host"]).withColumn("told", told)
    log = F.array(*(F.col("text")[i] + F.log(F.col("prior")[i]) + F.col("ends")[i] + F.col("told")[i] for i in range(k)))
    found = joined.select("id", log.alias("log"), *carried).withColumn("most", F.array_max("log"))
    best = F.array_position("log", F.col("most")).cast("int")
    top = 1 / reduce(add, (F.exp(F.col("log")[i] - F.col("most")) for i in range(k)))
    found = found.select("id", best.alias("best"), top.alias("probability"), *carried)
    kept = (F.col("best") < k) & (F.col("probability") >= 0.5)
    return found.select("id", F.element_at(F.array(*map(F.lit, names)), F.col("best")).alias("language"), "probability", kept.alias("kept"), *carried)


def identify(df: DataFrame, model: np.ndarray, languages: list[str], **columns) -> DataFrame:
    """(id, language, probability, kept) of each row; see evidence() for the columns. With ``carry``, the evidence is taken twice, for a table of it would copy the texts; the first time, the same worker weighs it."""
    rows = evidence(df, model, languages, **columns)
    if not columns.get("carry"):
        return fuse(stored(rows, "language-evidence"), languages)
    alone, run, _ = _read(df, model, languages, **columns | {"carry": None})
    soft, schema = _weights(len(languages) + 1)
    return fuse(rows, languages, alone.mapInArrow(lambda batches: soft(run(batches)), schema))
