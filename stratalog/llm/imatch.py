"""I-Match document fingerprints over an inverse-document-frequency band.

The lexicon holds the terms that occur in a share of all documents between two
bounds. A document's terms in it are sorted and hashed: once whole, and once for
each of several random subsets of the lexicon, whose rates range from most of it
to few of its terms, so that more subsets agree the fewer terms two texts don't
share. The likeness of two fingerprints is the share of agreeing subsets, of
those in which either text has a term.

The lexicon's size is bounded by the mean number of terms of a document over the
lower bound, whatever the number of documents. Where documents are so long that the
band holds more than LEXICON terms, its lower bound rises until no more are left.

Null and empty texts have no terms; a text without terms of the lexicon is
fingerprinted by all its terms and agrees only with equal ones. The next document
is the one of the next smaller doc_id, repeated ids in the order of a hash of their
texts, nulls last; after the last comes the first, so a single row follows itself.
An empty table gives no rows. Texts are taken whole; a worker holds the rows of a
slice and one more.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow import slices, stored, two
from .words import mixed

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rates of the random subsets.
RATES = (0.5,) * 4 + (0.05,) * 8 + (0.01,) * 16 + (0.004,) * 18 + (0.0015,) * 18
#: Bounds of the share of documents that hold a term, and the size the lexicon never has.
BAND, LEXICON = (0.001, 0.3), 2_000_000
LEAST = -(1 << 63)
#: Rows of a bucket of consecutive documents, the most buckets, and rows of each in the sample that bounds them.
BUCKET_ROWS, BUCKETS, SAMPLED = 4000, 100_000, 20


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct terms, A-Z lower-cased."""
    found = {*TERM.findall(text.encode("utf-8", "surrogatepass").lower())}
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def lexicon(df: DataFrame, band: tuple[float, float] = BAND, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band, from all documents."""

    def run(batches):
        held, size = [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            u, inverse = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(size, np.int64)])
            return u, np.bincount(inverse, weight, len(u)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    held.append(x := terms(t or ""))
                    size += len(x)
                    if size > 2_000_000:
                        keys, counts = merged()
                        held, size = [], 0
                        if len(keys) > 2_000_000:  # what was counted can go on as it is
                            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["term", "c"])
                            keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], ["term", "c"])

    texts = df.select(F.col(text_col).cast("string").alias("text"))
    n = df.count()
    inside = (F.col("c") >= band[0] * n) & (F.col("c") <= band[1] * n)
    found = stored(texts.mapInArrow(run, "term bigint, c bigint").groupBy("term").agg(F.sum("c").alias("c")).where(inside), "lexicon")
    if found.count() > LEXICON:
        step = F.floor(F.log2(F.col("c").cast("double")) * 64)  # some thousand steps of frequency
        steps = found.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
        room, least = LEXICON, 1 << 40
        for r in steps:
            room -= r["count"]
            if room < 0:
                break
            least = r.step
        found = found.where(step >= least)
    return np.sort(found.select("term").toArrow().column(0).to_numpy().view(np.uint64))  # LEXICON at most


class Fingerprinter:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.member = np.zeros((len(words), len(RATES)), bool)
        for k, rate in enumerate(RATES):
            self.member[:, k] = mixed(words + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) < np.uint64(int(rate * (1 << 64)))

    def of(self, text: str) -> list[str]:
        """The whole hash and that of each subset, empty where the text has no term in it."""
        t = terms(text)
        at = np.searchsorted(self.words, t)
        at[at == len(self.words)] = 0
        inside = self.words[at] == t if len(self.words) else np.zeros(len(t), bool)
        own, member = t[inside], self.member[at[inside]] if len(self.words) else self.member
        if not len(own):
            return ["x" + xxhash.xxh3_64_hexdigest(t.tobytes()), *[""] * len(RATES)]
        return [xxhash.xxh3_64_hexdigest(own.tobytes()), *(xxhash.xxh3_64_hexdigest(s.tobytes())[:8] if len(s := own[m]) else "" for m in member.T)]


def likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a[1:], b[1:]) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def edited(text: str, following: str) -> str:
    """The second half replaced by the beginning of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Buckets:
    """Consecutive ranges of rows in ascending order of (a, x), by sampled bounds."""

    def __init__(self, a: np.ndarray, x: np.ndarray):
        self.a, self.x = a, x

    def of(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many bounds are not above each row."""
        low, high = np.searchsorted(self.a, a), np.searchsorted(self.a, a, "right")
        for v in np.unique(a[low < high]):  # bounds of one id
            at = np.flatnonzero(a == v)
            i, j = low[at[0]], high[at[0]]
            low[at] += np.searchsorted(self.x[i:j], x[at], "right")
        return low.astype(np.int32)


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, halo, a, x, doc_id, text), by bucket in descending order of doc_id; after each bucket, the first row of the next one. Bounds are of (id, text hash), so that a repeated or null id may take many buckets."""
    rows = two(df, id_col, text_col).select(F.bitwise_not(F.coalesce("doc_id", F.lit(LEAST))).alias("a"), F.xxhash64("text").alias("x"), "doc_id", "text")
    keys = stored(rows.select("a", "x"), "imatch-order")
    n = keys.count()
    parts = max(1, min(-(-n // BUCKET_ROWS), BUCKETS))
    some = keys.sample(min(1.0, SAMPLED * parts / n), 1).toArrow() if parts > 1 else keys.limit(0).toArrow()  # SAMPLED * BUCKETS rows at most, about
    a, x = (some.column(i).to_numpy() for i in range(2))
    order = np.lexsort((x, a))
    at = order[np.linspace(0, len(order), parts, endpoint=False).astype(np.int64)[1:]] if len(order) >= parts else order
    buckets = Buckets(a[at], x[at])

    def heads(batches):
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            a, x = (batch.column(i).to_numpy() for i in range(2))
            bucket = buckets.of(a, x)
            order = np.lexsort((x, a, bucket))
            own, first = np.unique(bucket[order], return_index=True)
            for k, i in zip(own.tolist(), order[first].tolist()):
                row = (int(a[i]), int(x[i]))
                least[k] = min(least.get(k, row), row)
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), *(pa.array([v[i] for v in least.values()], pa.int64()) for i in range(2))], ["bucket", "a", "x"])

    one = F.min(F.struct("a", "x")).alias("m")
    first = sorted((r.bucket, (r.m.a, r.m.x)) for r in keys.mapInArrow(heads, "bucket int, a bigint, x bigint").groupBy("bucket").agg(one).collect())  # a row a bucket
    before = {key: first[i - 1][0] for i, (_, key) in enumerate(first)}  # whose halo a head is; the first follows the last
    known = np.array(sorted({k[0] for k in before}), np.int64)

    def deal(batches):
        for batch in batches:
            a, x = (batch.column(i).to_numpy() for i in range(2))
            again = {key: i for i in np.flatnonzero(np.isin(a, known)).tolist() if (key := (int(a[i]), int(x[i]))) in before}
            at = pa.array(np.r_[np.arange(len(a)), list(again.values())].astype(np.int64))
            to = np.r_[buckets.of(a, x), [before[k] for k in again]].astype(np.int32)
            halo = np.r_[np.zeros(len(a)), np.ones(len(again))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(halo), *(c.take(at) for c in batch.columns)], ["bucket", "halo", "a", "x", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, halo int, a bigint, x bigint, doc_id bigint, text string")
    # A bucket is a partition, so no task gets several.
    return dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "halo", "a", "x")


def fingerprints(df: DataFrame, band: tuple[float, float] = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon(df, band, text_col).tobytes())  # LEXICON hashes at most
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        make = Fingerprinter(np.frombuffer(shared.value, np.uint64))
        bucket, last, out = None, None, []

        def row(doc, text, own, following, next_print):
            other = edited(text, following)
            print_ = make.of(other)
            return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), ".".join(own), ".".join(print_), likeness(own, print_), likeness(own, next_print))

        def flush():
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for part in slices(batch, 5):
                for b, halo, _, _, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                    text = text or ""
                    if b != bucket:
                        bucket, last = b, None
                    elif last is None:
                        continue  # another row of the head's doc_id
                    own = make.of(text)
                    if last:
                        out.append(row(*last, text, own))
                    last = None if halo else (doc, text, own)
                if out:
                    yield flush()
                    out = []

    return _in_order(df, id_col, text_col).mapInArrow(run, schema)
