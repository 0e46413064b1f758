"""Substring deduplication by seeds and window hashes.

Seeds: winnowing keeps the least of every run of adjacent k-word hashes, so that
two texts that share ``window`` consecutive words share a seed inside them.
Texts of equal words are one class; those beyond its least doc_id repeat it whole,
and a task searches one of them at most unless a lesser doc_id comes later. Seeds are joined across documents; one that occurs in no
two documents is dropped.

Windows: shared seeds only prefilter. Every window of ``window`` words whose seed
is shared is hashed, windows are grouped by hash instead of extending pairs of
documents, whose number grows with the square of a passage's holders, and a window
is a repeat where an equal one starts in a document with a smaller doc_id. Repeats that touch
make one maximal repeat, a span over the length threshold.

Keys that hold many rows (found on a sample, which only steers the plan) take a
path of their own: they are aggregated before the shuffle and looked up, at most
HOT_KEYS of them, so a key that isn't holds less than one in HOT_KEYS of all rows.

A null text has no words, and neither has an empty one. A null doc_id counts as
the least. Rows that repeat a doc_id are documents neither of which is the smaller.
An empty table gives no rows. Texts of any length are taken whole, a slice of bytes
or one text at a time. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import slices, stored, two
from .words import WORD, grams, shared_words

LEAST = -(1 << 63)
#: Words of a seed.
SEED = 4
#: Keys handled as hot at most, the part of all documents in the sample, and the rows of it that make one hot.
HOT_KEYS, SHARE, HOT_ROWS = 5_000, 64, 60


def seeds(w: np.ndarray, window: int, k: int = SEED) -> np.ndarray:
    """The seed of each window of a text's word hashes: the least hash of k words in it. None in a text under the window."""
    h = grams(w, k)
    wide = window - k + 1
    if len(h) < wide:
        return np.zeros(0, np.uint64)
    low = h[: len(h) - wide + 1].copy()
    for j in range(1, wide):
        np.minimum(low, h[j : len(h) - wide + 1 + j], out=low)
    return low


def _text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[np.minimum(starts + window, n)] -= 1  # starts are distinct; their ends too
    return np.cumsum(edge[:-1]) > 0


def _least(rows: DataFrame, key: str) -> DataFrame:
    """Rows (d, t, key, ...) whose key occurs with two values of d, with the least of them as ``low``. Hot keys don't go through the window: their least values are aggregated before the shuffle and looked up."""
    sample = rows.where(F.pmod(F.xxhash64("d"), F.lit(SHARE)) == 0).groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") >= HOT_ROWS)
    hot = sample.orderBy(F.desc("c")).limit(HOT_KEYS).select(key).toArrow().column(0).to_pylist()
    by = Window.partitionBy(key)
    is_hot = F.expr(f"{key} IN ({', '.join(f'{k}L' if k > -(1 << 63) else 'CAST(-9223372036854775808 AS BIGINT)' for k in hot)})") if hot else F.lit(False)  # a set of literals, not a join
    rest = rows.where(~is_hot)
    out = rest.withColumn("low", F.min("d").over(by)).withColumn("high", F.max("d").over(by)).where("low < high").drop("high").select(*rows.columns, "low")
    if not hot:
        return out
    own = rows.where(is_hot)
    least = own.groupBy(key).agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select(key, "low").orderBy(key).toArrow()  # HOT_KEYS rows at most
    keys, lows = (least.column(i).to_numpy() for i in range(2))
    names = rows.columns
    at = names.index(key)

    def look_up(batches):
        for batch in batches:
            k = batch.column(at).to_numpy()
            i = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            known = keys[i] == k if len(keys) else np.zeros(len(k), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows[i] if len(keys) else k)], [*names, "low"]).filter(pa.array(known))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", low bigint"
    return out.unionByName(own.select(*names).mapInArrow(look_up, schema))


def repeats(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): what is left of each row, its words joined by blanks, and the maximal repeats as (first word, end) before removal."""
    texts = two(df, id_col, text_col)

    def profile(batches):
        words = shared_words()
        least: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1):
                ids, own_text, dig, n, found = [], [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    i, t = LEAST if i is None else i, (t or "").encode("utf-8", "surrogatepass")
                    w = words.of(t)
                    g = xxhash.xxh3_128_digest(w.tobytes())
                    own = np.zeros(0, np.int64)
                    if len(w) >= window and least.get(g, i + 1) > i:  # a copy of a smaller doc_id in this task is known to repeat it
                        if len(least) > 500_000:
                            least.clear()
                        least[g] = i
                        own = np.unique(seeds(w, window)).view(np.int64)
                    ids.append(i)
                    own_text.append(_text_key(t))
                    dig.append(g)
                    n.append(len(w))
                    found.append(own)
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own_text, pa.int64()), pa.array(dig, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], ["d", "t", "g", "n", "seeds"])

    docs = stored(texts.mapInArrow(profile, "d bigint, t bigint, g binary, n bigint, seeds array<bigint>"), "substring-profiles")
    # Rows that repeat a doc_id with another text stay apart by (d, t).
    classes = docs.where(F.col("n") >= window).groupBy("g").agg(F.min("d").alias("rep"))
    shared = _least(docs.select("d", "t", F.explode("seeds").alias("s")), "s").groupBy("d", "t").agg(F.collect_set("s").alias("shared"))

    def compress(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_text_key(t) for t in raw], pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([z.compress(t) for t in raw], pa.binary())], ["doc_id", "t", "size", "z"])

    small = texts.mapInArrow(compress, "doc_id bigint, t bigint, size bigint, z binary").withColumn("d", F.coalesce("doc_id", F.lit(LEAST)))

    def extend(batches):
        words, z = shared_words(), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 4, 2 << 20):
                ds, ts, hs, at = [], [], [], []
                for d, t, blob, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                    w = words.of(z.decompress(blob.as_py()))
                    s = seeds(w, window)
                    if not len(s):
                        continue
                    begin = np.flatnonzero(np.isin(s.view(np.int64), own.values.to_numpy()))
                    ds.append(np.full(len(begin), d, np.int64))
                    ts.append(np.full(len(begin), t, np.int64))
                    hs.append(grams(w, window)[begin].view(np.int64))
                    at.append(begin.astype(np.int32))
                if ds:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ds, ts, hs, at)], ["d", "t", "w", "at"])

    windows = small.join(shared, ["d", "t"]).select("d", "t", "z", "shared", "size").mapInArrow(extend, "d bigint, t bigint, w bigint, at int")
    windows = stored(windows, "substring-windows")
    starts = _least(windows, "w").where("d > low").groupBy("d", "t").agg(F.collect_set("at").alias("starts"))
    copies = docs.where(F.col("n") >= window).join(classes, "g").where("d > rep").select("d", "t").distinct().withColumn("copy", F.lit(True))

    def remove(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 4):
                out, n, gone, spans = [], [], [], []
                for blob, own, whole in zip(part.column(1), part.column(2), part.column(3).to_pylist()):
                    found = WORD.findall(z.decompress(blob.as_py()))
                    n.append(len(found))
                    drop = np.zeros(len(found), bool)
                    if whole and len(found) >= window:
                        drop[:] = True
                    elif own.is_valid:
                        at = own.values.to_numpy()
                        drop = covered(at[at <= len(found) - window].astype(np.int64), len(found), window)
                    edge = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
                    spans.append(edge.tolist())
                    gone.append(int(drop.sum()))
                    out.append(b" ".join([w for w, x in zip(found, drop.tolist()) if not x]).decode("utf-8", "surrogatepass"))
                cols = [part.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_words", "n_removed", "spans"])

    marked = small.join(starts, ["d", "t"], "left").join(copies, ["d", "t"], "left").select("doc_id", "z", "starts", "copy", "size")
    return marked.mapInArrow(remove, "doc_id bigint, text string, n_words bigint, n_removed bigint, spans array<int>")
