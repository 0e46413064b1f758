"""Lexical retrieval packing into windows of a fixed length.

Documents are laid out so that related ones meet in a shard: by the path of their
terms, weighted and projected to a few dimensions, down a tree of centroids, and at
its leaves by a lexical signature (the least hash of their token pairs). The tree and
its weights are fitted on LAYOUT_DOCS sampled documents at most; every document
takes its path. Each shard gets a BM25
inverted index whose document frequencies come from all documents. A seed
document queries its shard's index; the best unused neighbours fill the rest of
its window greedily. A document that doesn't fit is cut, and what is left of it
seeds the next window. The last window of a task is cut into lengths that are
powers of two, which need no padding, so no window is padded at all.

Terms are the token ids: their number, and with it the table of frequencies,
is bounded by the vocabulary. Null texts are empty and have the end id alone;
repeated rows are packed each; an empty table gives no rows. A very long text is
a shard by itself, and is cut over as many windows as it fills.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import stored
from .token_files import id_counts, packed_ids, unpacked
from .tokens import rank_bpe

K1, B = 1.2, 0.75
#: Documents that the layout is fitted on, its dimensions, branches, levels, and documents of the sample at a leaf.
LAYOUT_DOCS, DIMENSIONS, BRANCHES, LEVELS, LEAF = 3000, 16, 8, 8, 20
#: Tasks at most; a task streams its shards, so there may be many in one.
TASKS = 100_000
#: A shard of the index ends at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 1024, 1 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def signature(ids: np.ndarray) -> int:
    """The least hash of adjacent ids."""
    x = ids.astype(np.uint64)
    pair = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] if len(x) > 1 else x
    pair = (pair ^ pair >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return int((pair >> np.uint64(33)).min()) if len(pair) else 0


class Layout:
    """Where documents lie: by a tree of centroids over weighted, projected term counts."""

    def __init__(self, weight: np.ndarray, seed: int = 1):
        self.random = np.random.default_rng(seed)
        self.table = self.random.standard_normal((len(weight), DIMENSIONS), np.float32) * weight[:, None].astype(np.float32)
        self.tree = None

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        x = np.stack([self.table[d].sum(0) for d in docs]) if docs else np.zeros((0, DIMENSIONS), np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def fit(self, x: np.ndarray) -> None:
        self.tree = self._node(x, 0)

    def _node(self, x: np.ndarray, level: int):
        """(centroids, children), None at a leaf: spherical means, in their order along the direction they differ most in."""
        if len(x) <= LEAF or level == LEVELS:
            return None
        c = x[self.random.choice(len(x), BRANCHES, replace=False)]
        for _ in range(8):
            of = (x @ c.T).argmax(1)
            c = np.stack([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(BRANCHES)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        c = c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0])]
        of = (x @ c.T).argmax(1)
        if len(np.unique(of)) < 2:
            return None
        return c, [self._node(x[of == j], level + 1) for j in range(BRANCHES)]

    def paths(self, docs: list[np.ndarray]) -> np.ndarray:
        """Numbers whose order is that of the tree's leaves."""
        out = np.zeros(len(docs), np.int64)

        def go(node, at, x, level):
            if node is None or not len(at):
                return
            of = (x @ node[0].T).argmax(1)
            out[at] += of * BRANCHES ** (LEVELS - 1 - level)
            for j, child in enumerate(node[1]):
                go(child, at[of == j], x[of == j], level + 1)

        go(self.tree, np.arange(len(docs)), self.vectors(docs), 0)
        return out

    def places(self, docs: list[np.ndarray]) -> pa.Array:
        """Paths, then signatures."""
        return pa.array((self.paths(docs) << 31) + np.array([signature(x) for x in docs], np.int64))


def fit_layout(df: DataFrame, make, size: int, id_col: str, text_col: str) -> Layout:
    """The layout of a sample. Only frequencies and DIMENSIONS numbers a sampled document come to the driver."""
    n = df.count()
    some = df.sample(min(1.0, 1.5 * LAYOUT_DOCS / n), 1).limit(LAYOUT_DOCS) if n > LAYOUT_DOCS else df
    ids = stored(packed_ids(some, make, id_col, text_col), "pack-layout")
    m, freq = ids.count(), id_counts(ids, size, documents=True)
    layout = Layout(np.log(1 + (m - freq + 0.5) / (freq + 0.5)))

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            x = layout.vectors([unpacked(b.as_py(), z) for b in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], ["x"])

    found = ids.select("ids").mapInArrow(run, "x array<float>").toArrow().column(0).to_pylist()
    layout.fit(np.array(sorted(found), np.float32).reshape(-1, DIMENSIONS))
    return layout


class Index:
    """BM25 over the documents of a shard. Postings of terms that many of them have are rows of a dense matrix, so that all documents' scores for them are one product; those of the others are lists."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owner, weight, self.terms = [], [], [], []
        for k, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            terms.append(t)
            owner.append(np.full(len(t), k, np.int32))
            weight.append((idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))
        t, o, w = np.concatenate(terms), np.concatenate(owner), np.concatenate(weight)
        self.size = len(docs)
        df = np.bincount(t, minlength=len(idf))
        common = np.flatnonzero(df > max(8, self.size // 16))
        row = np.full(len(idf), -1, np.int32)
        row[common] = np.arange(len(common), dtype=np.int32)
        dense = row[t] >= 0
        table = np.zeros((len(common), self.size), np.float32)
        table[row[t[dense]], o[dense]] = w[dense]
        self.dense = (table > 0).astype(np.float32).T @ table  # by query document, then by scored document
        t, o, w = t[~dense], o[~dense], w[~dense]
        order = np.argsort(t, kind="stable")
        self.owner, self.weight = o[order], w[order]
        self.ends = np.r_[0, np.cumsum(np.bincount(t, minlength=len(idf)))]
        self.terms = [x[row[x] < 0] for x in terms]

    def scores(self, k: int) -> np.ndarray:
        t = self.terms[k]
        low, n = self.ends[t], self.ends[t + 1] - self.ends[t]
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(t) else np.zeros(0, np.int64)
        return self.dense[k] + np.bincount(self.owner[at], self.weight[at], self.size)


class Windows:
    """Windows being filled; pieces are (key, start, length, sequence, offset)."""

    def __init__(self, length: int):
        self.length, self.used, self.sequence, self.open, self.done = length, 0, 0, [], []

    def add(self, key: int, n: int) -> None:
        at = 0
        while at < n:
            m = min(n - at, self.length - self.used)
            self.open.append((key, at, m))
            at, self.used = at + m, self.used + m
            if self.used == self.length:
                self.close()

    def close(self) -> None:
        offset = 0
        for key, at, m in self.open:
            self.done.append((key, at, m, self.sequence, offset))
            offset += m
        self.sequence, self.used, self.open = self.sequence + bool(self.open), 0, []

    def finish(self) -> None:
        """Cut the open window into powers of two."""
        pieces, total = self.open[::-1], self.used
        for bit in reversed(range(total.bit_length())):
            room = total & 1 << bit
            self.open = []
            while room:
                key, at, m = pieces.pop()
                take = min(m, room)
                self.open.append((key, at, take))
                room -= take
                if take < m:
                    pieces.append((key, at + take, m - take))
            self.close()


def fill(docs: list[np.ndarray], index: Index, windows: Windows, base: int) -> None:
    """Place every document of a shard."""
    unused = np.ones(len(docs), bool)
    for first in range(len(docs)):
        seed = first
        while seed is not None and unused[seed]:
            unused[seed] = False
            windows.add(base + seed, len(docs[seed]))
            nxt = None
            if windows.used:  # what is left of the seed stands in an open window: retrieve its neighbours
                score = index.scores(seed)
                score[~unused] = -1.0
                for k in np.argsort(-score, kind="stable").tolist():
                    if score[k] < 0:
                        break
                    if len(docs[k]) >= windows.length - windows.used:
                        nxt = k  # it fills the window, and seeds the next with its rest
                        break
                    unused[k] = False
                    windows.add(base + k, len(docs[k]))
            seed = nxt


def pack_documents(df: DataFrame, vocab: str, window: int = 2048, end_id: int = 1, task_ids: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start and length in its document's ids, the ids (little-endian unsigned 32-bit), doc_tokens, and where the piece lies: sequence_id, offset."""
    end = np.uint32(end_id).tobytes()

    def make():
        bpe = rank_bpe(vocab)
        return lambda t: bpe.encode(t) + end

    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(vocab).get_vocab_size(with_added_tokens=True), end_id + 1)
    shared = df.sparkSession.sparkContext.broadcast(fit_layout(df, make, size, id_col, text_col))  # DIMENSIONS numbers an id of the vocabulary
    encoded = stored(packed_ids(df, make, id_col, text_col, "sig bigint", lambda small: shared.value.places(small)), "pack-ids")
    n_docs, total = encoded.selectExpr("count(*)", "coalesce(sum(n), 0)").first()
    freq = id_counts(encoded, size, documents=True)
    idf = np.log(1 + (n_docs - freq + 0.5) / (freq + 0.5))
    mean = total / max(1, n_docs)

    def run(batches):
        z, windows, held = zstandard.ZstdDecompressor(), Windows(window), {}
        part = TaskContext.get().partitionId() << 40
        docs: list[np.ndarray] = []
        keys: list = []
        count = 0

        def out():
            rows, windows.done = windows.done, []
            for k in range(0, len(rows), 4000):
                r = rows[k : k + 4000]
                of = [held[x[0]] for x in r]
                blobs = [d[1][x[1] : x[1] + x[2]].tobytes() for x, d in zip(r, of)]
                cols = [[d[0] for d in of], [x[1] for x in r], [x[2] for x in r], blobs, [len(d[1]) for d in of], [part + x[3] for x in r], [x[4] for x in r]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            still = {x[0] for x in windows.open}
            for k in [k for k in held if k not in still]:
                del held[k]

        def shard():
            nonlocal docs, keys, count
            for i, (d, x) in enumerate(zip(keys, docs)):
                held[count + i] = (d, x)
            fill(docs, Index(docs, idf, mean), windows, count)
            count += len(docs)
            docs, keys = [], []
            yield from out()

        ids = 0
        for batch in batches:
            for d, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = unpacked(blob.as_py(), z)
                docs.append(x)
                keys.append(d)
                ids += len(x)
                if len(docs) >= SHARD_DOCS or ids >= SHARD_IDS:
                    yield from shard()
                    ids = 0
        if docs:
            yield from shard()
        windows.finish()
        yield from out()

    parts = min(TASKS, max(1, -(-int(total) // task_ids)))
    return encoded.repartitionByRange(parts, "sig", "doc_id").sortWithinPartitions("sig", "doc_id", "ids").select("doc_id", "ids").mapInArrow(run, SCHEMA)
