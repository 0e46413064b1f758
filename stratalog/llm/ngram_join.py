"""N-gram Jaccard self-join and its components.

1. Every text becomes its set of word n-grams. Texts with equal sets are one
   class, so copies cost one row each and are never paired.
2. N-grams are ordered rare first by a document-frequency sketch of all texts,
   of a fixed size; any order is right, a better one joins fewer rows. Two sets
   over the threshold share an n-gram in their prefixes.
3. The prefixes are joined on their n-grams, and postings of equal members are
   taken once. In each, the length filter and a suffix filter over fixed bins of
   the n-grams say which sets may link; what hangs together by them is linked to
   one of its members, so a posting gives fewer rows than it has. Postings over
   a fixed size never lie in one task: hot n-grams are dealt by their members
   too, and their members are linked by ranges of lengths alone. The components
   of these candidate links hold every true link.
4. Each candidate component is joined exactly: rare-first prefixes within it,
   length, positional and suffix filters, and one verification a pair unless
   its sets are known to be in one component. Components over a fixed size are
   joined in the cluster instead: every set is verified against one member of each
   of its postings, in some rounds, and only pairs that these links don't connect
   are compared further, in blocks of a posting.

A null or empty text, or one without words, has an empty set and is linked with
nothing. A text of fewer words than n is one n-gram. Rows that repeat a doc_id
are rows of their own; a null doc_id is in a component without being its least.
An empty table gives no rows. Texts of any length are taken whole; one set is
held at a time beyond the rows of a slice. N-grams are 64-bit hashes, sets of a
class 128-bit ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import slices, stored, two
from .graphs import connected_components
from .words import Words, grams, shared_words

#: Buckets of the sketch, and the slices it is summed in.
BUCKETS, SLICES = 1 << 23, 64
#: A candidate component of more sets or n-grams is joined in the cluster.
GROUP_SETS, GROUP_GRAMS = 20_000, 12_000_000
#: Bins of the suffix filter within a component, and of the one over postings, which must tell long texts apart too.
BINS, POSTING_BINS = 32, 512
#: Larger postings are only cut by length, and not held by one task.
POSTING = 5_000
#: A bucket of the sketch is hot that counts so many documents and so many times the mean; its n-grams are dealt in so many parts.
HOT_DOCS, HOT_TIMES, PARTS = 2_000, 16, 4_096
#: Rounds of pivots, and members of a block, where components are joined in the cluster.
ROUNDS, BLOCK = 4, 2_000
_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))


def shingles(words: Words, text: str | None, n: int) -> np.ndarray:
    """The sorted set of a text's n-grams, A-Z lower-cased."""
    w = words.of((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(grams(w, min(n, len(w)))) if len(w) else np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    b = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(b[:8], "big", signed=True), int.from_bytes(b[8:], "big", signed=True)


def prefix_length(n: int, num: int, den: int) -> int:
    """Sets of n n-grams that overlap enough with any other share one of so many."""
    return n + (-num * n // den) + 1


def binned(s: np.ndarray, bins: int = BINS) -> np.ndarray:
    """How many n-grams of a set fall in each bin."""
    return np.bincount((s >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), minlength=bins)


def overlap_needed(a, b, num: int, den: int):
    return -(-num * (a + b) // (num + den))


def hot_level(mean: float) -> int:
    """The least level of hot buckets."""
    return max(1, math.ceil(math.log2(max(HOT_TIMES, HOT_DOCS / mean))))


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, x): x tells texts of one doc_id apart, and spreads null ones."""
    return two(df, id_col, text_col).withColumn("x", F.xxhash64("text"))


def profiles(df: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, int]:
    """(doc_id, x, n, g1, g2, sig) of all rows, the level of each bucket: the power of two by which its n-grams are more frequent than the mean, and the level from which it is hot."""

    def run(batches):
        words, counts, held, size = shared_words(), np.zeros(BUCKETS, np.uint32), [], 0

        def add(sets):
            at, n = np.unique(np.concatenate(sets) >> _SHIFT, return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.uint32)

        for batch in batches:
            for part in slices(batch, 1):
                rows, sets = [], []
                for t in part.column(1).to_pylist():
                    s = shingles(words, t, n)
                    sets.append(s)
                    rows.append((len(s), *(digest(s) if len(s) else (None, None))))
                held += sets
                size += sum(map(len, sets))
                if size > 1_000_000:
                    add(held)
                    held, size = [], 0
                k = len(rows)
                sig = pa.array([np.minimum(binned(s, POSTING_BINS), 255).astype(np.uint8).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.nulls(k, pa.int32()), sig], names)
        if size:
            add(held)
        z, own = zstandard.ZstdCompressor(level=1), counts.reshape(SLICES, -1)
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([*[none] * 5, pa.array(range(SLICES), pa.int32()), pa.array([z.compress(x.tobytes()) for x in own], pa.binary())], names)

    names = ["doc_id", "x", "n", "g1", "g2", "slice", "sig"]
    # A task's counters come as rows of their own, told apart by ``slice``.
    both = stored(hashed(df, id_col, text_col).mapInArrow(run, "doc_id bigint, x bigint, n bigint, g1 bigint, g2 bigint, slice int, sig binary"), "ngram-profiles")

    docs = both.where("slice IS NULL")
    mean = max(1.0, (docs.agg(F.sum("n")).first()[0] or 0) / BUCKETS)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(z.decompress(blob.as_py()), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + x if k in sums else x
        own = [np.floor(np.log2(np.maximum(x / mean, 1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(own, pa.binary())], ["slice", "level"])

    levels = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in both.where("slice IS NOT NULL").select("slice", "sig").repartition(SLICES // 4, "slice").mapInArrow(total, "slice int, level binary").collect():
        levels[r.slice] = np.frombuffer(r.level, np.uint8)
    return docs.select("doc_id", "x", "n", "g1", "g2", "sig"), levels.reshape(-1), hot_level(mean)


def prefixes(df: DataFrame, levels: np.ndarray, hot: int, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(h, g, n, pos, part): the prefix of each set, once a task; g is the first half of its digest, part -1 where the n-gram isn't hot."""
    shared = df.sparkSession.sparkContext.broadcast(levels.tobytes())  # BUCKETS bytes, whatever the input

    def run(batches):
        words, level, seen = shared_words(), np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                hs, gs, ns, pos, deal = [], [], [], [], []
                for t in part.column(0).to_pylist():
                    s = shingles(words, t, n)
                    if not len(s) or (key := digest(s)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    p = prefix_length(len(s), num, den)
                    of = level[(s >> _SHIFT).astype(np.int64)]
                    first = np.lexsort((s, of))[:p]
                    hs.append(s[first])
                    gs.append(np.full(p, key[0], np.int64))
                    ns.append(np.full(p, len(s), np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                    deal.append(np.where(of[first] >= hot, key[0] % PARTS, -1).astype(np.int32))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (gs, ns, pos, deal))], ["h", "g", "n", "pos", "part"])

    return two(df, id_col, text_col).select("text").mapInArrow(run, "h bigint, g bigint, n int, pos int, part int")


def shared_postings(postings: DataFrame) -> DataFrame:
    """(h, g, n, pos, key) of prefix n-grams that two sets or more have: each set once, though it comes from several tasks. The key is the same for postings of the same members, null for those over POSTING and for hot ones, which are dealt by part and may have one member."""
    by = Window.partitionBy("h", "part")
    once = F.coalesce(F.lag("g").over(by.orderBy("g")) != F.col("g"), F.lit(True))  # rows of a set come from several tasks
    p = postings.withColumn("once", once)
    key = F.bit_xor(F.when(F.col("once"), F.xxhash64("g"))).over(by)
    members = F.count_if("once").over(by)
    p = p.withColumn("key", F.when((F.col("part") < 0) & (members <= POSTING), key)).withColumn("members", members)
    return p.where("once AND (part >= 0 OR members > 1)").select("h", "g", "n", "pos", "key")


def many_links(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the members of hot and large postings, linked by ranges of lengths, of which only neighbours can link. Nothing is held by one task: the least member of each range is an aggregate, and the join with it can be split."""
    many = shared.where("key IS NULL").select("h", "g", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).alias("band"))
    least = many.groupBy("h", "band").agg(F.min("g").alias("low"))
    own = many.join(least, ["h", "band"]).where("g <> low").select(F.col("low").alias("a"), F.col("g").alias("b"))
    above = least.select("h", (F.col("band") + 1).alias("band"), F.col("low").alias("below"))
    # A range is as wide as the threshold lets lengths differ, so sets that link lie in one or in neighbours.
    return own.union(least.join(above, ["h", "band"]).select("below", "low")).distinct()


def _stars(g: np.ndarray, n: np.ndarray, sig: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A posting's members, in the order of their sizes, linked where the length and suffix filters let pairs pass: (first, member) of each group that hangs together."""
    out = []
    left = np.arange(len(g))
    while len(left):
        front, left, first = [left[0]], left[1:], int(g[left[0]])
        while front and len(left):
            i = front.pop()
            low, high = np.searchsorted(n[left], -(-num * n[i] // den)), np.searchsorted(n[left], den * n[i] // num, side="right")
            near = left[low:high]
            apart = np.abs(sig[near] - sig[i]).sum(1, dtype=np.int64)
            hit = apart <= n[near] + n[i] - 2 * overlap_needed(n[near], n[i], num, den)
            front += near[hit].tolist()
            out += [(first, int(x)) for x in g[near[hit]].tolist()]
            left = np.concatenate([left[:low], near[~hit], left[high:]])
    return out


def candidate_components(shared: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(g, comp) of the sets that share a prefix n-gram with another that the filters let pass."""
    groups = shared.where("key IS NOT NULL").select("key", "g").distinct()
    sigs = classes.select(F.col("g1").alias("g"), F.col("n").cast("int").alias("n"), "sig")
    members = groups.join(sigs, "g").select("key", "n", "g", "sig")

    def run(batches):
        key, own = None, []

        def edges():
            g, n = np.array([r[1] for r in own], np.int64), np.array([r[0] for r in own], np.int64)
            sig = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(-1, POSTING_BINS).astype(np.int16)
            return _stars(g, n, sig, num, den)

        for batch in batches:
            out = []
            for k, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(own) > 1:
                        out += edges()
                    key, own = k, []
                own.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in range(2)], ["a", "b"])
        if len(own) > 1:
            out = edges()
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in range(2)], ["a", "b"])

    links = members.repartition("key").sortWithinPartitions("key", "n", "g").mapInArrow(run, "a bigint, b bigint")
    return connected_components(links.union(many_links(shared, num, den))).select(F.col("v").alias("g"), F.col("c").alias("comp"))


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The component of each of some sets of distinct hashes: an index of one of its sets."""
    comp = np.arange(len(sets))
    if len(sets) < 2:
        return comp
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, True))
        return comp if den * both < num * (len(a) + len(b) - both) else np.zeros(2, np.int64)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    value, inverse, df = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((value, df))
    rank = np.empty(len(value), np.int64)
    rank[order] = np.arange(len(value))
    common = df[order] > 1  # by rank
    ranked = np.split(rank[inverse], np.cumsum(size)[:-1])
    bins = np.stack([binned(s) for s in sets]).astype(np.int32)
    members = {i: [i] for i in range(len(sets))}
    postings: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for i in np.argsort(size, kind="stable").tolist():
        r = np.sort(ranked[i])
        n = len(r)
        head = r[: prefix_length(n, num, den)]
        at = np.flatnonzero(common[head])
        own = [(int(head[k]), k) for k in at.tolist()]
        found, there, here = [], [], []
        for token, k in own:
            if token in postings:
                docs, places = postings[token]
                found += docs
                there += places
                here += [k] * len(docs)
        if found:
            j, first = np.unique(np.array(found), return_index=True)  # the first shared n-gram comes first
            there, here, m = np.array(there)[first], np.array(here)[first], size[j]
            need = overlap_needed(n, m, num, den)
            keep = (comp[j] != comp[i]) & (den * m >= num * n)
            keep &= 1 + np.minimum(n - here - 1, m - there - 1) >= need  # positional filter
            j, need, m = j[keep], need[keep], m[keep]
            apart = np.abs(bins[j] - bins[i]).sum(1)
            keep = apart <= n + m - 2 * need  # suffix filter: what the bins differ by isn't shared
            j, need = j[keep][np.argsort(apart[keep], kind="stable")], need[keep][np.argsort(apart[keep], kind="stable")]
            for k, least in zip(j.tolist(), need.tolist()):
                if comp[k] != comp[i] and len(np.intersect1d(ranked[k], r, True)) >= least:
                    a, b = sorted((comp[i], comp[k]), key=lambda c: len(members[c]))
                    comp[members[a]] = b
                    members[b] += members.pop(a)
        for token, k in own:
            docs, places = postings[token]
            docs.append(i)
            places.append(k)
    return comp


def _sets(df: DataFrame, members: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(comp, doc_id, g1, g2, grams) of the members (doc_id, x, comp, m1, m2), from their texts."""

    def run(batches):
        words, seen = shared_words(), set()
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for d, t, comp, m1, m2 in zip(*(c.to_pylist() for c in part.columns)):
                    if (m1, m2) in seen:  # the row is repeated
                        continue
                    s = shingles(words, t, n)
                    if len(s) and digest(s) == (m1, m2):  # another text may have the hash
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add((m1, m2))
                        rows.append((comp, d, m1, m2, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 4 else pa.int64()) for i in range(5)], ["comp", "doc_id", "g1", "g2", "grams"])

    texts = hashed(df, id_col, text_col).withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # By a merge at every size: whether members can be broadcast depends on the input.
    return texts.join(members.withColumnRenamed("doc_id", "rep").withColumn("d", F.coalesce("rep", F.lit(-(1 << 63)))).hint("merge"), ["d", "x"]).select("doc_id", "text", "comp", "m1", "m2").mapInArrow(run, "comp bigint, doc_id bigint, g1 bigint, g2 bigint, grams binary")


def _small(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(m1, m2, component): the least doc_id of each class's true component, for candidate components of a bounded size."""

    def run(batches):
        comp, own = None, {}

        def out():
            rows = list(own.items())
            label = linked([r[1][1] for r in rows], num, den).tolist()
            least: dict[int, int] = {}
            for c, (_, (d, _)) in zip(label, rows):
                if d is not None:
                    least[c] = min(d, least.get(c, d))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([least.get(c) for c in label], pa.int64())], ["m1", "m2", "component"])

        for batch in batches:
            for c, d, g1, g2, s in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if c != comp:
                    if own:
                        yield out()
                    comp, own = c, {}
                own[g1, g2] = (d, np.frombuffer(s.as_py(), np.uint64))
        if own:
            yield out()

    return sets.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, "m1 bigint, m2 bigint, component bigint")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    x, y = sets.select(F.col("g1").alias("a"), F.col("grams").alias("x")), sets.select(F.col("g1").alias("b"), F.col("grams").alias("y"))

    def verify(batches):
        for batch in batches:
            for part in slices(batch, 2):
                keep = []
                for s, t in zip(part.column(2), part.column(3)):
                    s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                    both = len(np.intersect1d(s, t, True))
                    keep.append(den * both >= num * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, g, n, pos, label) of the postings whose members the links so far don't connect."""
    p = postings.join(labels, postings.g == labels.v, "left").select("h", "g", "n", "pos", F.coalesce("c", "g").alias("label"))
    apart = p.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    return p.join(apart, "h", "left_semi")


def _blocks(p: DataFrame, bins: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of an open posting with different labels that pass the length, positional and suffix filters. A posting's members are dealt in blocks, and each pair of blocks is compared by itself."""
    size = p.groupBy("h").agg(F.count("*").alias("members"))
    k = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    dealt = p.join(size, "h").join(bins, "g").withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("g"), F.col("k")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j")))
    rows = dealt.withColumn("block", F.explode(pair)).select("h", "block.i", "block.j", "g", "n", "pos", "label", "mine", "sig")

    def run(batches):
        block, own = None, []

        def pairs():
            g, n, pos, label, mine = (np.array([r[k] for r in own], np.int64) for k in range(5))
            sig = np.frombuffer(b"".join(r[5] for r in own), np.uint8).reshape(-1, POSTING_BINS).astype(np.int16)
            out = []
            for x in range(len(own)):
                ok = (label != label[x]) & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x]))
                ok &= (mine != mine[x]) if block[1] != block[2] else True
                ok[: x + 1] = False
                y = np.flatnonzero(ok)
                need = overlap_needed(n[y], n[x], num, den)
                bound = np.minimum(pos[y], pos[x]) + np.minimum(n[y] - pos[y], n[x] - pos[x])  # positional filter: shared before it, from it on
                apart = np.abs(sig[y] - sig[x]).sum(1, dtype=np.int64)
                hit = (bound >= need) & (apart <= n[y] + n[x] - 2 * need)
                out += [(min(int(g[x]), z), max(int(g[x]), z)) for z in g[y[hit]].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            for h, i, j, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, i, j) != block:
                    if own:
                        yield pairs()
                    block, own = (h, i, j), []
                own.append(r)
        if own:
            yield pairs()

    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "g").mapInArrow(run, "a bigint, b bigint").distinct()


def _large(sets: DataFrame, postings: DataFrame, bins: DataFrame, num: int, den: int) -> DataFrame:
    """The same for larger ones.

    Each round, every set of a posting that isn't connected yet is verified against one
    member of the posting, which gives no more pairs than the posting has rows. What
    the rounds leave open, most often sets that link with nothing, is compared in
    blocks, and only pairs that pass the filters are made and verified, each once.
    """
    sets = stored(sets.dropDuplicates(["g1", "g2"]), "ngram-sets")
    p = postings.join(sets.select(F.col("g1").alias("g")).distinct(), "g", "left_semi").select("h", "g", "n", "pos")
    links, labels = None, sets.select(F.col("g1").alias("v"), F.col("g1").alias("c")).limit(0)

    def more(found: DataFrame) -> None:
        nonlocal links, labels
        links = stored(found if links is None else links.union(found), "ngram-links")
        labels = stored(connected_components(links), "ngram-labels")

    for turn in range(ROUNDS):
        left = _open(p, labels)
        pivot = left.groupBy("h").agg(F.min(F.struct(F.xxhash64("g", F.lit(turn)).alias("o"), "g", "n", "label")).alias("q"))
        tried = left.join(pivot, "h").where((F.col("label") != F.col("q.label")) & (F.least("n", "q.n") * den >= F.greatest("n", "q.n") * num))
        more(_verified(tried.select(F.col("g").alias("a"), F.col("q.g").alias("b")).distinct(), sets, num, den))
    left = stored(_open(p, labels), "ngram-open")
    if not left.isEmpty():
        more(_verified(_blocks(left, bins, num, den), sets, num, den))
    own = sets.join(labels.withColumnRenamed("v", "g1"), "g1").select("g1", "g2", "doc_id", "c")
    return own.join(own.groupBy("c").agg(F.min("doc_id").alias("component")), "c").selectExpr("g1 AS m1", "g2 AS m2", "component")


def ngram_components(df: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", group_sets: int = GROUP_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; texts link at a Jaccard similarity of num/den or more."""
    docs, levels, hot = profiles(df, n, id_col, text_col)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("rep")
    classes = docs.where("n > 0").groupBy("g1", "g2").agg(rep, F.first("n").alias("n"), F.first("sig").alias("sig")).select("g1", "g2", F.col("rep.doc_id").alias("rep"), "rep.x", "n", "sig")
    shared = stored(shared_postings(prefixes(df, levels, hot, n, num, den, id_col, text_col)), "ngram-postings")
    comps = candidate_components(shared, classes, num, den)
    members = classes.join(comps, classes.g1 == comps.g).select("rep", "x", "n", "comp", "g1", "g2")
    sizes = members.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).where((F.col("sets") > group_sets) | (F.col("grams") > GROUP_GRAMS)).withColumn("large", F.lit(True)).select("comp", "large")
    members = stored(members.join(sizes, "comp", "left").selectExpr("rep AS doc_id", "x", "comp", "g1 AS m1", "g2 AS m2", "coalesce(large, false) AS large"), "ngram-members")
    parts = _small(_sets(df, members.where("NOT large").drop("large"), n, id_col, text_col), num, den)
    if not members.where("large").isEmpty():
        bins = classes.select(F.col("g1").alias("g"), "sig")
        parts = parts.union(_large(_sets(df, members.where("large").drop("large"), n, id_col, text_col), shared, bins, num, den))
    labels = classes.join(parts, (classes.g1 == parts.m1) & (classes.g2 == parts.m2), "left").select(F.col("g1").alias("m1"), F.col("g2").alias("m2"), F.coalesce("component", "rep").alias("component"))
    return docs.join(labels, (docs.g1 == labels.m1) & (docs.g2 == labels.m2), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
