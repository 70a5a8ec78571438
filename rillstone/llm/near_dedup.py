"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Words' document frequencies, over all documents, in ``DF_BITS`` hash buckets.
   A shingle of five words weighs its count in the text times the mean inverse
   document frequency of its words, from 1 (in all documents) to 2 (in none).
2. Each text gets ``BANDS * ROWS`` improved consistent weighted samples, which
   two texts share with probability equal to their weighted Jaccard similarity;
   the samples of a band are hashed to a key.  At similarity 0.8 a pair shares
   at least one of 14 bands of 3 with probability over 0.9999.
3. Equal texts are one node.  Nodes that share a key are compared by all their
   samples: those with fewer than ``LEAST_SHARED`` in common aren't similar (a pair
   of similarity 0.8 falls below that with probability 3e-6), and of the others a
   maximum spanning forest is proposed first.  Keys of more than ``GROUP`` nodes
   are dealt to blocks for that, and their nodes are proposed with the least.
4. Proposed links are verified by the exact weighted Jaccard similarity, each
   node's best first, then those that would still join components.
5. In keys that still hold several components, all other pairs with enough
   samples in common that would join two components are verified, in tasks of
   pairs of blocks, so that no link of a key is lost.  Components of links are
   classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Scratch
from . import kernels as K
from .components import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 14, 3
DF_BITS, IDF_SCALE = 20, 1024
TABLE_BITS, SEED = 15, 5
#: Fewest shared samples of a proposed pair, and most nodes of a key that one task compares.
LEAST_SHARED, GROUP = 22, 2000
#: Most bytes of items (12 a shingle) in a block of a key's nodes.
BLOCK_BYTES = 1 << 25


def word_buckets(words: K.Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """By bucket, the scaled inverse document frequency over all documents; the driver gets at most 2**DF_BITS rows."""

    def count(batches):
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, w in K.word_blocks(batch.column(0), K.SPACE):
                pairs = np.unique((w.rows() << DF_BITS) | word_buckets(w))
                total += np.bincount(pairs & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([n, *total[at].tolist()], pa.int64())})

    got = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = np.asarray(got.column("bucket")), np.asarray(got.column("n"))
    df = np.zeros(1 << DF_BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    docs_n = max(1, int(n[bucket < 0].sum()))
    return np.round(IDF_SCALE * (1 + np.log((1 + docs_n) / (1 + np.minimum(df, docs_n))) / np.log(1 + docs_n))).astype(np.int64)


def shingles(w: K.Words, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row: (hash, weight, first shingle of each row and the end); a text of fewer words is one shingle."""
    lengths = np.diff(w.first)
    sums = np.zeros(len(w.hashes) + 1, np.int64)
    np.cumsum(idf[word_buckets(w)], out=sums[1:])
    rows = w.rows()
    hashes, at, sizes = [], [], []
    for s in (size, *[x for x in range(1, size) if (lengths == x).any()]):
        h, first = K.window_hashes(w, s)
        if s < size:
            whole = lengths[rows[first]] == s
            h, first = h[whole], first[whole]
        hashes.append(h)
        at.append(first)
        sizes.append(np.full(len(h), s))
    h, first, sizes = np.concatenate(hashes), np.concatenate(at), np.concatenate(sizes)
    weight = (sums[first + sizes] - sums[first]) / (sizes * IDF_SCALE)
    doc = rows[first]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16) if len(lengths) < 1 << 16 else doc[order], kind="stable")]
    h, doc, weight = h[order], doc[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(h)))
    return h[starts], (weight[starts] * times).astype(np.float32), np.searchsorted(doc[starts], np.arange(len(lengths) + 1))


class Sampler:
    """Improved consistent weighted sampling; the random numbers of a shingle come from a table by bits of its hash."""

    def __init__(self, n: int):
        rng = np.random.default_rng(SEED)
        size = 1 << TABLE_BITS
        self.odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.one_by_r = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size, dtype=np.float32)

    def samples(self, h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(rows with shingles, n) sample identities."""
        some = np.flatnonzero(np.diff(first))
        starts, log_w = first[some], np.log(weight)
        out = np.zeros((len(some), len(self.odd)), np.uint64)
        if not len(some):
            return out
        lengths = np.diff(first)[some]
        for k, odd in enumerate(self.odd):
            at = ((h * odd) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            beta = self.beta[at]
            t = log_w * self.one_by_r[at]
            t += beta
            np.floor(t, out=t)
            a = t - beta
            a += 1
            a *= self.r[at]
            np.subtract(self.log_c[at], a, out=a)
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == np.repeat(least, lengths))
            pick = hits[np.searchsorted(hits, starts)]
            out[:, k] = K.mix(h[pick] + t[pick].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out

    def keys(self, s: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """(texts, bands) keys of samples; the same samples in another band give another key."""
        out = np.zeros((len(s), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(s), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
            out[:, b] = key
        return out


def low_bytes(samples: np.ndarray) -> np.ndarray:
    """(samples, texts): the last byte of each sample, which makes counting cheap; it can only count too many as shared."""
    return np.ascontiguousarray(samples.T.astype(np.uint8))


def forest(samples: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Edges (i, j, shared samples) of a maximum spanning forest over pairs that share ``least`` samples or more (Prim's algorithm)."""
    n = len(samples)
    best, came, out = np.full(n, -1), np.zeros(n, np.int64), []
    todo = np.ones(n, bool)
    at, low = 0, low_bytes(samples)
    for _ in range(n - 1):
        todo[at] = False
        shared = (low == low[:, at, None]).sum(axis=0, dtype=np.uint8).astype(np.int64)
        closer = todo & (shared > best)
        best[closer], came[closer] = shared[closer], at
        at = int(np.where(todo, best, -2).argmax())
        if best[at] >= least:
            out.append((at, int(came[at]), int(best[at])))
    return out


def proposals(batches, least: int):
    """Proposed links of a partition sorted by key: (a, b, shared) from the nodes of each key; holds one key's nodes at a time."""

    def links(key, node, samples):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(key))
        two = starts[ends - starts == 2]
        shared = (samples[two] == samples[two + 1]).sum(axis=1)
        good = shared >= least
        a, b, n = node[two[good]], node[two[good] + 1], shared[good]
        more = [(node[i + x], node[i + y], c) for i, j in zip(starts, ends) if j - i > 2 for x, y, c in forest(samples[i:j], least)]
        if more:
            a, b, n = np.append(a, [x for x, *_ in more]), np.append(b, [x for _, x, _ in more]), np.append(n, [x for *_, x in more])
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pa.record_batch({"a": pa.array(high, pa.int64()), "b": pa.array(low, pa.int64()), "shared": pa.array(n.astype(np.int32), pa.int32())})

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
        samples = np.frombuffer(b"".join(batch.column("samples").to_pylist()), np.uint32).reshape(len(key), -1)
        if held is not None:
            key, node, samples = np.append(held[0], key), np.append(held[1], node), np.concatenate((held[2], samples))
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on in the next batch
        held = key[cut:], node[cut:], samples[cut:]
        if cut:
            yield links(key[:cut], node[:cut], samples[:cut])
    if held is not None:
        yield links(*held)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (hashes ascending)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    every = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / every if every else 0.0


def runs(batches):
    """The rows of each task of a partition sorted by (key, i, j), as a dictionary of arrays; holds one task's rows at a time."""
    held: list[pa.RecordBatch] = []

    def task():
        t = pa.Table.from_batches(held)
        out = {x: np.asarray(t.column(x)) for x in ("key", "i", "j", "band", "node", "comp", "asks")}
        out["samples"] = np.frombuffer(b"".join(t.column("samples").to_pylist()), np.uint32).reshape(t.num_rows, -1)
        return out | ({"items": t.column("items").to_pylist()} if "items" in t.column_names else {})

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(x)).astype(np.int64) for x in ("key", "i", "j")])
        starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            if held and last != tuple(ids[:, a]):
                yield task()
                held.clear()
            held.append(batch.slice(a, b - a))
            last = tuple(ids[:, a])
    if held:
        yield task()


def candidates(task: dict, rows: int, least: int):
    """(x, others) of each asking row: rows of other components that share ``least`` samples or more with it, most first.

    Asking rows meet the rows that don't ask and, in tasks of block 0, each other.
    A pair that shares several keys is met in that of the first band only.
    ``task["comp"]`` may change between two rows.
    """
    samples, comp, band, low = task["samples"], task["comp"], task["band"][0], low_bytes(task["samples"])
    asks = np.flatnonzero(task["asks"])
    meets = ~task["asks"]
    for x in asks:
        may = meets & (comp != comp[x])
        if task["i"][0] == 0:
            meets[x] = True  # for those that ask later
        others = np.flatnonzero(may & ((low == low[:, x, None]).sum(axis=0, dtype=np.uint8) >= least))
        if not len(others):
            continue
        same = samples[others] == samples[x]
        shared = same.sum(axis=1)
        good = np.flatnonzero((shared >= least) & (same.reshape(len(others), -1, rows).all(axis=2).argmax(axis=1) == band))
        if len(good):
            yield x, others[good[np.argsort(-shared[good], kind="stable")]]


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, np.uint64, len(x) // 12), np.frombuffer(x, np.float32, len(x) // 12, len(x) // 12 * 8)


def joining(task: dict, rows: int, least: int, threshold: float) -> list[tuple[int, int]]:
    """Similar pairs of nodes of a task that join components, until no candidates are left that would."""
    sets, comp, node = [unpack(x) for x in task["items"]], task["comp"].copy(), task["node"]
    _, ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    ids = np.split(ids, np.cumsum([len(h) for h, _ in sets])[:-1])
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    dense, out = np.zeros(1 + max(int(x.max()) for x in ids), np.float32), []
    for x, todo in candidates(task | {"comp": comp}, rows, least):
        dense[ids[x]] = sets[x][1]
        size = 16
        while len(todo):
            part, todo = todo[:size], todo[size:]
            least_weights = np.minimum(dense[np.concatenate([ids[y] for y in part])], np.concatenate([sets[y][1] for y in part]))
            both = np.add.reduceat(least_weights.astype(np.float64), np.append(0, np.cumsum([len(ids[y]) for y in part])[:-1]))
            like = both / (total[x] + total[part] - both)
            for y in part[like >= threshold - 1e-9]:
                if comp[x] != comp[y] and similarity(sets[x], sets[y]) >= threshold:
                    out.append((max(node[x], node[y]), min(node[x], node[y])))
                    comp[comp == comp[y]] = comp[x]
            todo = todo[comp[todo] != comp[x]]
            size *= 4
        dense[ids[x]] = 0
    return out


def text_hashes(text_col: str) -> tuple[Column, Column]:
    """The two hashes that tell a text."""
    return F.xxhash64(text_col), F.xxhash64(F.lit(SEED), text_col)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id_col, node (hash of the text) and class_id, the least id of its class.

    Classes are the connected components of equal texts and of texts whose
    weighted Jaccard similarity is ``threshold`` or more.  Words are maximal runs
    of characters other than space and U+0009 to U+000D, unchanged.

    Texts of fewer than five words are one shingle; texts without words are only
    duplicates of equal texts.  Null texts take no part: such a row is a class of
    its own, with its id (which may be null) as class_id; so are rows without an
    id.  Repeated rows are in one class; equal ids with different texts are told
    apart by node.  Other columns take no part; an empty table gives an empty one.
    """
    K.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    least_shared = LEAST_SHARED * bands * rows // (BANDS * ROWS)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    h, g = text_hashes("text")
    part = docs.where("id IS NOT NULL AND text IS NOT NULL").withColumns({"h": h, "g": g})
    kind = docs.schema["id"].dataType.simpleString()
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, "text"))
    sampler = spark.sparkContext.broadcast(Sampler(bands * rows))

    def sign(batches):
        for batch in batches:
            column = batch.column("text")
            keys: list = []
            drawn: list = []
            for _, _, w in K.word_blocks(column, K.SPACE):
                h, weight, first = shingles(w, idf.value, shingle)
                samples = sampler.value.samples(h, weight, first)
                own = iter(zip(sampler.value.keys(samples, bands, rows).view(np.int64), samples.astype(np.uint32)))
                for n in np.diff(first):
                    k, x = next(own) if n else (None, None)
                    keys.append(k)
                    drawn.append(None if x is None else x.tobytes())
            yield pa.record_batch({x: batch.column(x) for x in ("id", "h", "g")} | {"keys": pa.array(keys, pa.list_(pa.int64())), "samples": pa.array(drawn, pa.binary())})

    # a text is told by two hashes; a node's number is the first, unless different texts share that
    signed = part.mapInArrow(sign, f"id {kind}, h long, g long, keys array<bigint>, samples binary")
    told = scratch.keep(signed.groupBy("h", "g").agg(F.min("id").alias("least"), F.first("keys").alias("keys"), F.first("samples").alias("samples")))
    twins = told.groupBy("h").agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    nodes = told.withColumn("node", F.col("h"))
    if not twins.isEmpty():
        nodes = scratch.keep(told.join(twins, "h", "left").withColumn("node", F.expr("if(g <> first, xxhash64(g, h), h)")).drop("first"))
    held = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    of_key = [F.min("node").alias("low"), F.max("node").alias("high"), F.count("node").alias("n")]
    members = scratch.keep(held.join(held.groupBy("key").agg(*of_key).where("low <> high"), "key"))

    def weigh(batches):
        for batch in batches:
            blobs = []
            for _, _, w in K.word_blocks(batch.column("text"), K.SPACE):
                h, weight, first = shingles(w, idf.value, shingle)
                blobs += [h[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch({"node": batch.column("node"), "items": pa.array(blobs, pa.binary())})

    def compare(batches):
        for batch in batches:
            like = [similarity(unpack(x.as_py()), unpack(y.as_py())) for x, y in zip(batch.column("items_a"), batch.column("items_b"))]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "like": pa.array(like, pa.float64())})

    involved = members.select("node").distinct().join(nodes.select("node", "h", "g", F.col("least").alias("id")), "node")
    # a node's text comes from the row with the least id; repeats of that row give the same items.  A task's rows of the
    # hashed side are without text, so far smaller than what streams past them, which needn't be sorted
    texts = part.join(involved.hint("shuffle_hash"), ["h", "g", "id"]).select("node", "text")
    items = scratch.keep(texts.mapInArrow(weigh, "node long, items binary").groupBy("node").agg(F.first("items").alias("items")))

    def verify(pairs: DataFrame) -> DataFrame:
        """Of (a, b), those that are similar enough."""
        one = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        two = one.join(items.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        return two.select("a", "b", "items_a", "items_b").mapInArrow(compare, "a long, b long, like double").where(F.col("like") >= threshold).select("a", "b")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Of (a, b, ...), those whose ends are in different components."""
        of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
        joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return joined.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).drop("comp_a", "comp_b")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    task = ["key", "i", "j"]

    def dealt(rows_of: DataFrame):
        return rows_of.repartition(parts, *task).sortWithinPartitions(*task, "node")

    def remaining(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) between the components of each key, from all of its pairs that share enough samples.

        The nodes of a key's most frequent component are dealt to blocks 0 to p - 1,
        the others to blocks p to p + q - 1, each of about ``GROUP`` nodes and
        ``BLOCK_BYTES`` of items at most.  Task (i, j), i < j, p <= j, compares block j
        with block i, and block j with itself if i is 0: all pairs but those within
        one component.
        """
        size = items.select("node", F.length("items").cast("long").alias("size"))
        of = members.where("n > 2").select("key", "band", "node").join(labels, "node", "left").join(size, "node")
        of = scratch.keep(of.withColumn("comp", F.coalesce("comp", "node")))
        by_comp = of.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        totals = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "comp")).alias("main"), F.count("*").alias("comps")]
        blocks = lambda n, size: F.ceil(F.greatest((n) / F.lit(GROUP), (size) / F.lit(BLOCK_BYTES))).cast("int")
        keys = by_comp.groupBy("key").agg(*totals).where("comps > 1")
        keys = keys.select("key", F.col("main.comp").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("p"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("q"))
        in_block = of.join(keys, "key").withColumn("at", F.xxhash64("node", F.lit(SEED)))
        in_block = in_block.withColumn("b", F.expr("int(if(comp = main, pmod(at, p), p + pmod(at, q)))"))
        asking = "if(b >= p, transform(sequence(0, b - 1), x -> struct(x AS i, b AS j, true AS asks)), array())"
        given = "if(greatest(b + 1, p) < p + q, transform(sequence(greatest(b + 1, p), p + q - 1), x -> struct(b AS i, x AS j, false AS asks)), array())"
        rows_of = in_block.select("key", "band", "node", "comp", F.explode(F.expr(f"concat({asking}, {given})")).alias("t")).select("key", "band", "node", "comp", "t.*")

        def unsettled(batches):
            for t in runs(batches):
                some = np.zeros(len(t["node"]), bool)
                for x, others in candidates(t, rows, least_shared):
                    some[x] = some[others] = True
                if some.any():
                    yield pa.record_batch({x: pa.array(t[x][some]) for x in ("key", "i", "j", "band", "node", "comp", "asks")})

        def link(batches):
            for t in runs(batches):
                got = joining(t, rows, least_shared, threshold)
                yield pa.record_batch({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

        drawn = nodes.select("node", "samples")
        some = dealt(rows_of.join(drawn, "node")).select(*task, "band", "node", "comp", "asks", "samples").mapInArrow(unsettled, "key long, i int, j int, band int, node long, comp long, asks boolean")
        return dealt(some.join(drawn, "node").join(items, "node")).mapInArrow(link, "a long, b long").distinct()

    labels = spark.createDataFrame([], "node long, comp long")
    if not members.isEmpty():
        # a key of more nodes is dealt to blocks for its first forests, and each of its nodes is proposed with the least of them
        block = F.expr(f"if(n > {GROUP}, xxhash64(key, pmod(xxhash64(node, {SEED}), ceil(n / {GROUP}))), key)")
        near = members.select(block.alias("key"), "node").join(nodes.select("node", "samples"), "node").repartition(parts, "key").sortWithinPartitions("key", "node")
        found = near.select("key", "node", "samples").mapInArrow(lambda batches: proposals(batches, least_shared), "a long, b long, shared int")
        star = members.where((F.col("n") > GROUP) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b"), F.lit(0).alias("shared"))
        found = found.union(star).groupBy("a", "b").agg(F.max("shared").alias("shared"))
        pairs = scratch.keep(found)
        best = scratch.keep(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")))
        labels = components(verify(best), scratch)
        rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
        for more in (lambda: verify(apart(rest, labels)), lambda: remaining(members, labels)):
            new = scratch.keep(more())
            if not new.isEmpty():  # what is linked already stands in as stars
                labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(new), scratch)
        scratch.drop(pairs, best)

    # nodes without links are their own class; only linked ones are grouped
    classes = scratch.keep(nodes.select("h", "g", "node", "least").join(labels, "node", "left"))
    linked = classes.where("comp IS NOT NULL")
    least = linked.groupBy("comp").agg(F.min("least").alias("class_id"))
    alone = classes.where("comp IS NULL").select("h", "g", "node", F.col("least").alias("class_id"))
    of_node = linked.join(least, "comp").select("h", "g", "node", "class_id").union(alone)
    scratch.drop(items, told)
    out = part.select("id", "h", "g").join(of_node, ["h", "g"]).select("id", "node", "class_id")
    alone = docs.where("id IS NULL OR text IS NULL").select("id", F.lit(None).cast("long").alias("node"), F.col("id").alias("class_id"))
    return out.union(alone).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each class of near duplicates: the one with the least id.

    Rows that take no part (null id or text) stay.  If the least id stands on
    several rows of a class, one of the least text hash stays.
    """
    names = docs.columns
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    scratch = Scratch(docs.sparkSession)
    first = scratch.keep(classes.where(F.col("node").isNotNull() & (F.col(id_col) == F.col("class_id"))).groupBy(F.col("class_id").alias("__id")).agg(F.min("node").alias("__node"), F.count("*").alias("__n")))
    # rows of the hashed side have no text
    kept = docs.join(first.hint("shuffle_hash"), F.col(id_col) == F.col("__id"))
    h, g = text_hashes(text_col)
    kept = kept.where(F.col("__node").isin(h, F.xxhash64(g, h)))
    out = kept.where("__n = 1").select(*names).union(docs.where(F.col(id_col).isNull() | F.col(text_col).isNull()))
    if not first.where("__n > 1").isEmpty():
        out = out.union(kept.where("__n > 1").dropDuplicates(["__id"]).select(*names))
    return out
