"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted in Spark.

1. Documents are dealt into *chunks*, ranges of ``id_col`` of about
   ``CHUNK_BYTES`` of text, with one shuffle.
2. Each chunk hashes every window of its documents and keeps the distinct
   hashes, sorted; they go, as packed difference planes (about six bytes a
   window), to the *bucket* of their leading bits.  A window that is frequent in
   a chunk counts once there, so no hot window makes a hot bucket.
3. A bucket holds all occurrences of its hashes, by chunk, and answers each chunk
   with one bit a window: whether another chunk has that hash too.
4. Equal hashes are only candidates.  Each chunk, met again through the same
   shuffle files, sends a 128-bit cryptographic digest of the words themselves of
   those windows to the buckets.  As chunks are ranges of ids, a window of chunk c
   starts in a document with a smaller id outside the chunk exactly if an earlier
   chunk has its words: their places go back.
5. Each chunk adds what it sees itself, by words as well, merges the repeated
   windows to maximal intervals and cuts them out.

So no window is cut because of hashes that collide; those only cost digests.

A chunk sends a row to each bucket it has windows for.  Chunks grow with the root
of the input, up to ``MOST_CHUNK_BYTES``, so that these rows stay large; they
number less than the windows at any size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .ranges import even_ranges, input_size

CHUNK_BYTES, MOST_CHUNK_BYTES, ROW_BYTES = 8 << 20, 32 << 20, 64
#: Bytes of the digest of a window's words.
DIGEST = 16
CHUNK, ADDED = "__chunk", ("n_words", "n_removed", "kept_sha256", "removed")


def by_both(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, hashes, second hashes) by hash, by second hash among equals, and as they come among equals of both."""
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_check = h[order], check[order]
    same = sorted_h[1:] == sorted_h[:-1]
    if (same & (sorted_check[1:] != sorted_check[:-1])).any():  # a true collision of 64 bits
        order = np.lexsort((check, h))
        sorted_h, sorted_check = h[order], check[order]
    return order, sorted_h, sorted_check


def runs_of(at: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a run of equals begins) by place and digest, and as they come among equals of both."""
    order = np.lexsort((digest[:, 1], digest[:, 0], at))
    rows = np.column_stack((at.astype(np.uint64), digest))[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return order, new


def rank_in(at: np.ndarray) -> np.ndarray:
    """How many equals stand before each of these ascending values."""
    return np.arange(len(at)) - np.searchsorted(at, at)


class _Chunk:
    """Windows of the documents of one chunk, in the order of their ids; rows without id take no part."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, buckets: int):
        ids = table.column(id_col)
        known = np.asarray(ids.is_valid())
        keys = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.order = np.lexsort((keys, ~known))
        self.texts = table.column(text_col).take(pa.array(self.order))
        self.known, self.keys, self.window = known[self.order], keys[self.order], window
        hashes, docs, at = [], [], []
        for i, _, w in K.word_blocks(self.texts, K.SPACE):
            h, first = K.window_hashes(w, window)
            hashes.append(h)
            docs.append(w.rows()[first] + i)
            at.append(first - w.first[docs[-1] - i])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h, d, p = cat(hashes, np.uint64), cat(docs, np.int64), cat(at, np.int64)
        use = self.known[d]
        self.d, self.p = d[use], p[use]
        order = np.argsort(h[use], kind="stable")
        sorted_h = h[use][order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        self.unique = sorted_h[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        high = (self.unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.cuts = np.searchsorted(high, np.arange(buckets + 1, dtype=np.uint64))

    def digests(self, windows: np.ndarray) -> np.ndarray:
        """(windows, 2): the digest of the words of each of these windows, which ascend."""
        out = []
        cuts = np.flatnonzero(np.diff(self.d[windows], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(windows)]):
            words = self.texts[int(self.d[windows[a]])].as_py().encode().split()
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            p, line = self.p[windows[a:b]], b" ".join(words)
            spans = zip((ends - size)[p].tolist(), ends[p + self.window - 1].tolist())
            out.append(b"".join(hashlib.blake2b(line[x:y], digest_size=DIGEST).digest() for x, y in spans))
        return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)

    def proofs(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``unique``, ascending, and digest) of the different windows there that are marked."""
        some = np.flatnonzero(shared[self.which])
        at, digest = self.which[some], self.digests(some)
        order, new = runs_of(at, digest)
        return at[order[new]], digest[order[new]]

    def repeated(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The windows whose words a document with a smaller id has, in this chunk or in an earlier one.

        Earlier chunks have, of the different windows with the hash at ``at``, the one that is ``rank``-th by digest.
        """
        several = np.bincount(self.which, minlength=len(self.unique)) > 1
        seen = np.zeros(len(self.unique), bool)
        seen[at] = True
        out = (seen & ~several)[self.which]
        some = np.flatnonzero(several[self.which])
        order, new = runs_of(self.which[some], self.digests(some))
        own, run = self.which[some[order[new]]], np.cumsum(new) - 1
        earlier = np.isin(own << 32 | rank_in(own), at << 32 | rank)
        keys = self.keys[self.d[some[order]]]  # documents ascend, so the first of equals has the smallest id
        out[some[order]] = earlier[run] | (keys > keys[new][run])
        return np.flatnonzero(out)

    def intervals(self, hit: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By document (in the chunk's order), the maximal runs of words that the repeated windows ``hit`` cover: [start, end)."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(hit):
            return out
        d, p = self.d[hit], self.p[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + self.window)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(hit)) - 1
        for doc, a, b in zip(d[starts].tolist(), p[starts].tolist(), (p[ends] + self.window).tolist()):
            out.setdefault(doc, []).append((a, b))
        return out


def _cut(texts, gone: dict[int, list[tuple[int, int]]]):
    """For each text: (kept words joined by one space, words, words removed)."""
    for i, j, w in K.word_blocks(texts, K.SPACE):
        raw = w.buf.tobytes()
        starts, ends, first = w.starts, w.ends, w.first.tolist()
        for doc in range(i, j):
            a, b = first[doc - i], first[doc - i + 1]
            cuts, n = gone.get(doc), b - a
            if cuts is None:
                yield b" ".join(raw[starts[a] : ends[b - 1]].split()) if n else b"", n, 0
                continue
            parts, at = [], 0
            for x, y in [*cuts, (n, n)]:
                if x > at:
                    parts += raw[starts[a + at] : ends[a + x - 1]].split()
                at = y
            yield b" ".join(parts), n, sum(y - x for x, y in cuts)


def _cut_in_place(texts, gone: dict[int, list[tuple[int, int]]]):
    """Each text without the removed words and the white space behind them; texts that lose nothing stay as they are."""
    for i, j, w in K.word_blocks(texts, K.SPACE):
        raw = w.buf.tobytes()
        for doc in range(i, j):
            a, b = int(w.first[doc - i]), int(w.first[doc - i + 1])
            at, end = int(w.offs[doc - i]), int(w.offs[doc - i + 1])
            parts = []
            for x, y in gone.get(doc, ()):
                parts.append(raw[at : w.starts[a + x]])
                at = int(w.starts[a + y]) if a + y < b else end
            yield b"".join([*parts, raw[at:end]])


def substring_dedup(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, layout: bool = False) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller id.

    Words are maximal runs of characters other than space and U+0009 to U+000D,
    unchanged; windows are ``window`` consecutive words of one document, judged
    on the input.  Returns all columns of ``docs``, with the kept words joined by
    one space as ``text_col`` (with ``layout``: the text itself, without the removed
    words and the white space behind each; null texts stay null), and n_words, n_removed (long), kept_sha256 (of the
    kept text, lowercase hex) and removed (array of [start, end) word positions);
    input columns of these four names are replaced.

    Null texts have no words and give the empty text.  Rows with a null id have
    no place in the order: they are returned whole and remove nothing.  Rows that
    share an id don't remove from each other, and are held by one task together.
    An empty table gives an empty one.
    """
    docs = docs.drop(*ADDED)
    place = CHUNK
    while place in docs.columns:
        place += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])
    names = docs.columns
    _, size = input_size(docs, text_col)
    chunk_bytes = min(max(chunk_bytes, math.isqrt(ROW_BYTES * size)), max(chunk_bytes, MOST_CHUNK_BYTES))
    own = F.octet_length(text_col).cast("long")
    ranges = even_ranges(docs.select(F.col(id_col), F.col(text_col)), id_col, F.coalesce(own, F.lit(0)), chunk_bytes)
    parts = buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges.n // 4, 1)
    key = F.col(id_col).cast("long")
    spread = F.pmod(F.xxhash64(text_col), F.lit(ranges.n)).cast("int")
    dealt = docs.withColumn(place, F.coalesce(ranges.fine(key, ranges.coarse(key)), spread)).repartition(parts, place)

    def emit(table: pa.Table) -> pa.Table:
        c = _Chunk(table, id_col, text_col, window, buckets)
        some = np.flatnonzero(np.diff(c.cuts))
        blobs = [K.pack_sorted(c.unique[c.cuts[b] : c.cuts[b + 1]]) for b in some.tolist()]
        chunk = table.column(place)[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(some), pa.int32()), "bucket": pa.array(some, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        """Which hashes of each chunk also are in another chunk, one bit each."""
        chunks = np.asarray(table.column("chunk"))
        order = np.argsort(chunks, kind="stable")
        blobs = table.column("blob")
        lists = [K.unpack_sorted(blobs[int(i)].as_py()) for i in order]
        h = np.concatenate(lists)
        by = np.argsort(h, kind="stable")
        h = h[by]
        seen = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        seen[by[1:]] = same
        seen[by[:-1]] |= same
        bits, at = [], 0
        for x in lists:
            bits.append(np.packbits(seen[at : at + len(x)]).tobytes())
            at += len(x)
        return pa.table({place: pa.array(chunks[order], pa.int32()), "bucket": table.column("bucket").take(pa.array(order)), "bits": pa.array(bits, pa.binary())})

    def prove(table: pa.Table, replies: pa.Table) -> pa.Table:
        """The digests of windows that another chunk may have too, by bucket."""
        rows = {place: [], "bucket": [], "at": [], "digests": []}
        if len(table) and len(replies):
            c = _Chunk(table, id_col, text_col, window, buckets)
            shared = np.zeros(len(c.unique), bool)
            for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
                n = int(c.cuts[b + 1] - c.cuts[b])
                shared[c.cuts[b] : c.cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            at, digest = c.proofs(shared)
            ends = np.searchsorted(at, c.cuts)
            for b in np.flatnonzero(np.diff(ends)).tolist():
                x, y = ends[b], ends[b + 1]
                for name, value in ((place, table.column(place)[0].as_py()), ("bucket", b), ("at", at[x:y].astype(np.uint32).tobytes()), ("digests", digest[x:y].tobytes())):
                    rows[name].append(value)
        return pa.table({x: pa.array(v, k) for (x, v), k in zip(rows.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    def settle(table: pa.Table) -> pa.Table:
        """What each chunk sent that an earlier chunk sent too."""
        table = table.sort_by(place)
        lists = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("digests").to_pylist()]
        digest = np.concatenate(lists)
        order, first, second = by_both(digest[:, 0], digest[:, 1])
        seen = np.zeros(len(digest), bool)
        seen[order[1:]] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        places, ranks, x = [], [], 0
        for at in (np.frombuffer(y, np.uint32) for y in table.column("at").to_pylist()):
            hit = seen[x : x + len(at)]
            places.append(at[hit].tobytes())
            ranks.append(rank_in(at)[hit].astype(np.uint32).tobytes())
            x += len(at)
        return pa.table({place: table.column(place), "at": pa.array(places, pa.binary()), "ranks": pa.array(ranks, pa.binary())})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _Chunk(table, id_col, text_col, window, buckets) if len(table) else None
        if c is None:
            return pa.Table.from_pylist([], schema=pa.schema([]))
        at, rank = (np.frombuffer(b"".join(replies.column(x).to_pylist()), np.uint32).astype(np.int64) for x in ("at", "ranks"))
        gone = c.intervals(c.repeated(at, rank))
        kept, n_words, n_removed, sums = [], [], [], []
        for text, n, k in _cut(c.texts, gone):
            kept.append(text.decode())
            n_words.append(n)
            n_removed.append(k)
            sums.append(hashlib.sha256(text).hexdigest())
        out = table.select(names).take(pa.array(c.order))
        if layout:
            kept = [y.decode() if ok else None for ok, y in zip(c.texts.is_valid().to_pylist(), _cut_in_place(c.texts, gone))]
        out = out.set_column(names.index(text_col), text_col, pa.array(kept, pa.string()))
        removed = [[list(x) for x in gone.get(i, ())] for i in range(len(kept))]
        for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept_sha256", sums, pa.string()), ("removed", removed, pa.list_(pa.list_(pa.int64())))):
            out = out.append_column(name, pa.array(values, kind))
        return out

    sent = dealt.groupBy(place).applyInArrow(emit, "chunk int, bucket int, blob binary")
    replies = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, f"`{place}` int, bucket int, bits binary")
    asked = dealt.groupBy(place).cogroup(replies.repartition(parts, place).groupBy(place)).applyInArrow(prove, f"`{place}` int, bucket int, at binary, digests binary")
    told = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, f"`{place}` int, at binary, ranks binary")
    return dealt.groupBy(place).cogroup(told.repartition(parts, place).groupBy(place)).applyInArrow(finish, schema)
