"""Vectorised text kernels on Arrow buffers, shared by the operators here.

A column of strings arrives as one UTF-8 buffer with offsets.  Words, word
hashes and window hashes are computed on the whole buffer with numpy, in blocks
of bounded size, so no Python loop runs over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
#: Odd multipliers of the polynomial hashes, modulo 2**64 (arbitrary constants).
BYTE_BASE = 0x9E6C63D0876A9A47
WORD_BASE = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
BLOCK_BYTES = 1 << 18
#: Most bytes of a word, and most words of a window, that one polynomial hashes.
LONG = 64
#: Most bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Most rows of a batch that the Parquet reader fills at once.
READ_ROWS = 512

#: Word separators of the whitespace word rule: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Word separators of the alphanumeric word rule: every ASCII byte but digits and letters.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[0x80:] = False
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def small_batches(spark: SparkSession) -> None:
    """Have batches of long texts cut smaller in this session, unless it already asks for smaller ones.

    Spark's own bounds (10,000 rows or 64 MB for Arrow, 4096 rows for the Parquet
    reader) are too wide for texts where several workers share an executor.  Only
    the cutting changes, no result does.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < size(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n; kept and grown by doubling."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 2 * len(have[0]) if have else 0)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=U64)
            t[0] = 1
            pair.append(np.multiply.accumulate(t))
        have = _tables[base] = (pair[0], pair[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit of the result is usable."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets with one more entry than rows, validity) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    valid = np.ones(len(column), dtype=bool) if not column.null_count else np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), valid
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0], valid


def doc_blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text is a block of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a block; no word crosses a row's end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(n + 2, dtype=bool)
    np.logical_not(sep[buf], out=word[1:-1])
    edges = offs[(offs > 0) & (offs < n)]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    first[edges] = word[1:-1][edges]
    last[edges - 1] = word[1:-1][edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they stand.

    Prefix sums of a polynomial over the bytes give any word's value by one
    subtraction; sums restart every ``BLOCK_BYTES`` at a word's start.  Polynomials
    modulo 2**64 are only fit for short words (from about 1,000 letters on, words
    with different letters are known that share every such value), so words of more
    than ``LONG`` bytes are hashed by themselves.
    """
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        part = buf[a:b]
        if lower:
            part = LOWER[part]
        up, down = powers(BYTE_BASE, b - a + 1)
        sums = np.zeros(b - a + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
        for k in np.flatnonzero(e - s > LONG).tolist():
            out[i + k] = int.from_bytes(hashlib.blake2b(part[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return out


class Words:
    """Words of a block of rows: byte spans, hashes, and the first word of each row (``first``, one more than rows)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, sep: np.ndarray, *, lower: bool = False):
        self.buf, self.offs = buf, offs
        self.starts, self.ends = _spans(buf, offs, sep)
        self.first = np.searchsorted(self.starts, offs, side="left")
        self.hashes = word_hashes(buf, self.starts, self.ends, lower=lower)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_blocks(column, sep: np.ndarray, *, lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of a string column, block by block."""
    buf, offs, _ = utf8(column)
    for i, j in doc_blocks(offs, most):
        yield i, j, Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], sep, lower=lower)


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``size`` words inside one row: (hash, index of its first word).

    Windows of more than ``LONG`` words chain the hashes of windows of that size, for
    the reason given at ``word_hashes``.
    """
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    step = min(size, LONG)
    up, down = powers(WORD_BASE, n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(words.hashes * up[:n], out=sums[1:])
    part = mix((sums[step:] - sums[:-step]) * down[: n - step + 1])
    h = part[: n - size + 1]
    for at in [*range(step, size - step, step), size - step][: -(-size // step) - 1]:
        h = mix(h * U64(0x9E3779B97F4A7C15) + part[at : at + n - size + 1])
    left = np.repeat(words.first[1:], np.diff(words.first))[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(left >= size)
    return h[at], at


def window_checks(words: Words, size: int) -> np.ndarray:
    """A second hash, of 32 bits, of the window of ``size`` words that starts at each word (windows may cross rows).

    Words' hashes are mixed anew and folded by doubling, so it shares no structure with ``window_hashes``.
    """
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    power, width, out, at = (words.hashes ^ (words.hashes >> U64(29))) * U64(0xD6E8FEB86659FD93), 1, None, 0
    while True:  # ``power`` folds windows of ``width`` words
        if size & width:
            own = power[at : at + n]
            out = own if out is None else out * U64(0xA0761D6478BD642F) + (own ^ (own >> U64(31)))
            at += width
        if at == size:
            return (mix(out) >> U64(32)).astype(np.uint32)
        power = power[:-width] * U64(0xE7037ED1A0B428DB) + (power[width:] ^ (power[width:] >> U64(33)))
        width *= 2


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences, without the planes that are all zero."""
    d = np.diff(h, prepend=U64(0))
    planes = d.view(np.uint8).reshape(-1, 8).T if len(d) else np.zeros((8, 0), np.uint8)
    # the first value is stored apart, so that it doesn't widen the rest
    first = int(h[0]) if len(h) else 0
    rest = planes[:, 1:]
    width = max((k + 1 for k in range(8) if rest[k].any()), default=0)
    return first.to_bytes(8, "little") + bytes([width]) + len(h).to_bytes(8, "little") + np.ascontiguousarray(rest[:width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The values that ``pack_sorted`` packed."""
    first, width, n = int.from_bytes(blob[:8], "little"), blob[8], int.from_bytes(blob[9:17], "little")
    d = np.zeros((n, 8), np.uint8)
    if n > 1 and width:
        d[1:, :width] = np.frombuffer(blob, np.uint8, offset=17).reshape(width, n - 1).T
    v = d.view(U64).reshape(n)
    if n:
        v[0] = first
    return np.cumsum(v, dtype=U64)
