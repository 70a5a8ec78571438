"""Language ID with hyperdimensional profiles.

Each of 64 symbols (word boundary, a to z, and 37 classes of other letters) has a
random vector of ``DIM`` signs.  The vector of three letters abc binds them by
position: rho(rho(a)) * rho(b) * c, where rho rotates by one place.  A text is
the bundle (sum) of the vectors of its letter triples inside words, padded with
one boundary each side; a language's prototype is the bundle of its training
texts.  Documents go to the prototype with the greatest cosine.

A document's inner product with a prototype is the sum over its triples of the
triple's inner product with it, and its own norm is the same for all languages.
So the products of all 64**3 triples with each normalised prototype are tabled
once, and a document's comparison is a sum of table entries: exact, and one
lookup a letter and language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

DIM, SEED, SYMBOLS = 1024, 20240607, 64
#: Bound of the training sample, in documents of each language.
PER_LANGUAGE = 5000
UNKNOWN = "und"


@cache
def symbols() -> np.ndarray:
    """The symbol of each code point: 0 for all but letters; case doesn't matter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 37
    return out


def triples(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code) of each letter triple in a block of texts, and the number of letters by row."""
    buf, offs, _ = K.utf8(column)
    n = len(offs) - 1
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    row = np.repeat(np.arange(n), np.diff(chars[offs]))
    s = symbols()[points]
    letters = np.bincount(row[s > 0], minlength=n)
    stream = np.zeros(len(s) + n + 1, np.uint8)
    owner = np.zeros(len(s) + n + 1, np.int32)
    at = np.arange(len(s)) + row + 1
    stream[at], owner[at] = s, row
    keep = stream > 0
    keep[1:] |= stream[:-1] > 0
    keep[0] = True
    stream, owner = stream[keep].astype(np.int32), owner[keep]
    if len(stream) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), letters
    code = (stream[:-2] << 12) | (stream[1:-1] << 6) | stream[2:]
    inside = stream[1:-1] > 0
    return owner[1:-1][inside], code[inside], letters


def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * 2 - 1


def bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of letter triples."""
    v = _letter_vectors()
    a, b, c = codes >> 12, (codes >> 6) & 63, codes & 63
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


@dataclass
class Profiles:
    """Languages and, by triple and language, the inner product with the normalised prototype."""

    languages: list[str]
    table: np.ndarray

    def predict(self, column) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the index of its language (-1: null, no letter or nothing learned) and a score from 0 to 1."""
        best, score = [], []
        buf, offs, _ = K.utf8(column)
        for i, j in K.doc_blocks(offs):
            b, s = self._block(column.slice(i, j - i))
            best.append(b)
            score.append(s)
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))

    def _block(self, column) -> tuple[np.ndarray, np.ndarray]:
        row, code, letters = triples(column)
        n, k = len(letters), len(self.languages)
        if not k:
            return np.full(n, -1), np.zeros(n)
        like = np.stack([np.bincount(row, weights=self.table[x][code], minlength=n) for x in range(k)], axis=1)
        best = like.argmax(axis=1)
        like = np.maximum(like, 0)
        top = like.max(axis=1, keepdims=True)
        share = (like / np.where(top > 0, top, 1)) ** 4  # the fourth powers of the cosines, over their sum
        score = np.where(top[:, 0] > 0, 1 / np.maximum(share.sum(axis=1), 1), 1 / k)
        return np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0)


def bundle(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Profiles:
    """Profiles from (triples, counts) by language."""
    languages = sorted(counts)
    protos = np.zeros((len(languages), DIM))
    for k, name in enumerate(languages):
        codes, n = counts[name]
        for i in range(0, len(codes), 4096):
            protos[k] += n[i : i + 4096].astype(np.float64) @ bound(codes[i : i + 4096]).astype(np.float64)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    table = np.zeros((len(languages), SYMBOLS**3), np.float32)
    for i in range(0, SYMBOLS**3, 4096):
        table[:, i : i + 4096] = protos.astype(np.float32) @ bound(np.arange(i, i + 4096)).astype(np.float32).T
    return Profiles(languages, table)


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, usable: Column, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from about ``per_language`` documents of each language, drawn by a hash of the id.

    Sends the driver at most one row for each language and occurring triple.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Profiles([], np.zeros((0, SYMBOLS**3), np.float32))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1 << 20, -(-per_language * (1 << 20) // n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("lang_id"), id_col), F.lit(1 << 20)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            _, offs, _ = K.utf8(batch.column("text"))
            for i, j in K.doc_blocks(offs):
                row, code, _ = triples(batch.column("text").slice(i, j - i))
                for name in set(names[i:j]):
                    own = np.bincount(code[names[i:j][row] == name], minlength=SYMBOLS**3)
                    total[name] = total[name] + own if name in total else own
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "code": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    got = sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).orderBy("lang", "code").toArrow()
    names = np.asarray(got.column("lang").to_pylist(), dtype=object)
    codes, n = np.asarray(got.column("code")), np.asarray(got.column("n"))
    return bundle({name: (codes[names == name], n[names == name]) for name in sorted(set(names))})


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predict the language of each text.

    Learns from documents whose crc32(id as text) mod ``folds`` is not ``fold``;
    a prediction sees the text alone.  Returns id_col, held_out, lang_pred (``und``
    if the text is null or has no letter, or if nothing was learned) and score
    (share of the best cosine's fourth power, 0 for ``und``).

    Rows without an id aren't learned from and count as not held out; without
    text or language they aren't learned from.  Repeated rows give repeated rows,
    ties go to the language that sorts first, other columns take no part, and an
    empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    K.small_batches(docs.sparkSession)
    part = F.crc32(F.col("id").cast("string")) % folds
    model = train(docs, id_col="id", text_col="text", lang_col="lang", usable=part != fold, per_language=per_language)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            m = sent.value
            best, score = m.predict(batch.column("text"))
            names = [*m.languages, UNKNOWN]
            yield pa.record_batch({"id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([names[k] for k in best.tolist()], pa.string()), "score": pa.array(score, pa.float64())})

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", F.coalesce(part == fold, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
