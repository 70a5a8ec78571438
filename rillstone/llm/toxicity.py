"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Lower-cased words are hashed to embeddings, the sum of one for the word and one
for each of two prefixes, so that unseen forms of a stem are known; filters of one, two and three words
slide over the whole text, each keeps its greatest activation, and a logistic
layer weighs those.  The network is trained on the driver on a bounded sample
(``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, drawn by a hash of the
id) and scores all documents in Arrow batches.

A threshold is fitted for each language on the calibration part of the sample.
At scoring time the language is read off the text (hyperdimensional profiles),
and the raw probability is mapped piecewise linearly so that the language's
threshold becomes 0.5; labels, language column, source and id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from . import kernels as K
from . import lang_id

VOCAB_BITS, DIM, WIDTHS, FILTERS = 16, 16, (1, 2, 3), 16
PREFIXES = (4, 5)
MOST_TOXIC, MOST_CLEAN, EPOCHS, BATCH, RATE, SEED = 2000, 3000, 6, 32, 0.05, 11
PER_LANGUAGE = 500
#: Fewest calibration documents of each class for a language to have a threshold of its own.
LEAST_CALIBRATION = 10
#: Longest text (bytes) that is learned from; all texts are scored whole.
SAMPLE_BYTES = 1 << 20
#: Words of a text that are convolved at a time.
SPAN = 1 << 16


def word_ids(words: K.Words) -> np.ndarray:
    """Three embedding rows of each word: of the word and of its first bytes, as many as ``PREFIXES`` says."""
    heads = [K.word_hashes(words.buf, words.starts, np.minimum(words.ends, words.starts + k), lower=True) for k in PREFIXES]
    kinds = [words.hashes, *(K.mix(h + np.uint64(k)) for k, h in zip(PREFIXES, heads))]
    return np.stack([h >> np.uint64(64 - VOCAB_BITS) for h in kinds], axis=1).astype(np.int64)


@dataclass
class Net:
    """Weights: embeddings (words, DIM), filters by width (width, DIM, FILTERS), their biases, output weights and bias."""

    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def new(cls, rng: np.random.Generator) -> Net:
        emb = rng.normal(0, 0.1, (1 << VOCAB_BITS, DIM)).astype(np.float32)
        conv = [rng.normal(0, 1 / np.sqrt(k * DIM), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        return cls(emb, conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def activations(self, ids: np.ndarray, first: np.ndarray):
        """By width: activation of each window that starts at each word; windows past a text's end are 0."""
        x = sum(self.emb[ids[:, c]] for c in range(ids.shape[1]))
        n, left = len(ids), np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))
        for k, w, b in zip(WIDTHS, self.conv, self.bias):
            y = np.zeros((n, FILTERS), np.float32)
            y[: max(0, n - k + 1)] = b
            for o in range(min(k, n)):
                y[: n - k + 1] += x[o : n - k + 1 + o] @ w[o] if n >= k else 0
            np.maximum(y, 0, out=y)
            y[left < k] = 0
            yield y

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The greatest activation of each filter in each text; 0 for a text without words.

        A text of more than ``SPAN`` words is pooled in spans that overlap by a window,
        which gives the same maxima in bounded memory.
        """
        out = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        if len(first) == 2 and len(ids) > SPAN:
            over = max(WIDTHS) - 1
            for a in range(0, len(ids) - over, SPAN):
                part = ids[a : a + SPAN + over]
                np.maximum(out, self.pooled_span(part), out=out)
            return out
        some = np.flatnonzero(np.diff(first))
        if len(some):
            for k, y in enumerate(self.activations(ids, first)):
                out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, first[some], axis=0)
        return out

    def pooled_span(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([y.max(axis=0) for y in self.activations(ids, np.array([0, len(ids)]))])[None]

    def probability(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(ids, first) @ self.out + self.out_bias, -30, 30)))


def fit(texts: list[np.ndarray], toxic: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Train by adaptive gradient steps on mini-batches; texts: the words' embedding rows by document."""
    rng = np.random.default_rng(seed)
    net = Net.new(rng)
    weight = np.where(toxic > 0, 0.5 / max(1, (toxic > 0).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    params = [*net.conv, *net.bias, net.out]
    seen = [np.full_like(p, 1e-6) for p in params]
    seen_emb, seen_bias = np.full_like(net.emb, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            first = np.zeros(len(batch) + 1, np.int64)
            np.cumsum([len(texts[i]) for i in batch], out=first[1:])
            ids = np.concatenate([texts[i] for i in batch])
            if not len(ids):
                continue
            some = np.flatnonzero(np.diff(first))
            pool = np.zeros((len(batch), len(WIDTHS) * FILTERS), np.float32)
            where = np.zeros(pool.shape, np.int64)
            for k, y in enumerate(net.activations(ids, first)):
                for d in some:
                    part = y[first[d] : first[d + 1]]
                    at = part.argmax(axis=0)
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    where[d, cols], pool[d, cols] = at + first[d], part[at, np.arange(FILTERS)]
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.out_bias, -30, 30)))
            err = ((p - toxic[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads_out = pool.T @ err + 1e-4 * net.out
            back = err[:, None] * net.out[None, :] * (pool > 0)
            g_conv, g_bias, touched, g_rows = [], [], [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, at = back[:, cols], where[:, cols]
                g = np.zeros_like(net.conv[k])
                for o in range(width):
                    word = ids[np.minimum(at + o, len(ids) - 1)]
                    g[o] = np.einsum("nfe,nf->ef", net.emb[word].sum(axis=2), d)
                    rows = (d[:, :, None] * net.conv[k][o].T[None]).reshape(-1, DIM)
                    for c in range(word.shape[2]):
                        touched.append(word[:, :, c].ravel())
                        g_rows.append(rows)
                g_conv.append(g)
                g_bias.append(d.sum(axis=0))
            rows, back_to = np.unique(np.concatenate(touched), return_inverse=True)
            g_emb = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g_emb, back_to, np.concatenate(g_rows))
            for p_, s_, g_ in zip(params, seen, [*g_conv, *g_bias, grads_out]):
                s_ += g_ * g_
                p_ -= RATE * g_ / np.sqrt(s_)
            seen_emb[rows] += g_emb * g_emb
            net.emb[rows] -= RATE * g_emb / np.sqrt(seen_emb[rows])
            e = float(err.sum())
            seen_bias += e * e
            net.out_bias -= RATE * e / seen_bias**0.5
    return net


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the cut with the best F1 (the widest gap among equals)."""
    order = np.argsort(-p, kind="stable")
    q, t = p[order], toxic[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
    nxt = np.append(q[1:], 0.0)
    f1 = np.where(q > nxt, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(q[best] - nxt[best])]
    return float(np.clip((q[k] + nxt[k]) / 2, 1e-6, 1 - 1e-6))


@dataclass
class Model:
    net: Net | None
    profiles: lang_id.Profiles
    thresholds: dict[str, float]
    default: float

    def score(self, column) -> np.ndarray:
        """Calibrated score of each text; 0 if nothing was learned."""
        out = []
        _, offs, _ = K.utf8(column)
        if self.net is None:
            return np.zeros(len(offs) - 1)
        for i, j, w in K.word_blocks(column, K.NON_ALNUM, lower=True, most=K.BLOCK_BYTES // 4):
            p = self.net.probability(word_ids(w), w.first)
            best, _ = self.profiles.predict(column.slice(i, j - i))
            cut = np.array([*(self.thresholds.get(x, self.default) for x in self.profiles.languages), self.default])[best]
            out.append(np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut)))
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Learn from labelled documents outside the held-out fold; of rows that repeat a label's id, a toxic one counts."""
    usable = F.crc32(F.col(id_col).cast("string")) % folds != fold
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(usable & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20))
    sizes = {r[0]: r[1] for r in marks.where(F.crc32(F.col("id").cast("string")) % folds != fold).groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for value, most in ((1, most_toxic), (0, most_clean)):
        if sizes.get(value):
            keep = keep | ((F.col("toxic") == value) & (draw < min(1 << 20, -(-most * (1 << 20) // sizes[value]))))
    # the drawn labels number about most_toxic + most_clean (all were counted), so few enough to broadcast; of rows that share an id one is learned from
    drawn = rows.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(marks.where(keep)), "id")
    sample = drawn.groupBy("id").agg(F.min("text").alias("text"), F.min_by("lang", "text").alias("lang"), F.min("toxic").alias("toxic"))

    def hashed(batches):
        for batch in batches:
            blobs = []
            for _, _, w in K.word_blocks(batch.column("text"), K.NON_ALNUM, lower=True):
                ids = word_ids(w).astype(np.uint16)
                blobs += [ids[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.record_batch({"id": batch.column("id"), "lang": batch.column("lang"), "toxic": batch.column("toxic"), "words": pa.array(blobs, pa.binary())})

    kind = rows.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(hashed, f"id {kind}, lang string, toxic int, words binary").toArrow().sort_by([("id", "ascending"), ("words", "ascending")])
    profiles = lang_id.train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, usable=usable, per_language=PER_LANGUAGE)
    texts = [np.frombuffer(x, np.uint16).astype(np.int64).reshape(-1, 1 + len(PREFIXES)) for x in got.column("words").to_pylist()]
    toxic = np.asarray(got.column("toxic")).astype(np.float32)
    if len(set(toxic.tolist())) < 2:
        return Model(None, profiles, {}, 0.5)
    langs = np.asarray(got.column("lang").to_pylist(), dtype=object)
    held = np.arange(len(texts)) % 5 == 0
    net = fit([t for t, h in zip(texts, held) if not h], toxic[~held])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    p = np.concatenate([net.probability(np.concatenate(texts[i : i + 64]), first[i : min(i + 64, len(texts)) + 1] - first[i]) for i in range(0, len(texts), 64)])
    both = lambda use: min((toxic[use] > 0).sum(), (toxic[use] == 0).sum())
    default = best_threshold(p[held], toxic[held]) if both(held) else 0.5
    cuts = {x: best_threshold(p[use], toxic[use]) for x in profiles.languages if both(use := held & (langs == x)) >= LEAST_CALIBRATION}
    return Model(net, profiles, cuts, default)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> DataFrame:
    """Score each text for toxicity as ``labels.toxic`` marks it.

    Learns from labelled documents whose crc32(id as text) mod ``folds`` is not
    ``fold``.  Returns all columns of ``docs`` with held_out (boolean), score
    (0 to 1) and predicted (1 if score >= 0.5); input columns of these names are replaced.

    Null and empty texts have no words and get the score of an empty text (0 if
    there is nothing to learn from: no labels, or of one class).  Rows without an
    id are scored, not learned from, and count as not held out.  Repeated rows
    get equal scores.  An empty table gives an empty one.
    """
    docs = docs.drop("held_out", "score", "predicted")
    K.small_batches(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, folds=folds, fold=fold)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            score = sent.value.score(batch.column(text_col))
            arrays = {name: batch.column(name) for name in batch.schema.names}
            yield pa.record_batch(arrays | {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())})

    rows = docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False)))
    schema = type(rows.schema)([*rows.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(predict, schema)
