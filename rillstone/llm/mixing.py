"""Mixing sources to target weights by soft membership.

A softmax classifier, trained on the driver on a bounded sample of the labelled
table (``PER_DOMAIN`` documents of each domain), gives every document posteriors
of the domains: ``toxic`` (labels.toxic = 1), else ``fine`` or ``poor`` (labels.quality
1 or 0).  Then nonnegative rates r are fitted to all documents, so that the
expected tokens of each domain, sum of r * tokens * posterior, match the targets:

    minimise |sum_d r_d (n_d / T) p_d - target|^2,  r >= 0

by projected gradients from r = 1, in the metric that weighs a document by its
tokens, which keeps rates of equal posteriors equal.  Step sizes are spectral
(Barzilai and Borwein), with the safe step 1 / L after a rise; as the problem has
the rank of the domains, few rounds are needed.  A round is one aggregation over
the table of posteriors that sends the driver a number for each domain; a
document's rate follows from the history of steps, so no state is kept between
rounds.  The fit ends when the targets are met or the projected gradient vanishes,
that is when no rate can change for the better, both to within ``TOLERANCE``.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from ..store import Scratch

DOMAINS = ("fine", "poor", "toxic")
TARGETS = {"fine": 0.80, "poor": 0.15, "toxic": 0.05}
#: Bound of the training sample, in documents of each domain.
PER_DOMAIN = 1500
BITS, EPOCHS, RATE, SEED = 15, 40, 0.1, 3
TOLERANCE = 1e-6
#: Rounds without end mean that the numbers are beyond this arithmetic; the fit then fails rather than stop halfway.
RUNAWAY = 2000
#: Longest text (bytes) that the classifiers learn from; all texts are scored whole.
SAMPLE_BYTES = 1 << 20
log = logging.getLogger(__name__)
STYLE = 7


def features(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of a block, and by row: log length, share of distinct words, mean word length, shares of upper case, digits, marks and line feeds."""
    ids = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    n_rows = len(w.offs) - 1
    n = np.diff(w.first)
    rows = w.rows()
    distinct = np.bincount(np.unique((rows << BITS) | ids) >> BITS, minlength=n_rows)
    size = np.maximum(np.diff(w.offs), 1)
    kinds = np.zeros(256, np.int8)
    kinds[65:91], kinds[48:58], kinds[10] = 1, 2, 4
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    kind = kinds[w.buf]
    sums = np.zeros((5, len(w.buf) + 1), np.int32)
    for k in range(1, 5):
        np.cumsum(kind == k, out=sums[k, 1:])
    shares = [(sums[k, w.offs[1:]] - sums[k, w.offs[:-1]]) / size for k in range(1, 5)]
    spans = np.bincount(rows, weights=w.ends - w.starts, minlength=n_rows)
    return ids, np.stack([np.log1p(n) / 8, distinct / np.maximum(n, 1), spans / np.maximum(n, 1) / 10, *[4 * s for s in shares]], axis=1)


@dataclass
class Classifier:
    words: np.ndarray
    style: np.ndarray
    bias: np.ndarray

    def logits(self, ids: np.ndarray, rows: np.ndarray, n: np.ndarray, style: np.ndarray) -> np.ndarray:
        share = 1 / np.sqrt(np.maximum(n, 1))
        own = np.stack([np.bincount(rows, weights=self.words[k][ids], minlength=len(n)) for k in range(len(self.bias))], axis=1)
        return own * share[:, None] + style @ self.style + self.bias

    def posteriors(self, *args) -> np.ndarray:
        z = self.logits(*args)
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True) if len(z) else z


def fit_classifier(ids: np.ndarray, rows: np.ndarray, n: np.ndarray, style: np.ndarray, domain: np.ndarray, prior: np.ndarray) -> Classifier:
    """Full-batch Adam on the sample; the biases are then moved from the sample's shares to the ``prior`` ones."""
    k = len(DOMAINS)
    model = Classifier(np.zeros((k, 1 << BITS)), np.zeros((STYLE, k)), np.zeros(k))
    if not len(n):
        return model
    truth = np.eye(k)[domain]
    share = 1 / np.sqrt(np.maximum(n, 1))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.words, model.style, model.bias)]
    for step in range(1, EPOCHS + 1):
        err = (model.posteriors(ids, rows, n, style) - truth) / len(n)
        each = err * share[:, None]
        g_words = np.stack([np.bincount(ids, weights=each[rows, x], minlength=1 << BITS) for x in range(k)])
        for p, g, m in zip((model.words, model.style, model.bias), (g_words + 1e-6 * model.words, style.T @ err, err.sum(axis=0)), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= RATE * (1 - step / (EPOCHS + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    seen = truth.mean(axis=0)
    model.bias += np.log(np.maximum(prior, 1e-6)) - np.log(np.maximum(seen, 1e-6))
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, per_domain: int = PER_DOMAIN) -> Classifier:
    """Learn from about ``per_domain`` labelled documents of each domain, drawn by a hash of the id."""
    code = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("id"), code.alias("domain")).groupBy("id").agg(F.max("domain").alias("domain"))
    sizes = {r[0]: r[1] for r in marks.groupBy("domain").count().collect()}
    keep = F.lit(False)
    for d, n in sizes.items():
        keep = keep | ((F.col("domain") == d) & (F.pmod(F.xxhash64(F.lit("mixing"), "id"), F.lit(1 << 20)) < min(1 << 20, -(-per_domain * (1 << 20) // n))))
    # about per_domain labels of each domain (their number was counted), so few enough to broadcast; of rows that share an id one is learned from
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    sample = usable.join(F.broadcast(marks.where(keep)), "id").groupBy("id").agg(F.min("domain").alias("domain"), F.min("text").alias("text"))

    def hashed(batches):
        for batch in batches:
            words, style = [], []
            for _, _, w in K.word_blocks(batch.column("text"), K.NON_ALNUM, lower=True):
                ids, s = features(w)
                ids = ids.astype(np.uint16)
                words += [ids[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
                style += s.tolist()
            yield pa.record_batch({"id": batch.column("id"), "domain": batch.column("domain"), "words": pa.array(words, pa.binary()), "style": pa.array(style, pa.list_(pa.float64()))})

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.select("id", "domain", "text").mapInArrow(hashed, f"id {kind}, domain int, words binary, style array<double>").toArrow().sort_by([("id", "ascending"), ("words", "ascending")])
    texts = [np.frombuffer(x, np.uint16).astype(np.int64) for x in got.column("words").to_pylist()]
    n = np.array([len(t) for t in texts], np.int64)
    prior = np.array([sizes.get(d, 0) for d in range(len(DOMAINS))], float)
    ids = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    style = np.array(got.column("style").to_pylist(), float).reshape(len(texts), STYLE)
    return fit_classifier(ids, np.repeat(np.arange(len(n)), n), n, style, np.asarray(got.column("domain")).astype(np.int64), prior / max(prior.sum(), 1))


@dataclass
class Fit:
    """Steps (size, miss of each domain) whose replay gives the rates, and what is left: the miss and the projected gradient."""

    steps: list[tuple[float, np.ndarray]]
    miss: np.ndarray
    gradient: float

    @property
    def rounds(self) -> int:
        return len(self.steps)


def replay(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, rates before the last step) of documents with posteriors ``p``."""
    r = before = np.ones(len(p))
    for size, miss in steps:
        before, r = r, np.maximum(0, r - size * (p @ miss))
    return r, before


def fit_rates(table: DataFrame, targets: dict[str, float] | None, factors: dict[str, float] | None = None) -> Fit:
    """Fit a table (n_tokens, p: array) to shares of its tokens, or to its own shares times ``factors``; a round reads it once."""
    k = len(DOMAINS)

    def totals(steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
        """Expected tokens by domain, squared step and squared projected gradient before it, tokens, and at first the Gram matrix."""

        def run(batches):
            out = np.zeros(k + 3 + (0 if steps else k * k))
            for batch in batches:
                n = np.asarray(batch.column("n_tokens")).astype(float)
                p = np.asarray(batch.column("p").flatten()).reshape(-1, k)
                r, before = replay(p, steps)
                out[:k] += (n * r) @ p
                out[k] += n @ (r - before) ** 2
                out[k + 2] += n.sum()
                if steps:
                    g = p @ steps[-1][1]
                    out[k + 1] += n @ np.where(before > 0, g, np.minimum(g, 0)) ** 2
                else:
                    out[k + 3 :] += ((p * n[:, None]).T @ p).ravel()
            yield pa.record_batch({"at": pa.array(range(len(out)), pa.int32()), "v": pa.array(out, pa.float64())})

        got = table.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k + 3 + (0 if steps else k * k))
        for at, v in got:
            out[at] = v
        return out

    first = totals([])
    tokens = first[k + 2]
    if not tokens:
        return Fit([], np.zeros(k), 0.0)
    share = first[:k] / tokens
    if targets is None:
        target = share * [(factors or {}).get(d, 1.0) for d in DOMAINS]
    else:
        target = np.array([targets.get(d, 0.0) for d in DOMAINS])
    safe = 1 / max(float(np.linalg.eigvalsh(first[k + 3 :].reshape(k, k) / tokens)[-1]), 1e-12)
    steps: list[tuple[float, np.ndarray]] = []
    size, miss = safe, np.round(share - target, 12)  # rounded, as the order of summation varies
    best = [float(miss @ miss)]
    while float(np.abs(miss).max()) > TOLERANCE:
        if len(steps) >= RUNAWAY:
            raise RuntimeError(f"rates not settled after {RUNAWAY} rounds; miss {miss.tolist()}")
        steps.append((size, miss))
        got = totals(steps)
        gradient = float(np.sqrt(got[k + 1] / tokens))
        if gradient <= TOLERANCE:
            steps.pop()
            break
        new = np.round(got[:k] / tokens - target, 12)
        turn = float((new - miss) @ (new - miss))
        size = safe if float(new @ new) > max(best[-5:]) or not turn else float(got[k] / tokens) / turn
        best.append(float(new @ new))
        miss = new
    else:
        gradient = float(np.linalg.norm(miss))
    log.info("rates settled after %d rounds; miss %s, projected gradient %g", len(steps), miss.tolist(), gradient)
    return Fit(steps, miss, gradient)


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] | None = TARGETS, factors: dict[str, float] | None = None, report: list[Fit] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fit rates that bring the domains' expected tokens to ``targets`` (shares of the tokens of ``docs``).

    With ``targets`` None, the targets are the measured shares of ``docs`` times
    ``factors`` (1 where none is given).  ``report`` gets the fit: its rounds, what it
    misses of each target, and the projected gradient that is left.
    Returns the columns ``keep`` (all by default; input columns with the added
    names are replaced) with n_tokens (words), p_fine, p_poor and p_toxic
    (posteriors), rate (0 or more) and copies: the rate rounded up or down by a
    hash of the id, so that its expectation is the rate.

    Null and empty texts have no tokens and the posteriors of an empty text.  Rows
    without an id draw by a hash of their text.
    Without labels all posteriors are equal.  Targets that no nonnegative rates
    reach are met in the sense of least squares.  Repeated rows get equal rates;
    an empty table gives an empty one.
    """
    added = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    K.small_batches(docs.sparkSession)
    names = [c for c in keep or docs.columns if c not in added]
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    k = len(DOMAINS)

    def scored(column) -> tuple[np.ndarray, np.ndarray]:
        n, p = [np.zeros(0, np.int64)], [np.zeros((0, k))]
        for _, _, w in K.word_blocks(column, K.NON_ALNUM, lower=True):
            ids, style = features(w)
            n.append(np.diff(w.first))
            p.append(model.value.posteriors(ids, w.rows(), n[-1], style))
        return np.concatenate(n), np.concatenate(p)

    def score(batches):
        for batch in batches:
            n, p = scored(batch.column(0))
            ends = pa.array(np.arange(0, p.size + 1, k), pa.int32())
            yield pa.record_batch({"n_tokens": pa.array(n, pa.int64()), "p": pa.ListArray.from_arrays(ends, pa.array(p.ravel(), pa.float64()))})

    # texts aren't shuffled or kept: they are scored once for the small table of the fit and once more for the result
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    scratch = Scratch(docs.sparkSession)
    small = scratch.keep(docs.select(text_col).mapInArrow(score, "n_tokens long, p array<double>"))
    fit = fit_rates(small, targets, factors)
    scratch.drop(small)
    if report is not None:
        report.append(fit)
    steps = fit.steps

    def rate(batches):
        for batch in batches:
            n, p = scored(batch.column(text_col))
            r, _ = replay(p, steps)
            out = {name: batch.column(name) for name in names} | {"n_tokens": pa.array(n, pa.int64())}
            out |= {f"p_{d}": pa.array(p[:, x], pa.float64()) for x, d in enumerate(DOMAINS)}
            yield pa.record_batch(out | {"rate": pa.array(r, pa.float64()), "draw": batch.column("__draw")})

    draw = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(*dict.fromkeys([*names, text_col]), draw.alias("__draw"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_tokens long", *(f"p_{d} double" for d in DOMAINS), "rate double", "draw double"])
    return rows.mapInArrow(rate, schema).withColumn("copies", F.floor(F.col("rate") + F.col("draw")).cast("int")).drop("draw")


def resample(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row repeated ``copies`` times (0: dropped)."""
    names = docs.columns
    out = mix(docs, labels, **settings)
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
