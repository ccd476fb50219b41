"""Quality classifier learned from positives and unlabelled text (non-negative PU learning).

Trusted positives are documents that ``labels.quality`` marks 1; everything else is unlabelled. Two
steps: a positive-against-unlabelled model, fitted on one half of the training documents, scores the
other half, and the least ratio of the unlabelled to the positive share above any threshold estimates
the class prior. Then the final model
minimises the non-negative unbiased risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with the
logistic loss.

Features are counts of the text alone; labels, lang, source and doc_id are no inputs of a score. All
training documents count, positives and unlabelled ones alike, on both steps: mean and scale of the
features, and in each round the risk, its gradient and its curvature, are sums over the landed feature
rows, made per task and added up in Spark. What reaches the driver in a round is one sum per pair of
features, whatever the input; a step is Newton's, halved while it raises the risk. Documents whose crc32
of the doc_id leaves HELD_OUT on division by FOLDS are never learned from.

Rules for odd input: null and empty texts have zero features and get a score; documents without a label
are unlabelled; labels without a document, and null labels, count for nothing; a doc_id labelled more
than once is positive if any label is 1. Without positives the score is 0.5. Rows without a doc_id are
scored, not learned from. Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.joins import lookup_join
from sitefacts.llm.common import columns, land, slices, utf8
from sitefacts.llm.quality_rules import BLANKS, CLASSES, SYMBOLS, class_counts, repeat_words

FOLDS, HELD_OUT = 3, 1
ROUNDS, RIDGE, LIMIT = 12, 0.03, 8.0
#: Rounds end when the risk falls by less than this.
SETTLED = 1e-7
#: Least share of positives above a threshold for its ratio to count.
MIN_TAIL = 0.3
BINS = 1000
FEATURES = 2 * len(CLASSES) + 18


def features(data: bytes) -> np.ndarray:
    """Shares of character classes, their square roots, and shapes of words and lines, all between 0 and a few units."""
    out = np.zeros(FEATURES)
    words = data.split()
    if not words:
        return out
    counts = class_counts(data)
    shares = counts / counts.sum()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in data.split(b"\n") if x.translate(None, BLANKS)]
    line_words = np.array([len(x.split()) for x in lines])
    unique = len({w.lower() for w in words})
    share = lambda it: sum(it) / n
    shapes = [
        1.0,
        np.log1p(n) / 5, lengths.mean() / 10, lengths.std() / 10, np.quantile(lengths, 0.9) / 10, (lengths <= 3).mean(), (lengths > 12).mean(),
        unique / n, unique / np.sqrt(n) / 10,
        share(w.isupper() for w in words), share(w[-1:] in b"!?$%&*#|" for w in words), share(not w.strip(b".,;:!?'\"()-|#*$%&<>") for w in words),
        share(w[-1:] in (b".", b",") for w in words), (len(data) - len(data.translate(None, SYMBOLS))) / n,
        np.log1p(line_words.mean()) / 3, np.log1p(line_words.max()) / 5, 1 - len(set(lines)) / len(lines), repeat_words(words) / n,
    ]
    out[: len(CLASSES)], out[len(CLASSES) : 2 * len(CLASSES)] = shares, np.sqrt(shares)
    out[2 * len(CLASSES) :] = shapes
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    """A linear score of standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a last column of ones for the bias."""
        return np.column_stack([np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT), np.ones(len(x))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The sums that mean and scale are made of: rows, values, squares."""
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def risk_sums(model: Model, x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Of rows, all of them unlabelled and some positive too: the sums that risk, gradient and curvature are made of."""
    z = model.inputs(x)
    g = z @ model.weights
    share = sigmoid(g)
    curve = share * (1 - share)
    p = positive
    of_all = [[len(x), softplus(g).sum()], share @ z, ((z * curve[:, None]).T @ z).ravel()]
    of_positive = [[p.sum(), softplus(-g[p]).sum(), softplus(g[p]).sum()], (share[p] - 1) @ z[p], share[p] @ z[p], ((z[p] * curve[p][:, None]).T @ z[p]).ravel()]
    return np.concatenate([*of_all, *of_positive])


class Risk:
    """Value, gradient and curvature of the risk from ``risk_sums``.

    With a prior: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the second part is below zero it
    is fitted too closely, and the gradient leads back from it. Without one: the plain logistic loss of
    positives against unlabelled, equally weighted.
    """

    def __init__(self, sums: np.ndarray, weights: np.ndarray, prior: float | None):
        n = len(weights)
        parts = np.split(sums, np.cumsum([2, n, n * n, 3, n, n])[:6])
        (n_u, down), slope_u, curve_u, (n_p, up, as_negative), slope_up, slope_negative, curve_p = parts
        curve_u, curve_p = curve_u.reshape(n, n) / n_u, curve_p.reshape(n, n) / n_p
        slope_u, slope_up, slope_negative = slope_u / n_u, slope_up / n_p, slope_negative / n_p
        if prior is None:
            self.value, self.slope, self.curve = up / n_p + down / n_u, slope_up + slope_u, curve_p + curve_u
        else:
            inner = down / n_u - prior * as_negative / n_p
            self.value = prior * up / n_p + max(0.0, inner)
            if inner >= 0:
                # the curvature of the positives cancels: a logistic loss and its mirror differ by a line
                self.slope, self.curve = prior * slope_up + slope_u - prior * slope_negative, curve_u
            else:
                self.slope, self.curve = prior * slope_negative - slope_u, curve_u
        decay = np.r_[np.full(n - 1, RIDGE), 0.0]
        self.value += float((decay * weights * weights).sum() / 2)
        self.slope = self.slope + decay * weights
        self.curve = self.curve + np.diag(decay + 1e-6)

    def step(self) -> np.ndarray:
        return np.linalg.solve(self.curve, self.slope)


def fit(total, prior: float | None, rounds: int = ROUNDS) -> Model:
    """``total`` gives the sum over all training rows of a function of (features, positive); one pass per round."""
    n, *rest = total(moments)
    first, second = np.array(rest).reshape(2, -1) / max(1.0, n)
    scale = np.sqrt(np.maximum(0.0, second - first * first))
    scale[scale < 1e-6] = 1.0
    model = Model(first, scale, np.zeros(len(first) + 1))
    best, taken = None, None
    for _ in range(rounds):
        risk = Risk(total(partial(risk_sums, model)), model.weights, prior)
        if best is not None and risk.value > best[0]:
            taken = taken / 2  # too far: half the step, from the best place so far
        elif best is not None and best[0] - risk.value < SETTLED:
            best = (risk.value, model.weights)
            break
        else:
            best, taken = (risk.value, model.weights), risk.step()
        model = Model(first, scale, best[1] - taken)
    return Model(first, scale, np.round(best[1], 9))


def row_total(x: np.ndarray, positive: np.ndarray):
    """The sums over rows at hand."""
    return lambda of: of(x, positive)


def table_total(rows: DataFrame):
    """The sums over a landed table (x, good): per task in numpy, then by place in Spark."""

    def total(of) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)
                    own = of(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                    held = own if held is None else held + own
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.float64()))], ["sums"])

        sums = rows.select("x", "good").mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        return np.array([r["value"] for r in sorted(sums.collect(), key=lambda r: r["at"])])

    return total


def class_prior(unlabelled: np.ndarray, positive: np.ndarray, min_tail: float = MIN_TAIL) -> float:
    """The least ratio of the shares above a threshold, from histograms over ascending scores."""
    tail = lambda h: np.cumsum(h[::-1])[::-1] / max(1, h.sum())
    u, p = tail(unlabelled), tail(positive)
    fit_ = p >= min_tail
    return float(np.clip((u[fit_] / p[fit_]).min(), 0.01, 0.99)) if fit_.any() else 0.5


def held_out(doc_id: Column, folds: int = FOLDS, out: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == out, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, prior) for each row of ``docs``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = columns(batch, "doc_id", "text")
            found = [features(utf8(t)).astype(np.float32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.float32()))], ["doc_id", "x"])

    measured = land(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, x array<float>"), "features")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    train = measured.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = lookup_join(train, good.withColumn("good", F.lit(True)), ["doc_id"])
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    train = land(marked.select("x", F.coalesce("good", F.lit(False)).alias("good"), half.alias("half")), "training")
    counts = train.agg(F.count_if("good").alias("good"), F.count_if(F.col("half") & F.col("good")).alias("half_good"), F.count_if(~F.col("half") & F.col("good")).alias("rest_good")).first()
    spark, prior, model = docs.sparkSession, None, None

    def margins(df: DataFrame, fitted: Model) -> DataFrame:
        packed = spark.sparkContext.broadcast(fitted)

        def score(x: pa.Array) -> pa.Array:
            values = np.array(x.to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
            return pa.array(sigmoid(packed.value.margin(values)))

        return df.withColumn("score", F.arrow_udf(score, "double")("x"))

    if counts.good:
        # one half fits, the other estimates; too few positives for two halves serve both
        parted = counts.half_good and counts.rest_good
        first = fit(table_total(train.where("half") if parted else train), None)
        bins: dict[bool, np.ndarray] = {good: np.zeros(BINS, dtype=np.int64) for good in (False, True)}
        estimating = margins(train.where("NOT half") if parted else train, first)
        for r in estimating.groupBy("good", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect():
            bins[r.good][r.bin] = r["count"]
        prior = class_prior(bins[False] + bins[True], bins[True])
        model = fit(table_total(train), prior)
    scored = margins(measured, model) if model else measured.withColumn("score", F.lit(0.5))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).cast("double").alias("prior"))
