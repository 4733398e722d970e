"""Quality classifier learnt from trusted positives and unlabelled text (PU learning).

A logistic model on bounded shape features of a text minimises the non-negative unbiased risk
``pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)])`` of du Plessis et al. and Kiryo et al. Only
texts known to be good carry a label; all others are unlabelled. The share of good texts ``pi`` is
estimated too, by the best-bin rule: the smallest ratio of unlabelled to positive texts among those
that score highest, with a margin for the size of the sample.

Every optimisation step is one pass over the distributed feature table: tasks send sums of fixed
size (gradient, curvature and risk), never rows. The model is some dozen numbers.

Defined cases: a null text counts as empty and is scored like any; null labels and labels of
unknown documents are ignored; without any positive label every score is the prior's default 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_slices, let_go, small_batches, text_of
from barloom.session import durable

#: Character classes: other, lower, upper, digit, space, line end, stop, comma, mark, bar, symbol.
CLASSES = 11
NAMES = 21


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[ord(" "), ord("\t")]] = 4
    kind[[ord("\n"), ord("\r")]] = 5
    kind[[ord(c) for c in ".?;:"]] = 6
    kind[[ord(c) for c in ",'\"-()"]] = 7
    kind[ord("!")] = 8
    kind[ord("|")] = 9
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 10
    kind[128:] = 1  # bytes of letters beyond ASCII, mostly
    return kind


KIND = _classes()


def features(text: str) -> np.ndarray:
    """Shape of a text: shares of character classes, word lengths, repetition, all in [0, 1]."""
    out = np.zeros(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return out
    kind = KIND[raw]
    counts = np.bincount(kind, minlength=CLASSES)
    words = text.split()
    n, w = len(raw), max(len(words), 1)
    out[:CLASSES] = counts / n
    out[11] = min(n / w / 32, 1.0)
    letters = counts[1] + counts[2]
    out[12] = counts[2] / max(letters, 1)
    out[13] = min((counts[8] + counts[10]) / w, 1.0)
    out[14] = min(counts[9] / w, 1.0)
    out[15] = len(set(words)) / w
    out[16] = sum(map(str.__eq__, words, words[1:])) / w
    joint = kind[1:].astype(np.int64) * CLASSES + kind[:-1]
    pairs = np.bincount(joint, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    out[17] = pairs[10, 10] / n  # symbol after symbol
    out[18] = pairs[2, 2] / n  # capital after capital
    out[19] = pairs[5, 5] / n  # empty lines
    out[20] = min(w / 20, 1.0)  # very short texts
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features with square roots, which tell rare from absent, and a constant."""
    return np.hstack([x, np.sqrt(x), np.ones((len(x), 1))])


WIDTH = 2 * NAMES + 1


def feature_column(text: str | Column = "text") -> Column:
    def run(texts: pa.Array) -> pa.Array:
        let_go()
        rows = [features(t) for t in texts.to_pylist()]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        ends = np.arange(0, len(flat) + 1, NAMES, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64()))

    return F.arrow_udf(in_slices(run), "array<double>")(text_of(text))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(expand(x) @ np.array(self.weights), -500, 500)
        return 1.0 / (1.0 + np.exp(-z))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), NAMES)


def _sums(table: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group (0 unlabelled, 1 positive): rows, loss as +, loss as -, gradient of both losses
    and the curvature, summed over the table."""
    d = WIDTH
    size = 3 + 2 * d + d * d

    def run(batches):
        total = np.zeros((2, size))
        for b in batches:
            x = expand(_matrix(b.column("x")))
            given = b.column("p").to_numpy(zero_copy_only=False).astype(bool)
            z = x @ weights
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            as_pos, as_neg = np.logaddexp(0, -z), np.logaddexp(0, z)
            curve = p * (1 - p)
            for g, m in ((0, ~given), (1, given)):
                xm = x[m]
                total[g, 0] += m.sum()
                total[g, 1] += as_pos[m].sum()
                total[g, 2] += as_neg[m].sum()
                total[g, 3 : 3 + d] += (p[m] - 1) @ xm
                total[g, 3 + d : 3 + 2 * d] += p[m] @ xm
                total[g, 3 + 2 * d :] += ((xm * curve[m, None]).T @ xm).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["g", "s"],
        )

    parts = table.mapInArrow(run, "g int, s array<double>")
    # Adding up happens on the executors: position by position, then one row per group.
    summed = (
        parts.select("g", F.posexplode("s").alias("i", "v"))
        .groupBy("g", "i").agg(F.sum("v").alias("v"))
    )
    out = np.zeros((2, size))
    for r in summed.collect():  # 2 * size numbers, whatever the input
        out[r.g, r.i] = r.v
    return out[0], out[1]


def fit_weights(
    table: DataFrame, prior: float, steps: int = 12, ridge: float = 1e-4, tolerance: float = 1e-5
) -> np.ndarray:
    """Newton steps on the non-negative risk. Where the estimated risk of negatives falls below
    zero, the step is taken against it, as the method asks, instead of along the whole risk."""
    d = WIDTH
    w = np.zeros(d)
    before = np.inf
    stride = 1.0
    last = w
    for _ in range(steps):
        u, p = _sums(table, w)
        if not u[0] or not p[0]:
            return w
        negative = u[2] / u[0] - prior * p[2] / p[0]
        risk = prior * p[1] / p[0] + max(negative, 0.0) + ridge / 2 * w @ w
        if risk > before + 1e-12:  # too long a step: halve it
            stride /= 2
            if stride < 1e-3:
                return last
            w = (w + last) / 2
            continue
        if before - risk < tolerance:
            return w
        grad_neg = u[3 + d : 3 + 2 * d] / u[0] - prior * p[3 + d : 3 + 2 * d] / p[0]
        curve = (u[3 + 2 * d :] / u[0]).reshape(d, d)
        if negative >= 0:
            grad = prior * p[3 : 3 + d] / p[0] + grad_neg + ridge * w
        else:
            grad = -grad_neg + ridge * w
        before, last = risk, w
        w = w - np.linalg.solve(curve + (ridge + 1e-6) * np.eye(d), grad)
        stride = 1.0
    return w


def estimate_prior(table: DataFrame, weights: np.ndarray, bins: int = 512) -> float:
    """Share of positives among unlabelled rows: the least ratio ``share_u / share_p`` over the sets
    of best scores, each with a deviation bound added; sets are cut at ``bins`` score levels."""

    def run(batches):
        h = np.zeros((2, bins), dtype=np.int64)
        for b in batches:
            z = np.clip(expand(_matrix(b.column("x"))) @ weights, -30, 30)
            at = ((z + 30) / 60 * (bins - 1)).astype(int)
            given = b.column("p").to_numpy(zero_copy_only=False).astype(bool)
            h[0] += np.bincount(at[~given], minlength=bins)
            h[1] += np.bincount(at[given], minlength=bins)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([0, 1], bins), pa.int32()),
                pa.array(np.tile(np.arange(bins), 2), pa.int32()),
                pa.array(h.ravel()),
            ],
            names=["g", "i", "n"],
        )

    summed = table.mapInArrow(run, "g int, i int, n bigint").groupBy("g", "i").agg(F.sum("n").alias("n"))
    h = np.zeros((2, bins))
    for r in summed.collect():  # 2 * bins counts
        h[r.g, r.i] = r.n
    if not h[0].sum() or not h[1].sum():
        return 0.5
    above = h[:, ::-1].cumsum(axis=1)
    share_u, share_p = above[0] / h[0].sum(), above[1] / h[1].sum()
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(h[0].sum()) + 1 / np.sqrt(h[1].sum()))
    ok = share_p > max(slack, 0.05)
    best = np.min((share_u[ok] + slack) / share_p[ok]) if ok.any() else 1.0
    return float(np.clip(best, 0.01, 0.99))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    trusted: Column,
    text: str = "text",
    key: str = "doc_id",
    rounds: int = 2,
) -> Model:
    """Learn from all of ``docs``. ``labels`` has the documents' ids; rows of it where ``trusted``
    holds name positives, and no other row of it is used. The prior starts at one half and is
    estimated again after each of ``rounds`` fits.

    The feature table (21 numbers a row) is checkpointed once; each Newton step reads it.
    """
    positives = labels.where(trusted).where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_k"), feature_column(text).alias("x"))
    table = durable(
        rows.join(positives.withColumn("_p", F.lit(True)), "_k", "left").select(
            "x", F.coalesce("_p", F.lit(False)).alias("p")
        )
    )
    prior = 0.5
    weights = np.zeros(WIDTH)
    for _ in range(rounds):
        weights = fit_weights(table, prior)
        if not weights.any():
            break
        prior = estimate_prior(table, weights)
    weights = fit_weights(table, prior) if weights.any() else weights
    return Model(tuple(map(float, weights)), prior)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability that a text is good. Other columns stay."""

    small_batches(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        let_go()
        rows = texts.to_pylist()
        x = np.array([features(t) for t in rows]).reshape(len(rows), NAMES)
        return pa.array(model.score(x), pa.float64())

    return df.withColumn(into, F.arrow_udf(in_slices(run), "double")(text_of(text)))
