"""A text classifier trained in Spark: hashed words and pairs of words, logistic regression, calibration.

A text's features are the buckets of its distinct words and pairs of neighbouring words, all of equal
value and together of length one. Training reads the whole labelled table in each step: a task adds up
the gradient of its rows, Spark adds the tasks' gradients by bucket, and the driver, which holds only
the weights (``BUCKETS`` numbers), makes an accelerated step. The labelled rows are split by a hash of
the text into training, calibration and held-out rows, so copies of a text stay on one side.

Scores come from an expression over the stored weights, without Python, and fit wherever the analysis
takes logits. Texts that are null or hold no word have the bias alone. Rows without a label are left
out; without a row of each class the model knows only the share of ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritape.session import cut, drop_cut

BUCKETS = 4096
STEPS = 40
PENALTY = 1e-4
FOLDS = 10  # by hash: 0 is held out, 1 calibrates, the others train


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """The distinct buckets of a text's words and pairs of words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)

    def terms(w: Column) -> Column:
        return F.concat(w, F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))

    hashed = F.transform(F.transform(F.array(words), terms)[0], lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % n).cast("int"))
    return F.array_distinct(F.filter(hashed, lambda x: x.isNotNull()))  # the last word has no pair


def fold(text: Column) -> Column:
    """A text's part in training, by its hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.coalesce(text, F.lit("")))), 1, 7), 16, 10).cast("int") % FOLDS).cast("int")


@dataclass
class Classifier:
    """Weights by bucket, the bias, and the calibration of the margin: scale and shift."""

    weights: list[float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, text: Column) -> Column:
        w = F.lit(self.weights)
        at = buckets(text, len(self.weights))
        total = F.transform(F.array(at), lambda b: F.try_divide(F.aggregate(b, F.lit(0.0), lambda t, i: t + F.element_at(w, i + 1)), F.sqrt(F.size(b))))[0]
        return F.coalesce(total, F.lit(0.0)) + self.bias

    def logits(self) -> Callable[[Column], Column]:
        """What the analysis takes: text to two logits, whose softmax is the calibrated probability."""
        return lambda text: F.array(F.lit(0.0), self.margin(text) * self.scale + self.shift)

    def probability(self, text: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(self.margin(text) * self.scale + self.shift)))

    def save(self, spark: SparkSession, path: str) -> None:
        named = [(-3, self.shift), (-2, self.scale), (-1, self.bias), *enumerate(self.weights)]
        spark.createDataFrame(named, "bucket int, weight double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        rows = {r.bucket: r.weight for r in spark.read.parquet(path).collect()}  # BUCKETS numbers
        return Classifier([rows[i] for i in range(len(rows) - 3)], rows[-1], rows[-2], rows[-3])


def _gradient(rows: DataFrame, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Sums over (y, at) rows of the gradient of the log loss, by bucket, and for the bias."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, free = np.zeros(len(w)), 0.0
        for batch in batches:
            y, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat = at.flatten().to_numpy(zero_copy_only=False)
            lens = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(len(y)), lens)
            value = 1 / np.sqrt(np.maximum(lens, 1))
            margin = np.bincount(row, w[flat], len(y)) * value + bias
            residual = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
            total += np.bincount(flat, (residual * value)[row], len(w))
            free += residual.sum()
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], free), pa.float64())], names=["bucket", "g"])

    summed = rows.mapInArrow(tasks, "bucket int, g double").groupBy("bucket").agg(F.sum("g").alias("g")).collect()  # one number a bucket
    out, free = np.zeros(len(w)), 0.0
    for r in summed:
        if r.bucket < 0:
            free = r.g
        else:
            out[r.bucket] = r.g
    return out, free


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", n_buckets: int = BUCKETS, steps: int = STEPS, penalty: float = PENALTY) -> Classifier:
    """Train on the training fold of ``labelled`` (label 0 or 1) and calibrate on the calibration fold; the held-out fold isn't read."""
    text = F.col(f"`{text_col}`")
    rows = labelled.select(F.col(f"`{label_col}`").cast("double").alias("y"), buckets(text, n_buckets).alias("at"), fold(text).alias("fold")).where("y is not null and fold > 0")
    held = cut(rows, "labelled")
    train = held.where("fold > 1").select("y", "at")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = (ones + 0.5) / (n + 1)
    w, bias = np.zeros(n_buckets), math.log(share / (1 - share))
    if 0 < ones < n:
        step = 1 / (0.5 + penalty)  # features and the bias have a squared length of two at most, and the loss a curvature of a quarter
        ahead_w, ahead_b, last = w, bias, 1.0
        for _ in range(steps):
            g, free = _gradient(train, ahead_w, ahead_b)
            next_w, next_b = ahead_w - step * (g / n + penalty * ahead_w), ahead_b - step * free / n
            now = (1 + math.sqrt(1 + 4 * last * last)) / 2
            pull = (last - 1) / now
            ahead_w, ahead_b = next_w + pull * (next_w - w), next_b + pull * (next_b - bias)
            w, bias, last = next_w, next_b, now
    model = Classifier([float(x) for x in w], float(bias))
    model.scale, model.shift = _calibrated(held.where("fold = 1"), model)
    drop_cut(held)
    return model


def _calibrated(rows: DataFrame, model: Classifier, steps: int = 8) -> tuple[float, float]:
    """Scale and shift of the margin by Newton steps on the calibration rows: five sums a step. Without rows of both classes they stay 1 and 0."""
    w = F.lit(model.weights)
    m = F.coalesce(F.try_divide(F.aggregate("at", F.lit(0.0), lambda t, i: t + F.element_at(w, i + 1)), F.sqrt(F.size("at"))), F.lit(0.0)) + model.bias
    held = cut(rows.select("y", m.alias("m")), "margins")
    n, ones = held.agg(F.count("*"), F.sum("y")).first()
    a, b = 1.0, 0.0
    if n and 0 < ones < n:
        for _ in range(steps):
            p = 1.0 / (1.0 + F.exp(-(F.col("m") * a + b)))
            curve = p * (1 - p)
            ga, gb, haa, hab, hbb = held.agg(F.sum((p - F.col("y")) * F.col("m")), F.sum(p - F.col("y")), F.sum(curve * F.col("m") ** 2), F.sum(curve * F.col("m")), F.sum(curve)).first()
            ga, haa, hbb = ga + 1e-3 * n * (a - 1), haa + 1e-3 * n, hbb + 1e-9  # a weak pull to a scale of one keeps separable rows finite
            det = haa * hbb - hab * hab
            if det <= 0:
                break
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    drop_cut(held)
    return (float(a), float(b)) if math.isfinite(a) and math.isfinite(b) and a > 0 else (1.0, 0.0)


def evaluate(scored: DataFrame, label_col: str = "label", score_col: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 and brier (the mean squared error of the probability)."""
    y, p = F.col(label_col).cast("double"), F.col(score_col)
    hit = (p >= threshold).cast("double")
    sums = scored.where(y.isNotNull()).agg(
        F.count("*").alias("n"), F.sum(hit * y).alias("tp"), F.sum(hit).alias("said"), F.sum(y).alias("ones"), F.avg((hit == y).cast("double")).alias("accuracy"), F.avg((p - y) ** 2).alias("brier")
    )
    precision, recall = F.try_divide("tp", "said"), F.try_divide("tp", "ones")
    return sums.select("n", "accuracy", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), "brier")
