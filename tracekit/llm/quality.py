"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough to learn from if the
share of positives among the unlabelled, the class prior, is known: the risk
of calling a good text bad is measured on the unlabelled and the positives'
part of it taken off. That difference is a risk and can't be below zero; a
flexible model that has pushed it there has overfitted, and the step then
raises it again (the non-negative unbiased risk).

The model is a small network over measures of a text's surface. It is fitted
on the driver on a bounded sample, and its few weights go with the tasks that
score all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import written
from tracekit.llm._text import SPACE, text_groups, utf8, word_places

SAMPLE = 12_000  # positives, and unlabelled texts, that are fitted on at most
THRESHOLD = 0.7
HIDDEN = 16
STEPS = 1500
SEED = 5

# byte classes that are counted: letters by case, digits, bytes beyond ASCII, and each ASCII mark by itself
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\t"
N_FEATURES = len(MARKS) + 5 + 9


def _byte_shares(data: np.ndarray) -> np.ndarray:
    n = np.bincount(data, minlength=256)
    kinds = [n[0x41:0x5B].sum(), n[0x61:0x7B].sum(), n[0x30:0x3A].sum(), n[0x80:].sum(), n[0x20]]
    return np.sqrt(np.concatenate([n[list(MARKS)], kinds]) / max(1, len(data)))


def _features_of(raw: bytes, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Measures of one text: shares of byte classes, and how long, how varied
    and how repetitive its words are."""
    data = np.frombuffer(raw, np.uint8)
    n = len(hashes)
    out = np.zeros(N_FEATURES)
    out[:len(MARKS) + 5] = _byte_shares(data)
    if n:
        kinds = len(np.unique(hashes))
        pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
        gaps = np.diff(np.append(starts, len(data))).astype(float)
        lines = max(1, raw.count(b"\n") + 1)
        out[len(MARKS) + 5:] = (
            np.log1p(n) / 5, kinds / n, np.log(kinds) / np.log(n) if n > 1 else 1.0,
            float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
            len(np.unique(pairs)) / len(pairs) if n > 1 else 1.0,
            min(gaps.mean(), 50) / 10, min(gaps.std(), 50) / 10, np.log1p(n / lines) / 5,
            np.isin(data[np.maximum(0, starts - 1)], [0x0A]).mean())
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """A row of measures per text; zeros for null and empty texts."""
    out = np.zeros((len(texts), N_FEATURES), np.float64)
    for start, end in text_groups(texts):
        raws = [b"" if t is None else t.encode("utf-8", "replace") for t in texts[start:end]]
        bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        hashes, places, _ = word_places(b" ".join(utf8(t) for t in texts[start:end]), SPACE)
        first = np.searchsorted(places, bounds)
        for k, raw in enumerate(raws):
            a, b = first[k], first[k + 1]
            out[start + k] = _features_of(raw, hashes[a:b], places[a:b] - bounds[k])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        # one row at a time in the same order of sums, whatever rows share the batch
        hidden = np.tanh((z[:, :, None] * self.w1[None]).sum(1) + self.b1)
        return (hidden * self.w2).sum(1) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]

    def forward(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ params[0] + params[1])
        return hidden, hidden @ params[2] + params[3][0]

    sig = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(len(p), size=512)], u[rng.integers(len(u), size=512)]
        (hp, mp), (hu, mu) = forward(xp), forward(xu)
        negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        # gradients by margin of prior * R(positive as 1) and of the negative risk
        as_one, gp, gu = prior * -sig(-mp) / len(mp), -prior * sig(mp) / len(mp), sig(mu) / len(mu)
        if negative < 0:
            as_one, gp, gu = 0 * as_one, -gp, -gu
        grads = [1e-4 * params[0], np.zeros(HIDDEN), 1e-4 * params[2], np.zeros(1)]
        for x, h, g in ((xp, hp, as_one + gp), (xu, hu, gu)):
            back = g[:, None] * params[2] * (1 - h * h)
            grads = [grads[0] + x.T @ back, grads[1] + back.sum(0), grads[2] + h.T @ g, grads[3] + g.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.005 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, *params[:3], float(params[3][0]))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit slope and shift so that scores are the labels' probabilities."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps; a little regularisation keeps separable labels finite
        q = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([(m * (q - y)).sum() + 1e-2 * (a - 1), (q - y).sum() + 1e-2 * b])
        h = np.array([[(m * m * w).sum() + 1e-2, (m * w).sum()], [(m * w).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.slope, model.shift = max(1e-3, float(a)), float(b)
    return model


def _sample(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` of the distinct ids, by hash; all if there are fewer."""
    total = ids.count()
    if total <= n:
        return ids
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return ids.where(unit < n / total)


def _measured(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learnable=None, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """Fit on documents with quality 1 as trusted positives and on documents
    without a label as unlabelled text; the class prior is the estimated
    share of 1 among learnable labels. ``learnable`` is a condition on doc_id.

    At most about ``sample`` documents of either kind are used, chosen by a
    hash of doc_id; calibration uses as many labelled ones. A document with
    contradicting labels counts as 0. Without any labelled or any unlabelled
    document, those of the other kind stand in; None without documents.
    """
    ok = F.lit(True) if learnable is None else learnable
    known = written(labels.where(ok & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
                    .groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality-labels")
    texts = docs.select("doc_id", "text").where(ok & F.col("doc_id").isNotNull())
    free = texts.select("doc_id").join(known, "doc_id", "left_anti")
    picked = _sample(known, 2 * sample, seed).withColumn("quality", F.col("quality").cast("int"))
    picked = picked.unionByName(_sample(free, sample, seed).select("doc_id", F.lit(None).cast("int").alias("quality")))
    picked = written(picked.groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality-sample")
    chosen = texts.join(picked.select("doc_id"), "doc_id", "left_semi")
    rows = _measured(chosen).join(picked, "doc_id").select("quality", "x", F.xxhash64("doc_id", "x").alias("at")).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("at", kind="stable")
    x, y = np.array(rows["x"].tolist()), rows["quality"].to_numpy(float)
    share = known.agg(F.avg("quality")).first()[0]
    positive, unlabelled, labelled = x[y == 1], x[np.isnan(y)], ~np.isnan(y)
    prior = min(0.99, max(0.01, 0.5 if share is None else float(share)))
    if not len(unlabelled):
        unlabelled = x
    if not len(positive):
        positive = unlabelled
    model = fit(positive, unlabelled, prior, seed=seed)
    return calibrate(model, x[labelled], y[labelled]) if len(set(y[labelled])) == 2 else model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with double ``score`` and int ``predicted`` (score at least
    ``threshold``), or these under other ``names``; columns of these names
    are replaced, all others stay.
    Null texts count as empty ones, and an empty text has a score like any
    other; a missing model gives 0.5. One map, no shuffle."""
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            p = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            extra = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(rows, f"{spec}, `{names[0]}` double, `{names[1]}` int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a classifier
    learned from all ``labels`` does not reject."""
    own = ("__quality_score", "__quality")
    return score(docs, train(docs, labels), threshold, own).where(F.col(own[1]) == 1).drop(*own)


def held_out(key: str = "doc_id"):
    """The contract's fold: CRC-32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, learning from the labels of the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
