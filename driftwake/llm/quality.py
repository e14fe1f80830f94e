"""Quality of bulletins from text statistics: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm import tables
from driftwake.llm.words import EXACT, batches_of_words, text_bytes

FEATURES, GAMMA, RIDGE, SEED = 192, 0.15, 1e-2, 20
#: Most labelled texts that the fit reads.
SAMPLE = 40_000
N_STATS = 16
#: Partitions of the sample's statistics, and so of the sums that the driver adds.
SUMS = 8


def statistics(col: pa.Array) -> np.ndarray:
    """Statistics of every text, whole: sizes, character classes, word lengths, repetition, lines."""
    out = []
    for w in batches_of_words(col, EXACT, 1 << 18):
        for i in range(w.lo, w.hi):
            s = w.of(i)
            h, ln = w.hashes[s], (w.ends[s] - w.starts[s])
            out.append((len(h), len(np.unique(h)) / (len(h) + 1), ln.mean() if len(h) else 0, ln.std() if len(h) else 0, ln.max() if len(h) else 0,
                        (h[1:] == h[:-1]).mean() if len(h) > 1 else 0))
    data, off = text_bytes(col)
    rows = []
    for i in range(len(off) - 1):
        c = np.bincount(data[off[i]:off[i + 1]], minlength=256)
        n = c.sum() + 1
        lower, upper, digit = c[97:123].sum(), c[65:91].sum(), c[48:58].sum()
        high, blank = c[128:].sum(), c[32] + c[9:14].sum()
        stop = c[[44, 46]].sum()
        rows.append((np.log1p(n), lower / n, upper / n, digit / n, high / n, blank / n, stop / n, (n - 1 - lower - upper - digit - high - blank - stop) / n, c[124] / n, np.log1p(c[10])))
    a, b = np.array(out, float).reshape(-1, 6), np.array(rows, float).reshape(-1, 10)
    a[:, 0], a[:, 4] = np.log1p(a[:, 0]), np.log1p(a[:, 4])
    return np.hstack([a, b])


class QualityModel:
    """Fitted scales, random frequencies, ridge weights and the calibration's steps; a few tens of kilobytes."""

    def __init__(self, mean, scale):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.x, self.y = np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x: the x of each pool's centre and its mean."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            p = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], p, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit_quality(bulletins: DataFrame, labels: DataFrame, key: str = "incident_id", text: str = "message", label: str = "usable", sample: int = SAMPLE) -> QualityModel:
    """Fits on labelled bulletins; ``labels`` holds key and 0/1. At most ``sample`` of them, chosen by a hash of the key, are read.

    Partitions return sums only: of statistics, then of ZᵀZ and Zᵀy, then labels by score bin. A quarter of the sample is
    kept for the calibration. Null keys and null labels take no part; without any label every score is 0.5.
    """
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).dropna().dropDuplicates(["k"])
    chosen = chosen.orderBy(F.xxhash64("k")).limit(sample)
    d = bulletins.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")

    def sums(batches, f):
        total = None
        for b in batches:
            if b.num_rows:
                s = f(b)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.ravel().tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    def add(f, frame):
        parts = frame.mapInArrow(lambda it: sums(it, f), "v array<double>").collect()
        total = None
        for r in parts:
            v = np.array(r.v)
            total = v if total is None else total + v
        return total

    from driftwake.session import checkpoint

    def to_stats(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"fit": [hash(k) % 4 != 0 for k in b.column(0).to_pylist()], "y": b.column(1), "s": statistics(b.column(2)).tolist()},
                                             schema=pa.schema([("fit", pa.bool_()), ("y", pa.float64()), ("s", pa.list_(pa.float64()))]))

    st = checkpoint(d.mapInArrow(to_stats, "fit boolean, y double, s array<double>")).coalesce(SUMS)
    arr = lambda b: np.array(b.column(2).to_pylist(), float).reshape(-1, N_STATS)
    m = add(lambda b: np.concatenate([[b.num_rows], arr(b).sum(0), (arr(b) ** 2).sum(0)]), st)
    if m is None:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS))
    mean = m[1:1 + N_STATS] / m[0]
    model = QualityModel(mean, np.sqrt(np.maximum(m[1 + N_STATS:] / m[0] - mean**2, 1e-6)))

    def normal(b):
        z, y = model.lift(arr(b)), np.array(b.column(1).to_pylist())
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    n = FEATURES + 1
    a = add(normal, st.filter("fit"))
    if a is not None:
        a = a.reshape(n, n + 1)
        model.weights = np.linalg.solve(a[:, :n] + RIDGE * np.eye(n), a[:, n])

    def bins(b):
        r, y = model.raw(arr(b)), np.array(b.column(1).to_pylist())
        k = np.clip(((r + 0.5) * 250).astype(int), 0, 499)
        return np.stack([np.bincount(k, minlength=500), np.bincount(k, y, 500), np.bincount(k, r, 500)]).astype(float)

    c = add(bins, st.filter("not fit"))
    if c is not None:
        c = c.reshape(3, 500)
        u = c[0] > 0
        model.x, model.y = isotonic(c[2][u] / c[0][u], c[1][u] / c[0][u], c[0][u])
    return model


def score_bulletins(bulletins: DataFrame, model: QualityModel, text: str = "message", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to bulletins; null and empty texts are scored too.

    Rows are scored where they lie; columns of the result's names are replaced; an empty table stays empty.
    """
    shared = tables.Shared(bulletins, model)
    d = bulletins.drop("score")

    def run(batches):
        for b in batches:
            s = shared.value.score(statistics(b.column(b.schema.names.index(text)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score"])

    from pyspark.sql import types as T

    out = d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
