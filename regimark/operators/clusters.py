"""Cluster quality: silhouette of a sample, Davies-Bouldin, Calinski-Harabasz, confidence, thermal order."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000


def sampled(rows: DataFrame, keys: list[str], n: int = SAMPLE, seed: int = 42) -> DataFrame:
    """n rows, the same for a seed: the least by a hash of their keys. The sample is what is asked for."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def silhouette(sample: DataFrame, z: list[str], label: str, key: str) -> DataFrame:
    """One row: mean silhouette of a sample of bounded size; alone in a cluster counts 0."""
    data = np.array([[*map(float, r[:-1]), r[-1]] for r in sample.select(*z, label).collect()], float)  # SAMPLE rows at most
    shared = sample.sparkSession.sparkContext.broadcast(data)
    labels = sorted({*data[:, -1]}) if len(data) else []

    def run(batches):
        import pandas as pd

        every = shared.value
        sizes = {c: (every[:, -1] == c).sum() for c in labels}
        for pdf in batches:
            x, own = pdf[z].to_numpy(float), pdf[label].to_numpy(float)
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ every[:, :-1].T + (every[:, :-1] ** 2).sum(1), 0))
            sums = np.stack([d[:, every[:, -1] == c].sum(1) for c in labels], 1)
            n = np.array([sizes[c] for c in labels])
            at = np.searchsorted(labels, own)
            rows = np.arange(len(x))
            a = sums[rows, at] / np.maximum(n[at] - 1, 1)
            other = sums / n
            other[rows, at] = np.inf
            b = other.min(1) if len(labels) > 1 else np.zeros(len(x))
            s = np.where((n[at] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pd.DataFrame({"s": s})

    return sample.select(*z, label).mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


def scatter(rows: DataFrame, z: list[str], label: str) -> dict:
    """Calinski-Harabasz and Davies-Bouldin from sums by cluster."""
    sums = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in z], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in z]).collect()
    n = np.array([r["n"] for r in sums], float)
    mu = np.array([[r[f"s_{c}"] for c in z] for r in sums]) / n[:, None]
    within = float(sum(sum(r[f"q_{c}"] for c in z) for r in sums) - (n[:, None] * mu * mu).sum())
    centre = (n[:, None] * mu).sum(0) / n.sum()
    between = float((n * ((mu - centre) ** 2).sum(1)).sum())
    k, total = len(n), n.sum()
    if k < 2:
        return {"davies_bouldin": None, "calinski_harabasz": None}
    centres = {r[label]: m for r, m in zip(sums, mu, strict=True)}
    d = F.lit(None).cast("double")
    for c, m in centres.items():
        dist = F.sqrt(sum(((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(z[1:], m[1:], strict=True)), (F.col(z[0]) - float(m[0])) * (F.col(z[0]) - float(m[0]))))
        d = F.when(F.col(label) == c, dist).otherwise(d)
    spread = {r[label]: r["d"] for r in rows.groupBy(label).agg(F.avg(d).alias("d")).collect()}
    names = list(centres)
    worst = [max((spread[a] + spread[b]) / max(float(np.linalg.norm(centres[a] - centres[b])), 1e-300) for b in names if b != a) for a in names]
    return {"davies_bouldin": float(np.mean(worst)), "calinski_harabasz": between / (k - 1) / max(within / max(total - k, 1), 1e-300)}


def confidence(rows: DataFrame, p: list[str]) -> DataFrame:
    c = F.greatest(*p)
    share = lambda t: F.avg((c >= t).cast("double"))
    return rows.agg(F.avg(c).alias("confidence_mean"), share(0.80).alias("confident_fraction_080"), share(0.95).alias("confident_fraction_095"))


def thermal_order(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: share and mean score of each cluster, whether the means rise, their spread in deviations."""
    mean = [F.avg(F.when(F.col(label) == k, F.col(score))) for k in range(3)]
    out = rows.agg(
        *[F.avg((F.col(label) == k).cast("double")).alias(f"cluster_{k}_fraction") for k in range(3)],
        *[m.alias(n) for m, n in zip(mean, ("thermal_mean_under", "thermal_mean_nominal", "thermal_mean_over"), strict=True)],
        F.stddev_pop(score).alias("sd"),
    )
    means = ("thermal_mean_under", "thermal_mean_nominal", "thermal_mean_over")
    rising = F.lit(True)
    for a, b in pairwise(means):
        rising = rising & F.coalesce(F.col(a) < F.col(b), F.lit(False))
    spread = F.when(F.col("sd") > 1e-9, F.try_divide(F.col(means[2]) - F.col(means[0]), F.col("sd")))
    return out.withColumns({"thermal_monotonic": rising, "extreme_separation_std": spread}).drop("sd")
