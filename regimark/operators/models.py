"""Models: scaling, thermal score, k-means and diagonal Gaussian mixtures fitted by aggregates, ordering, distillation.

Fits are driver loops over a persisted training table, in which equal rows are one row with their number. Each pass over
it serves all starts, folds and seeds that haven't converged yet: tasks add up what each of them needs, for all fits that
see the same rows at once, and only these sums reach the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_argmax, softmax
from ..sources.ranges import spread
from .stats import quantiles

COMPONENTS = 3
REG = 1e-5
#: Rounds of drawing candidates for starts of k-means, and candidates of a round for each centre.
SEED_ROUNDS, OVERSAMPLED = 3, 4
#: Rows times fits that are worked on at once, tasks of a pass for each core, and bits of a median that a pass finds.
CELLS, TASKS_A_CORE, DIGIT = 1 << 14, 2, 11
# Where the anchored start takes its components, and their weights.
ANCHORS, ANCHOR_WEIGHTS, ANCHOR_SHARE, ANCHOR_LEAST = (0.10, 0.50, 0.90), (0.25, 0.50, 0.25), 0.05, 32


@dataclass
class Scaler:
    """Medians for missing values, means and deviations of a training table."""

    features: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {f"z_{c}": (F.coalesce(F.col(c), F.lit(self.median[c])) - self.mean[c]) / self.std[c] for c in self.features}


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    """Missing values are NULL; an all-missing column has median 0, a constant one deviation 1."""
    m = {c: v or 0.0 for c, v in zip(features, quantiles(train, [(c, 0.5) for c in features]), strict=True)}
    filled = {c: F.coalesce(F.col(c), F.lit(m[c])) for c in features}
    s = train.agg(*[f(x).alias(f"{c}_{k}") for c, x in filled.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    std = {c: (s[f"{c}_s"] if s[f"{c}_s"] is not None and s[f"{c}_s"] >= 1e-9 else 1.0) for c in features}
    return Scaler(features, {c: m[c] for c in features}, {c: s[f"{c}_m"] or 0.0 for c in features}, std)


def thermal_score(weights: dict[str, float], scaler: Scaler) -> Column:
    z, total = scaler.columns(), F.lit(0.0)
    for c, w in weights.items():
        total = total + z[f"z_{c}"] * w
    return total


def _distance2(z: list[str], centre) -> Column:
    total = F.lit(0.0)
    for c, x in zip(z, centre, strict=True):
        total = total + (F.col(c) - float(x)) * (F.col(c) - float(x))
    return total


@dataclass
class Job:
    """One fit among several over the same table: the fold that it leaves out, its own values for missing ones and scale."""

    left_out: int | None = None
    shift: np.ndarray | float = 0.0
    scale: np.ndarray | float = 1.0
    seed: int = 0
    fill: np.ndarray | None = None

    def rows(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        own = x if self.left_out is None else x[fold != self.left_out]
        return ((own if self.fill is None else np.where(np.isnan(own), self.fill, own)) - self.shift) / self.scale

    def counts(self, n: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return n if self.left_out is None else n[fold != self.left_out]

    def view(self) -> tuple:
        """Equal for jobs that see the same rows."""
        return self.left_out, *[None if v is None else np.asarray(v, float).tobytes() for v in (self.shift, self.scale, self.fill)]


def _views(jobs: list[Job]) -> list[list[int]]:
    """Numbers of the jobs that see the same rows."""
    found: dict[tuple, list[int]] = {}
    for j, job in enumerate(jobs):
        found.setdefault(job.view(), []).append(j)
    return list(found.values())


def _columns(points: DataFrame, z: list[str]) -> DataFrame:
    """z, __fold and __n, how many equal rows a row stands for: 1 if the table doesn't tell."""
    return points.select(*z, "__fold", F.col("__n") if "__n" in points.columns else F.lit(1.0).alias("__n"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    *cols, fold, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return np.column_stack(cols), fold, np.asarray(n, float)


def _sums(points: DataFrame, z: list[str], jobs: list[Job], work) -> np.ndarray:
    """A row a job: the sum over its rows of what work gives, in one pass for all.

    work(numbers of jobs that see the same rows, rows, how often each counts) gives a row of sums for each of the jobs.
    """
    views = _views(jobs)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x, fold, n = _arrays(batch)
                for js in views:
                    rows, counts = jobs[js[0]].rows(x, fold), jobs[js[0]].counts(n, fold)
                    step = max(1, CELLS // len(js))
                    for at in range(0, max(len(rows), 1), step):
                        own = work(js, rows[at : at + step], counts[at : at + step])
                        total = np.zeros((len(jobs), own.shape[1])) if total is None else total
                        total[js] += own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    parts = _columns(points, z).mapInArrow(run, "s array<double>").toArrow()["s"]  # a row a task
    added = sum((np.asarray(row) for row in parts.to_pylist()), np.zeros(0 if not len(parts) else len(parts[0].as_py())))
    return added.reshape(len(jobs), -1) if len(parts) else np.zeros((len(jobs), 0))


def _counted(rows: DataFrame, z: list[str]) -> DataFrame:
    """Equal rows of z and __fold as one with their number __n, persisted, dealt to all cores: a small table is much work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return spread(rows.groupBy(*z, "__fold").agg(F.count("*").cast("double").alias("__n")), TASKS_A_CORE * cores, "__fold", *z).persist()


def _points(train: DataFrame, z: list[str], fold: str | None = None) -> DataFrame:
    of = F.col(fold).cast("int") if fold else F.lit(-1)
    return _counted(train.select(*[F.col(c).cast("double").alias(c) for c in z], of.alias("__fold")), z)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(2)


def _nearest(x: np.ndarray, centres: np.ndarray, labelled: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """For rows and fits (centres[fit, k, column]): the nearest centre, the first of equals, and its squared distance."""
    shape = len(x), len(centres)
    label, least = np.zeros(shape, np.int8) if labelled else None, np.full(shape, math.inf)
    far, gap, less = np.empty(shape), np.empty(shape), np.empty(shape, bool)
    for k in range(centres.shape[1]):
        for i in range(x.shape[1]):
            to = gap if i else far
            np.subtract(x[:, i, None], centres[None, :, k, i], out=to)
            np.multiply(to, to, out=to)
            if i:
                np.add(far, gap, out=far)
        if labelled and k:
            np.copyto(label, np.int8(k), where=np.less(far, least, out=less))
        np.minimum(least, far, out=least)
    return label, least


def _padded(centres: list[np.ndarray]) -> np.ndarray:
    """Sets of centres as one array; those that a set lacks are nobody's nearest."""
    out = np.full((len(centres), max(map(len, centres)), centres[0].shape[1]), math.inf)
    for own, c in zip(out, centres, strict=True):
        own[: len(c)] = c
    return out


def _drawn(points: DataFrame, z: list[str], jobs: list[Job], n: int, turn: int, weights) -> list[np.ndarray]:
    """For each job n of its rows without replacement, by chance in proportion to their number times their weight, which
    weights(numbers of jobs that see the same rows, rows) gives as a column a job.

    A row's key is the logarithm of a random number over its weight, and the n largest keys of all rows are the draw;
    tasks give the n largest of theirs. Numbers follow from the job's seed, the turn and the partition.
    """
    views = _views(jobs)

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rngs = [np.random.default_rng((job.seed, turn, TaskContext.get().partitionId())) for job in jobs]
        for batch in batches:
            x, fold, number = _arrays(batch)
            for js in views:
                rows, counts = jobs[js[0]].rows(x, fold), jobs[js[0]].counts(number, fold)
                step, w = max(1, CELLS // len(js)), np.empty((len(js), len(rows)))
                for at in range(0, len(rows), step):
                    w[:, at : at + step] = (weights(js, rows[at : at + step]) * counts[at : at + step, None]).T
                for j, own in zip(js, w, strict=True):
                    with np.errstate(divide="ignore"):
                        keys = np.log(rngs[j].random(len(rows))) / own  # none for a weight of 0
                    keys[own <= 0] = -math.inf
                    most, seen = held.get(j, (keys[:0], rows[:0]))
                    above = np.flatnonzero(keys > (most.min() if len(most) == n else -math.inf))
                    keys, found = np.concatenate([most, keys[above]]), np.concatenate([seen, rows[above]])
                    best = np.argpartition(-keys, n - 1)[:n] if len(keys) > n else np.arange(len(keys))
                    held[j] = keys[best], found[best]
        for j, (keys, rows) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(keys), pa.int32()), pa.array(keys), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["job", "key", "x"])

    drawn = _columns(points, z).mapInArrow(run, "job int, key double, x array<double>")
    best = drawn.withColumn("place", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("key"), "x"))).filter(F.col("place") <= n)
    found: list[list] = [[] for _ in jobs]
    for r in best.orderBy("job", "place").collect():  # n rows a job
        found[r["job"]].append(r["x"])
    return [np.array(x) for x in found]


def _starts(points: DataFrame, z: list[str], jobs: list[Job], k: int, d: int) -> list[np.ndarray]:
    """Starts of k-means from all rows: SEED_ROUNDS times OVERSAMPLED rows are drawn by their squared distance from
    those drawn before, weighed by the rows nearest to them, and clustered on the driver."""
    first = _drawn(points, z, jobs, 1, 0, lambda js, rows: np.ones((len(rows), len(js))))
    if not any(map(len, first)):
        return [np.zeros((k, d)) for _ in jobs]
    found = [c if len(c) else np.zeros((1, d)) for c in first]
    for turn in range(1, SEED_ROUNDS + 1):
        now = _padded(found)
        more = _drawn(points, z, jobs, OVERSAMPLED * k, turn, lambda js, rows, now=now: _nearest(rows, now[js], False)[1])
        found = [np.concatenate([c, m]) if len(m) else c for c, m in zip(found, more, strict=True)]
    every = _padded(found)

    def near(js, rows, n):
        label, _ = _nearest(rows, every[js])
        own = label + np.arange(len(js)) * every.shape[1]
        return np.bincount(own.ravel(), np.repeat(n, len(js)), len(js) * every.shape[1]).reshape(len(js), -1)

    counts = _sums(points, z, jobs, near)
    return [_weighted_centres(c, n[: len(c)], k, job.seed) for c, n, job in zip(found, counts, jobs, strict=True)]


def _weighted_centres(x: np.ndarray, weight: np.ndarray, k: int, seed: int, tries: int = 16) -> np.ndarray:
    """k centres of a few weighted rows, the best of several tries: each next one by chance in proportion to weight and
    squared distance, then ten steps of k-means."""
    rng, found = np.random.default_rng(seed), []
    weight = np.maximum(weight, 1e-9)
    for _ in range(tries):
        centres = x[[rng.choice(len(x), p=weight / weight.sum())]]
        while len(centres) < k:
            d = _squares(x, centres).min(1) * weight
            at = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[at]])
        for _ in range(10):
            own = np.eye(k)[_squares(x, centres).argmin(1)] * weight[:, None]
            centres = np.where(own.sum(0)[:, None] > 0, own.T @ x / np.maximum(own.sum(0), 1e-300)[:, None], centres)
        found.append(((_squares(x, centres).min(1) * weight).sum(), centres))
    return min(found, key=lambda f: f[0])[1]


def _moments(shares: list[np.ndarray], x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row a fit: for each component the sums of its shares of the rows, of these times x and times its square.

    shares[component][row, fit]; n tells how often a row counts.
    """
    d = x.shape[1]
    terms = np.column_stack([np.ones(len(x)), x, x * x]) * n[:, None]
    sums = np.stack([share.T @ terms for share in shares], axis=1)  # fit, component, term
    return np.concatenate([sums[:, :, 0], sums[:, :, 1 : d + 1].reshape(len(sums), -1), sums[:, :, d + 1 :].reshape(len(sums), -1)], axis=1)


def _taken(sums: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.maximum(sums[:k], 1e-10)
    return n, sums[k : k + k * d].reshape(k, d) / n[:, None], sums[k + k * d : k + 2 * k * d].reshape(k, d) / n[:, None]


def kmeans_fits(points: DataFrame, z: list[str], jobs: list[Job], iterations: int = 500, tol: float = 1e-4, k: int = COMPONENTS, begin: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, float, Mixture]]:
    """For each job centres, cost, and the mixture that its clusters are. points: z and __fold; begin: centres to start from.

    A job ends when its centres move by less than tol in all.
    """
    d = len(z)
    centres = _starts(points, z, jobs, k, d) if begin is None else list(begin)
    done: dict[int, tuple] = {}
    for _ in range(iterations):
        live = [j for j in range(len(jobs)) if j not in done]
        now = np.array([centres[j] for j in live])

        def work(js, rows, n, now=now):
            label, least = _nearest(rows, now[js])
            return np.column_stack([_moments([(label == c).astype(float) for c in range(k)], rows, n), n @ least])

        sums = _sums(points, z, [jobs[j] for j in live], work)
        if not sums.size:
            return [(c, 0.0, Mixture(np.full(k, 1 / k), c, np.ones_like(c))) for c in centres]
        for j, own in zip(live, sums, strict=True):
            n, mean, square = _taken(own, k, d)
            mean = np.where(own[:k, None] > 0, mean, centres[j])  # an empty cluster stays where it is
            moved, centres[j] = ((mean - centres[j]) ** 2).sum(), mean
            if moved <= tol:
                done[j] = (mean, own[-1], Mixture(n / own[:k].sum(), mean, np.where(own[:k, None] > 0, np.maximum(square - mean * mean, 0), 1.0) + REG))
        if len(done) == len(jobs):
            break
    return [done.get(j, (centres[j], math.inf, Mixture(np.full(k, 1 / k), centres[j], np.ones_like(centres[j])))) for j in range(len(jobs))]


def kmeans(train: DataFrame, z: list[str], seeds: int = 20, seed: int = 42, iterations: int = 500, k: int = COMPONENTS) -> np.ndarray:
    """Centres of the best of several starts."""
    points = _points(train, z)
    fits = kmeans_fits(points, z, [Job(seed=seed + s) for s in range(seeds)], iterations, k=k)
    points.unpersist()
    return min(fits, key=lambda f: f[1])[0]


def kmeans_posterior(train: DataFrame, z: list[str], centres: np.ndarray) -> list[Column]:
    """Softmax of squared distances over twice the training median of the least."""
    d = [_distance2(z, c) for c in centres]
    t = quantiles(train.select(F.least(*d).alias("__d")), [("__d", 0.5)])[0] or 0.0
    return softmax([-x / (2 * max(t, 1e-3)) for x in d])


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_densities(self, z: list[str]) -> list[Column]:
        out = []
        for w, mu, var in zip(self.weights, self.means, self.variances, strict=True):
            total = F.lit(math.log(max(w, 1e-300)) - 0.5 * float(np.log(2 * np.pi * var).sum()))
            for c, m, v in zip(z, mu, var, strict=True):
                total = total - (F.col(c) - float(m)) * (F.col(c) - float(m)) / (2 * float(v))
            out.append(total)
        return out

    def posterior(self, z: list[str]) -> list[Column]:
        return softmax(self.log_densities(z))


def log_densities(m: Mixture, x: np.ndarray) -> np.ndarray:
    """The same for rows of numbers."""
    start = np.log(np.maximum(m.weights, 1e-300)) - 0.5 * np.log(2 * np.pi * m.variances).sum(1)
    return start - (((x[:, None, :] - m.means[None]) ** 2) / (2 * m.variances[None])).sum(2)


def _responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For rows and fits: each component's share, and the logarithm of the density. Parameters: [fit, component, column]."""
    start = np.log(np.maximum(weights, 1e-300)) - 0.5 * np.log(2 * np.pi * variances).sum(2)
    root = np.sqrt(0.5 / variances)
    shape = len(x), len(weights)
    logs, gap, top = [], np.empty(shape), np.full(shape, -math.inf)
    for k in range(weights.shape[1]):
        total = np.empty(shape)
        total[:] = start[:, k]
        for i in range(x.shape[1]):
            np.subtract(x[:, i, None], means[None, :, k, i], out=gap)
            np.multiply(gap, root[None, :, k, i], out=gap)
            np.multiply(gap, gap, out=gap)
            np.subtract(total, gap, out=total)
        np.maximum(top, total, out=top)
        logs.append(total)
    whole = np.zeros(shape)
    for total in logs:
        np.subtract(total, top, out=total)
        np.exp(total, out=total)
        np.add(whole, total, out=whole)
    for total in logs:
        np.divide(total, whole, out=total)
    return logs, np.add(top, np.log(whole, out=whole), out=top)


def mixture_fits(points: DataFrame, z: list[str], jobs: list[Job], starts: list[Mixture], iterations: int = 500, tol: float = 1e-3) -> list[tuple[Mixture, float]]:
    """Expectation maximisation of each job from its start, with a floor on variances, and its mean log-likelihood.

    A job ends when that changes by less than tol; a warning tells if one didn't within the iterations.
    """
    now, last, done = list(starts), [-math.inf] * len(jobs), set()
    k, d = starts[0].means.shape
    for _ in range(iterations):
        live = [j for j in range(len(jobs)) if j not in done]
        held = [np.array([getattr(now[j], part) for j in live]) for part in ("weights", "means", "variances")]

        def work(js, rows, n, held=held):
            shares, norm = _responsibilities(rows, *[part[js] for part in held])
            return np.column_stack([_moments(shares, rows, n), n @ norm, np.full(len(js), n.sum())])

        sums = _sums(points, z, [jobs[j] for j in live], work)
        if not sums.size:
            return [(m, -math.inf) for m in starts]
        for j, own in zip(live, sums, strict=True):
            n, mean, square = _taken(own, k, d)
            likelihood, rows = own[-2] / max(own[-1], 1), own[-1]
            now[j] = Mixture(n / max(rows, 1), mean, np.maximum(square - mean * mean, 0) + REG)
            if abs(likelihood - last[j]) < tol or not rows:
                done.add(j)
            last[j] = likelihood
        if len(done) == len(jobs):
            break
    else:
        warnings.warn(f"{len(jobs) - len(done)} mixtures not converged to {tol} in {iterations} iterations", stacklevel=2)
    return list(zip(now, last, strict=True))


def fit_mixture(train: DataFrame, z: list[str], start: Mixture, iterations: int = 500, tol: float = 1e-3) -> tuple[Mixture, float]:
    """One mixture from a start, as mixture_fits does."""
    points = _points(train, z)
    out = mixture_fits(points, z, [Job()], [start], iterations, tol)[0]
    points.unpersist()
    return out


def gmm(train: DataFrame, z: list[str], starts: int = 5, seed: int = 42, iterations: int = 500) -> Mixture:
    """The most likely of several mixtures, each begun at the clusters of k-means."""
    points = _points(train, z)
    jobs = [Job(seed=seed + s) for s in range(starts)]
    begun = [m for _, _, m in kmeans_fits(points, z, jobs, 300)]
    fits = mixture_fits(points, z, jobs, begun, iterations)
    points.unpersist()
    return max(fits, key=lambda f: f[1])[0]


# The models and seeds of the out-of-fold runs, and their folds.
RUN_MODELS, RUN_SEEDS, RUN_FOLDS = ("gmm", "kmeans"), (42, 123, 2026), 5


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _valued(code: int) -> float:
    return float(np.uint64(code - (1 << 63) if code >> 63 else ~code & ((1 << 64) - 1)).view(np.float64))


def _medians(points: DataFrame, z: list[str], jobs: list[Job], width: int, values) -> list[list[float | None]]:
    """For each job exact medians, interpolated between neighbours, of `width` columns that values(job's number, rows) makes.

    The bits of the two middle values are found from the highest on, DIGIT in a pass, by counts of what follows the bits
    that are known. Numbers that aren't finite don't count; NULL for a column without others.
    """
    bins, known, ranks = 1 << DIGIT, np.zeros((len(jobs), width, 2), object), None
    for shift in range(64 - DIGIT, -DIGIT, -DIGIT):
        low, size = max(shift, 0), 1 << min(DIGIT, DIGIT + shift)

        def work(js, rows, n, low=low, size=size, known=known):
            out = np.zeros((len(js), width, 2, bins))
            for i, j in enumerate(js):
                for c, x in enumerate(np.ascontiguousarray(values(j, rows).T)):
                    own = np.isfinite(x)
                    code, number = _ordered(x[own]), n[own]
                    for r, prefix in enumerate(known[j, c]):
                        same = slice(None) if shift == 64 - DIGIT else (code >> np.uint64(low)) // np.uint64(size) == np.uint64(prefix)  # noqa: B023
                        out[i, c, r] = np.bincount(((code[same] >> np.uint64(low)) % np.uint64(size)).astype(np.int64), number[same], bins)
            return out.reshape(len(js), -1)

        sums = _sums(points, z, jobs, work)
        if not sums.size:
            return [[None] * width for _ in jobs]
        upto = sums.reshape(len(jobs), width, 2, bins).cumsum(axis=3)
        if ranks is None:
            total = upto[:, :, :, -1]
            ranks = np.stack([(total[:, :, 0] - 1) // 2, total[:, :, 1] // 2], axis=2)  # the two in the middle, or one twice
        digit = np.minimum((upto <= ranks[..., None]).sum(axis=3), size - 1)
        before = np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[..., None], axis=3)[..., 0], 0)
        ranks, known = ranks - before, known * size + digit.astype(object)
    half = lambda low, high: low + (high - low) * 0.5
    return [[half(*map(_valued, known[j, c])) if total[j, c, 0] else None for c in range(width)] for j in range(len(jobs))]


def fold_scalers(frames: DataFrame, features: list[str], fold: str, folds: int = RUN_FOLDS) -> list[Scaler]:
    """For each fold the scaler of all other rows; medians, means and deviations of all folds in a few passes."""
    points = _points(frames.filter(F.col(fold).isNotNull()), features, fold)
    out = _fold_scalers(points, features, folds)
    points.unpersist()
    return out


def _fold_scalers(points: DataFrame, features: list[str], folds: int) -> list[Scaler]:
    d = len(features)
    median = [[v or 0.0 for v in own] for own in _medians(points, features, [Job(k) for k in range(folds)], d, lambda j, rows: rows)]
    jobs = [Job(k, fill=np.array(median[k])) for k in range(folds)]

    def mean_of(power, jobs):
        sums = _sums(points, features, jobs, lambda js, rows, n: np.repeat([[n.sum(), *(n @ rows**power)]], len(js), axis=0))
        return [own[1:] / own[0] if own[0] else None for own in (sums if sums.size else np.zeros((folds, 1 + d)))]

    mean = [np.zeros(d) if m is None else m for m in mean_of(1, jobs)]
    square = mean_of(2, [Job(k, shift=mean[k], fill=jobs[k].fill) for k in range(folds)])
    std = [[1.0] * d if v is None else [float(x) if x >= 1e-9 else 1.0 for x in np.sqrt(v)] for v in square]
    named = lambda values: dict(zip(features, map(float, values), strict=True))
    return [Scaler(features, named(median[k]), named(mean[k]), named(std[k])) for k in range(folds)]


def _fold_scaler_rows(frames: DataFrame, features: list[str], fold: str, scalers: list[Scaler]) -> DataFrame:
    """frames with z_ columns by the scaler of their own fold, which was fitted on the others."""
    by_fold = lambda f: F.element_at(F.array(*[F.lit(float(f(s))) for s in scalers]), F.col(fold).cast("int") + 1)
    z = {f"z_{c}": (F.coalesce(F.col(c), by_fold(lambda s, c=c: s.median[c])) - by_fold(lambda s, c=c: s.mean[c])) / by_fold(lambda s, c=c: s.std[c]) for c in features}
    return frames.withColumns(z)


def out_of_fold(
    frames: DataFrame, features: list[str], fold: str, keep: list[str], models: tuple[str, ...] = RUN_MODELS, seeds: tuple[int, ...] = RUN_SEEDS, folds: int = RUN_FOLDS, starts: dict[str, int] | None = None
) -> DataFrame:
    """model, seed, keep, p_low, p_nominal, p_high, label: each row judged by models that were fitted without its fold.

    Fold k is left out by the fits that judge its rows: features are imputed and scaled by the other folds, fits of
    all folds, models, seeds and starts share their passes, and components are ordered by the mean of the sum of
    scaled features. Ties of a posterior go to the lower state. Rows of a null fold are judged by none.
    """
    starts = {"kmeans": 20, "gmm": 5} if starts is None else starts
    rows = frames.filter(F.col(fold).isNotNull()).withColumn("__fold", F.col(fold).cast("int"))
    points = _points(rows, features, fold)
    scalers = _fold_scalers(points, features, folds)
    vector = lambda s, part: np.array([getattr(s, part)[c] for c in features])
    runs = [(model, seed, k) for model in models for seed in seeds for k in range(folds)]
    begun = [(run, Job(run[2], vector(scalers[run[2]], "mean"), vector(scalers[run[2]], "std"), run[1] + s, vector(scalers[run[2]], "median"))) for run in runs for s in range(starts[run[0]])]
    once = {(job.left_out, job.seed): job for _, job in begun}  # models that begin at the same clusters share them
    clusters = dict(zip(once, kmeans_fits(points, features, list(once.values())), strict=True))
    centres = [clusters[job.left_out, job.seed] for _, job in begun]
    best: dict[tuple, tuple] = {}
    soft = [i for i, (run, _) in enumerate(begun) if run[0] != "kmeans"]
    mixtures = dict(zip(soft, mixture_fits(points, features, [begun[i][1] for i in soft], [centres[i][2] for i in soft]), strict=True)) if soft else {}
    for i, (run, job) in enumerate(begun):
        cost = -mixtures[i][1] if i in mixtures else centres[i][1]
        if run not in best or cost < best[run][0]:
            best[run] = (cost, mixtures[i][0] if i in mixtures else centres[i][0], job)

    hard = [run for run in runs if run[0] == "kmeans"]
    least = lambda j, rows: _nearest(rows, best[hard[j]][1][None], False)[1]
    spread = dict(zip(hard, (m for (m,) in _medians(points, features, [best[run][2] for run in hard], 1, least)), strict=True)) if hard else {}

    def posterior(run, z):
        _, found, _ = best[run]
        logs = -_squares(z, found) / (2 * max(spread[run] or 0.0, 1e-3)) if run[0] == "kmeans" else log_densities(found, z)
        e = np.exp(logs - logs.max(1, keepdims=True, initial=-math.inf))
        return e / e.sum(1, keepdims=True)

    def heat(js, z, n):  # sum of scaled features and rows by label
        out = []
        for j in js:
            label = np.eye(COMPONENTS)[posterior(runs[j], z).argmax(1)] * n[:, None]
            out.append(np.concatenate([label.T @ z.sum(1), label.sum(0)]))
        return np.array(out)

    sums = _sums(points, features, [best[run][2] for run in runs], heat)
    points.unpersist()
    order = {}
    for run, own in zip(runs, sums if sums.size else np.zeros((len(runs), 2 * COMPONENTS)), strict=True):
        n = own[COMPONENTS:]
        order[run] = sorted(range(COMPONENTS), key=lambda c: (n[c] == 0, own[c] / max(n[c], 1), c))  # noqa: B023

    judged = _fold_scaler_rows(rows, features, fold, scalers).select(*keep, "__fold", *[f"z_{c}" for c in features])
    kinds = ", ".join(f"`{c}` {judged.schema[c].dataType.simpleString()}" for c in keep)

    def run_all(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            fold_of = batch.column(at("__fold")).to_numpy(zero_copy_only=False)
            z = np.column_stack([batch.column(at(f"z_{c}")).to_numpy(zero_copy_only=False) for c in features])
            for model in models:
                for seed in seeds:
                    p = np.zeros((len(z), COMPONENTS))
                    for k in range(folds):
                        mine = fold_of == k
                        p[mine] = posterior((model, seed, k), z[mine])[:, order[model, seed, k]] if mine.any() else 0
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model] * n), pa.array([seed] * n, pa.int32()), *[batch.column(at(c)) for c in keep], *[pa.array(p[:, j]) for j in range(COMPONENTS)], pa.array(p.argmax(1).astype(np.int64))],
                        ["model", "seed", *keep, "p_low", "p_nominal", "p_high", "label"],
                    )

    return judged.mapInArrow(run_all, f"model string, seed int, {kinds}, p_low double, p_nominal double, p_high double, label long")


def anchored_start(train: DataFrame, z: list[str], score: str) -> Mixture:
    """Components begun at the mean of the rows around the low, middle and high ranks of a score.

    The ranks' scores come from quantiles, so no global order of the table is made.
    """
    n = train.count()
    width = min(max(ANCHOR_LEAST, round(ANCHOR_SHARE * n)), max(n, 1)) / max(n, 1)
    cuts = [(max(0.0, min(a - width / 2, 1 - width)), min(1.0, max(a + width / 2, width))) for a in ANCHORS]
    q = quantiles(train, [(score, x) for cut in cuts for x in cut])
    near = [F.col(score).between(q[2 * k], q[2 * k + 1]) for k in range(COMPONENTS)]
    row = train.agg(*[F.avg(F.when(near[k], F.col(c))) for k in range(COMPONENTS) for c in z]).first()
    means = np.array([0.0 if x is None else x for x in row], float).reshape(COMPONENTS, len(z))
    return Mixture(np.array(ANCHOR_WEIGHTS), means, np.ones((COMPONENTS, len(z))))


def component_order(train: DataFrame, label: str, score: str, k: int = COMPONENTS) -> list[int]:
    """Components by mean score; empty ones last."""
    means = {r[label]: r["m"] for r in train.groupBy(label).agg(F.avg(score).alias("m")).collect()}  # k rows
    return sorted(range(k), key=lambda c: (means.get(c) is None, means.get(c) or 0.0, c))


def reordered(posterior: list[Column], order: list[int]) -> tuple[list[Column], Column]:
    """Posteriors in a new order, and the label of the largest."""
    p = [posterior[k] for k in order]
    return p, first_argmax(p)


def ranked_groups(groups: DataFrame, score: str, group: str) -> DataFrame:
    """(group, place): place by score from 0, NULL scores last, ties by group. groups has a row a component."""
    return groups.select(group, (F.row_number().over(Window.orderBy(F.col(score).asc_nulls_last(), group)) - 1).alias("place"))


def balanced_weight(train: DataFrame, label: str) -> DataFrame:
    counts = train.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("__t"), F.count("*").alias("__k"))
    w = counts.crossJoin(total).select(F.col(label).alias("__l"), (F.col("__t") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return train.join(F.broadcast(w), F.col(label) == F.col("__l")).drop("__l")


def distil(train: DataFrame, z: list[str], label: str):
    """A multinomial logistic model of the labels with balanced classes and an L2 penalty of one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    weighted = balanced_weight(train.select(*z, F.col(label).cast("double").alias("label")), "label")
    n = max(1, weighted.count())
    v = VectorAssembler(inputCols=z, outputCol="features").transform(weighted)
    return LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / n, standardization=False, maxIter=200).fit(v)


def distil_predict(model, rows: DataFrame, z: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return model.transform(VectorAssembler(inputCols=z, outputCol="features").transform(rows)).drop("features", "rawPrediction")


def class_metrics(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro F1 over the classes that occur."""
    cells = rows.groupBy(F.col(truth).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit("t").alias("side")), F.struct(F.col("p").alias("c"), F.lit("p").alias("side")))).alias("s"), "t", "p", "n")
    per = each.groupBy("s.c").agg(
        F.sum(F.when((F.col("s.side") == "t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("true"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("pred"),
    )
    return per.agg(
        (F.sum("tp") / F.sum("true")).alias("accuracy"),
        F.avg(F.when(F.col("true") > 0, F.col("tp") / F.greatest("true", F.lit(1)))).alias("balanced_accuracy"),
        F.avg(2 * F.col("tp") / F.greatest(F.col("true") + F.col("pred"), F.lit(1))).alias("macro_f1"),
    )
