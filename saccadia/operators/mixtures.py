"""Many Gaussian mixtures at once: all candidates of a search share every pass over the points.

A pass sends each task the current parameters of all candidates and gets back sums per candidate and component, so a search
over hundreds of (feature set, number of clusters) costs as many jobs as its slowest fit has rounds. A task has a cost per
candidate, so points lie in few tasks, and candidates on the same features are weighed side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of the hash sample that the starting centres come from.
START_ROWS = 2000
#: Fixed value: added to the variances of the standardised features, so that a component on few points keeps a density.
FLOOR = 1e-3
ROUNDS, TOLERANCE = 100, 1e-3
#: Points of a task at least, where there are as many, and points that are weighed at a time.
ROWS_A_TASK, ROWS_AT_ONCE = 2048, 2048
#: Partitions of the sums of a pass: some numbers per candidate, however many points there are.
SUM_PARTS = 4


@dataclass
class Mixture:
    columns: list[int]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float = -np.inf

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every point under every component."""
        return _densities([self])(x[:, self.columns]).T


def _densities(models: Sequence[Mixture]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of points: log(weight * density) under the components of mixtures on the same columns, a row per component."""
    weights, means, covariances = (np.concatenate([getattr(m, name) for m in models]) for name in ("weights", "means", "covariances"))
    (n, p), roots, centre = means.shape, np.linalg.cholesky(covariances), means.mean(0)
    inverse = np.linalg.inv(roots)
    shift = inverse @ (means - centre)[:, :, None]
    level = np.log(np.maximum(weights, 1e-300)) - np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(1) - p * np.log(2 * np.pi) / 2

    def logs(points: np.ndarray) -> np.ndarray:
        off = (inverse.reshape(n * p, p) @ (points - centre).T).reshape(n, p, -1) - shift
        return level[:, None] - np.einsum("kpn,kpn->kn", off, off) / 2

    return logs


def _weighed(models: dict[int, Mixture]) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]]:
    """A function of rows: for every set of columns its points and (candidate, log densities, a row per component)."""
    sets: dict[tuple[int, ...], list[int]] = {}
    for i, m in models.items():
        sets.setdefault(tuple(m.columns), []).append(i)
    logs = {columns: _densities([models[i] for i in members]) for columns, members in sets.items()}

    def weigh(x: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
        for columns, members in sets.items():
            points = x[:, list(columns)]
            ends = np.cumsum([len(models[i].means) for i in members])
            yield points, list(zip(members, np.split(logs[columns](points), ends[:-1])))

    return weigh


def _start(sample: np.ndarray, columns: list[int], k: int, seed: int) -> Mixture:
    """Centres by k-means++ and a few rounds of k-means on the sample."""
    x, rng = sample[:, columns], np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        gap = ((x[:, None] - np.array(centres)) ** 2).sum(2).min(1)
        centres.append(x[rng.choice(len(x), p=gap / gap.sum() if gap.sum() > 0 else None)])
    means = np.array(centres)
    for _ in range(20):
        nearest = ((x[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.array([x[nearest == c].mean(0) if (nearest == c).any() else means[c] for c in range(k)])
    p = len(columns)
    covariances = np.array([np.cov(x[nearest == c].T, bias=True).reshape(p, p) if (nearest == c).sum() > 1 else np.cov(x.T, bias=True).reshape(p, p) for c in range(k)])
    return Mixture(columns, np.maximum(np.bincount(nearest, minlength=k), 1) / len(x), means, covariances + FLOOR * np.eye(p))


def _sums(points: DataFrame, models: dict[int, Mixture], compute) -> dict[int, np.ndarray]:
    """Sum of ``compute(points, [(candidate, log densities)])``, (candidate, array) each, over all blocks of points."""
    rows = ROWS_AT_ONCE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        weigh = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(x), rows):
                weigh = weigh or _weighed(models)
                for own, logs in weigh(x[at:at + rows]):
                    for i, s in compute(own, logs):
                        total[i] = total[i] + s if i in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "s"])

    sums = (points.mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s").alias("at", "s"))
            .repartition(SUM_PARTS, "i", "at").groupBy("i", "at").agg(F.sum("s").alias("s")).toArrow().to_pandas().sort_values(["i", "at"]))
    return {i: s.to_numpy() for i, s in sums.groupby("i")["s"]}


def _expectations(points: np.ndarray, weighed: Sequence[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    n, p = points.shape
    powers = np.concatenate((np.ones((n, 1)), points, (points[:, :, None] * points[:, None, :]).reshape(n, p * p)), axis=1)
    for i, logs in weighed:
        top = logs.max(0)
        share = np.exp(logs - top)
        norm = share.sum(0)
        share /= norm
        sums = share @ powers
        yield i, np.concatenate(([n, (top + np.log(norm)).sum()], sums[:, 0], sums[:, 1:1 + p].ravel(), sums[:, 1 + p:].ravel()))


def _updated(m: Mixture, s: np.ndarray) -> Mixture:
    k, p = m.means.shape
    n, likelihood, size = s[0], s[1] / s[0], np.maximum(s[2:2 + k], 1e-10)
    means = s[2 + k:2 + k + k * p].reshape(k, p) / size[:, None]
    second = s[2 + k + k * p:].reshape(k, p, p) / size[:, None, None]
    spread = second - means[:, :, None] * means[:, None, :]
    floor = np.array([max(FLOOR, 1e-9 * np.abs(b).max()) for b in second])
    for c in range(k):  # cancellation can leave a slightly negative direction
        low = np.linalg.eigvalsh(spread[c])[0]
        spread[c] += (floor[c] + max(0.0, -low)) * np.eye(p)
    return Mixture(m.columns, size / n, means, spread, likelihood)


def fit(df: DataFrame, features: Sequence[str], candidates: Sequence[tuple[Sequence[str], int]], seed: int = 42) -> tuple[DataFrame, list[Mixture]]:
    """(points, one mixture per candidate (features, k)); ``points`` holds the persisted vectors ``v``."""
    features = list(features)
    found = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("v")).persist()
    # Every task pays for all candidates: tables of few rows must not lie in a task per shuffle partition.
    tasks = min(-(-found.count() // ROWS_A_TASK), 4 * df.sparkSession.sparkContext.defaultParallelism)
    points = found.repartition(max(1, tasks)).persist()
    sample = np.array([r["v"] for r in points.orderBy(F.xxhash64("v")).limit(START_ROWS).collect()])
    found.unpersist()
    models = {i: _start(sample, [features.index(f) for f in names], k, seed) for i, (names, k) in enumerate(candidates)}
    done: dict[int, Mixture] = {}
    for _ in range(ROUNDS):
        for i, s in _sums(points, models, _expectations).items():
            new = _updated(models[i], s)
            if abs(new.likelihood - models[i].likelihood) < TOLERANCE:
                done[i] = new
                del models[i]
            else:
                models[i] = new
        if not models:
            break
    return points, [done.get(i) or models[i] for i in range(len(candidates))]


def squared_silhouettes(points: DataFrame, models: Sequence[Mixture]) -> list[tuple[int, float | None]]:
    """(clusters used, mean silhouette on squared distances) of every mixture, in two passes over the points."""
    every = dict(enumerate(models))

    def moments(points: np.ndarray, weighed: Sequence[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        square = (points * points).sum(1)
        for i, logs in weighed:
            near = np.eye(len(logs))[logs.argmax(0)]
            yield i, np.concatenate((near.sum(0), near.T @ square, (near.T @ points).ravel()))

    found = _sums(points, every, moments)
    parts = [(s[:k], s[k:2 * k], s[2 * k:].reshape(k, -1)) for s, k in ((found[i], len(m.means)) for i, m in enumerate(models))]

    def scores(points: np.ndarray, weighed: Sequence[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        length, row = (points * points).sum(1), np.arange(len(points))
        for i, logs in weighed:
            (n, square, total), label = parts[i], logs.argmax(0)
            size = np.maximum(n, 1)
            far = length[:, None] + square / size - 2 * points @ (total / size[:, None]).T
            own = far[row, label] * n[label] / np.maximum(n[label] - 1, 1)
            others = np.where(n > 0, far, np.inf)
            others[row, label] = np.inf
            other = others.min(1)
            wider = np.maximum(own, other)
            with np.errstate(invalid="ignore"):
                score = np.where((n[label] == 1) | (wider <= 0), 0.0, (other - own) / wider)
            yield i, np.array([np.nan_to_num(score).sum(), len(points)])

    sums = _sums(points, every, scores)
    return [(int((n > 0).sum()), float(sums[i][0] / sums[i][1]) if (n > 0).sum() > 1 else None) for i, (n, _, _) in enumerate(parts)]
