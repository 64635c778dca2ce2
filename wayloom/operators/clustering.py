"""Clustering of one group's points in memory: k-means, mini-batches, X-means, medoid splits, and linkage of medoids.

Groups are the places of one user, or one window of a user. Whole tables are clustered by
``pyspark.ml``; see ``places.global_kmeans``. Every draw comes from a seed, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..functions.sphere import pairwise

Init = str | np.ndarray | Callable[[np.ndarray, int, np.random.Generator], np.ndarray]


def seed_centres(x: np.ndarray, k: int, rng: np.random.Generator, metric: str = "euclidean") -> np.ndarray:
    """k-means++: each further centre is the best of some candidates drawn by squared distance."""
    tries = 2 + int(math.log(k))
    centres = [x[rng.integers(len(x))]]
    near = pairwise(x, centres[0][None], metric)[:, 0] ** 2
    while len(centres) < k:
        total = near.sum()
        drawn = rng.choice(len(x), tries, p=near / total if total > 0 else None)
        after = np.minimum(near[:, None], pairwise(x, x[drawn], metric) ** 2)
        best = after.sum(0).argmin()
        near = after[:, best]
        centres.append(x[drawn[best]])
    return np.array(centres)


class KMeans:
    """Lloyd's algorithm on Euclidean distance, the best of ``n_init`` starts; the metric is that of seeding only."""

    def __init__(self, k: int = 8, init: Init = "k-means++", n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 0, metric: str = "euclidean"):
        self.k, self.init, self.n_init, self.max_iter, self.tol, self.seed, self.metric = k, init, n_init, max_iter, tol, seed, metric

    def _start(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if callable(self.init):
            return np.asarray(self.init(x, self.k, rng), float)
        if isinstance(self.init, np.ndarray):
            return self.init.astype(float)
        if self.init == "random":
            return x[rng.choice(len(x), self.k, replace=False)]
        return seed_centres(x, self.k, rng, self.metric)

    def fit(self, x: np.ndarray) -> KMeans:
        x = np.asarray(x, float)
        if len(x) < self.k:
            raise ValueError(f"{len(x)} points for {self.k} clusters")
        rng = np.random.default_rng(self.seed)
        limit = self.tol * x.var(0).mean()
        self.inertia = math.inf
        for _ in range(1 if isinstance(self.init, np.ndarray) else self.n_init):
            c = self._start(x, rng)
            for turn in range(1, self.max_iter + 1):
                d = pairwise(x, c, "squared")
                own = d.argmin(1)
                new = c.copy()
                for j in range(self.k):
                    # A centre without members moves to the point worst served.
                    new[j] = x[own == j].mean(0) if (own == j).any() else x[d[np.arange(len(x)), own].argmax()]
                moved, c = ((new - c) ** 2).sum(), new
                if moved <= limit:
                    break
            d = pairwise(x, c, "squared")
            if d.min(1).sum() < self.inertia:
                self.inertia, self.centres, self.labels, self.n_iter = d.min(1).sum(), c, d.argmin(1), turn
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return pairwise(x, self.centres, "squared").argmin(1)

    def transform(self, x: np.ndarray) -> np.ndarray:
        return pairwise(x, self.centres)

    def score(self, x: np.ndarray) -> float:
        return -float(pairwise(x, self.centres, "squared").min(1).sum())

    def fit_predict(self, x: np.ndarray) -> np.ndarray:
        return self.fit(x).labels

    def fit_transform(self, x: np.ndarray) -> np.ndarray:
        return self.fit(x).transform(x)


class MiniBatchKMeans(KMeans):
    """Centres as running means over batches; stops when the smoothed batch inertia no longer falls."""

    def __init__(self, k: int = 8, batch: int = 100, patience: int = 10, reassign: float = 0.01, **kw):
        super().__init__(k, **kw)
        self.batch, self.patience, self.reassign = batch, patience, reassign

    def partial_fit(self, x: np.ndarray) -> MiniBatchKMeans:
        x = np.asarray(x, float)
        if not hasattr(self, "counts"):
            self._rng = np.random.default_rng(self.seed)
            self.centres, self.counts = self._start(x, self._rng).copy(), np.zeros(self.k)
        d = pairwise(x, self.centres, "squared")
        own = d.argmin(1)
        size = np.bincount(own, minlength=self.k)
        total = np.zeros_like(self.centres)
        np.add.at(total, own, x)
        new = self.counts + size
        hit = size > 0
        self.centres[hit] = (self.centres[hit] * self.counts[hit, None] + total[hit]) / new[hit, None]
        self.counts = new
        weak = np.flatnonzero(self.counts < self.reassign * self.counts.max())[: len(x) // 2]
        if len(weak):
            self.centres[weak] = x[self._rng.choice(len(x), len(weak), replace=False)]
            self.counts[weak] = self.counts[self.counts > 0].min()
        self.batch_inertia = d.min(1).sum() / len(x)
        return self

    def fit(self, x: np.ndarray) -> MiniBatchKMeans:
        x = np.asarray(x, float)
        if len(x) < self.k:
            raise ValueError(f"{len(x)} points for {self.k} clusters")
        self.__dict__.pop("counts", None)
        rng = np.random.default_rng(self.seed)
        pace, smooth, best, idle = min(1.0, 2.0 * self.batch / (len(x) + 1)), None, math.inf, 0
        size = min(max(self.batch, self.k), len(x))
        for _ in range(self.max_iter * max(1, len(x) // size)):
            self.partial_fit(x[rng.choice(len(x), size, replace=False)])
            smooth = self.batch_inertia if smooth is None else smooth * (1 - pace) + self.batch_inertia * pace
            best, idle = (smooth, 0) if smooth < best else (best, idle + 1)
            if idle >= self.patience:
                break
        self.labels = self.predict(x)
        self.inertia = -self.score(x)
        return self


def bic(clusters: list[np.ndarray], centres: np.ndarray) -> float:
    """Bayesian information criterion of spherical Gaussians with one variance; larger is better."""
    pairs = list(zip(clusters, centres, strict=False))
    n, k, d = sum(len(c) for c, _ in pairs), len(pairs), np.shape(centres)[1]
    spread = sum(((c - m) ** 2).sum() for c, m in pairs)
    var = (spread / (n - k) if n > k else 0.0) or np.finfo(float).tiny
    ll = sum(len(c) * (math.log(len(c) / n) - d / 2 * math.log(2 * math.pi * var)) - (len(c) - 1) * d / 2 for c, _ in pairs if len(c))
    return ll - k * (d + 1) / 2 * math.log(n)


class XMeans:
    """The number of clusters from k_min to k_max at which no cluster gains by being halved."""

    def __init__(self, k_min: int = 1, k_max: int = 20, seed: int = 0):
        self.k_min, self.k_max, self.seed = max(1, k_min), k_max, seed

    def _halved(self, part: np.ndarray, centre: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> bool:
        if len(part) < 2:
            return False
        way = rng.random(part.shape[1])
        reach = pairwise(centre[None], others).min() if len(others) else pairwise(part, centre[None]).max()
        way *= reach / (np.linalg.norm(way) or 1.0)
        two = KMeans(2, init=np.array([centre + way, centre - way])).fit(part)
        halves = [part[two.labels == j] for j in (0, 1)]
        if not all(map(len, halves)):
            return False
        return bic(halves, two.centres) > bic([part], centre[None])

    def fit(self, x: np.ndarray) -> XMeans:
        x = np.asarray(x, float)
        most = min(self.k_max, len(np.unique(x, axis=0)))
        rng = np.random.default_rng(self.seed)
        k, best = min(self.k_min, most), (-math.inf, None)
        while k <= most:
            m = KMeans(k, seed=self.seed).fit(x)
            parts = [x[m.labels == j] for j in range(k)]
            grown = k + sum(self._halved(p, c, np.delete(m.centres, j, 0), rng) for j, (p, c) in enumerate(zip(parts, m.centres, strict=True)))
            if grown == k:
                # Stable counts compete by the score of all points as one cluster of the first centre.
                best = max(best, (bic([x], m.centres), m), key=lambda b: b[0])
                k += 1
            else:
                k = grown
        self.model = best[1] or KMeans(most, seed=self.seed).fit(x)
        self.labels, self.centres = self.model.labels, self.model.centres
        return self


def medoid(x: np.ndarray, metric: str = "euclidean", rows: int = 2048) -> int:
    """Position of the point with the least sum of distances to all others; the first of equals. Rows of distances go in blocks."""
    sums = np.concatenate([pairwise(x[i : i + rows], x, metric).sum(1) for i in range(0, len(x), rows)])
    return int(sums.argmin())


def bisective(x: np.ndarray, eps: float, metric: str = "euclidean", seed: int = 0) -> np.ndarray:
    """Halves every cluster that has a member farther than eps from its medoid; returns labels."""
    labels, todo, done = np.zeros(len(x), int), [np.arange(len(x))] if len(x) else [], 0
    while todo:
        own = todo.pop()
        part = x[own]
        far = pairwise(part, part[medoid(part, metric)][None], metric).max()
        if far > eps and len(np.unique(part, axis=0)) > 1:
            two = KMeans(2, seed=seed).fit(part).labels
            todo += [own[two == 1], own[two == 0]]
        else:
            labels[own], done = done, done + 1
    return labels


def dispersion(x: np.ndarray, labels: np.ndarray, centres: np.ndarray, metric: str = "euclidean") -> dict[str, float]:
    """Distances (not squared) of members to their centres, and of centres to the centre of all weighted by size."""
    d = pairwise(x, centres, metric)[np.arange(len(x)), labels]
    between = pairwise(centres, x.mean(0)[None], metric)[:, 0] * np.bincount(labels, minlength=len(centres))
    return {"sse": float(d.sum()), "ssb": float(between.sum())}


def single_linkage(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (distance, i, j) in ascending order: the edges of a minimum spanning tree by Prim's method."""
    n = len(d)
    near, via, free = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    free[0] = False
    edges = []
    for _ in range(n - 1):
        j = int(np.where(free, near, np.inf).argmin())
        edges.append((float(near[j]), int(via[j]), j))
        free[j] = False
        closer = d[j] < near
        near, via = np.where(closer, d[j], near), np.where(closer, j, via)
    return sorted(edges)


def flat(edges: list[tuple[float, int, int]], n: int, cut: float) -> np.ndarray:
    """Labels of the groups joined by merges up to the cut, numbered by first member."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for far, i, j in edges:
        if far <= cut:
            root[find(i)] = find(j)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)])


def t_quantile(p: float, df: float) -> float:
    """Student's t by bisection on its distribution, integrated by Simpson's rule."""
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float) -> float:
        # With t = sqrt(df) * tan(a) the density becomes a power of a cosine on a bounded range.
        a = np.linspace(0, math.atan(t / math.sqrt(df)), 2001)
        y = const * math.sqrt(df) * np.cos(a) ** (df - 1)
        return 0.5 + float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (a[1] - a[0]) / 3)

    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return (lo + hi) / 2


def thompson(values: np.ndarray, x: float, alpha: float = 0.05) -> bool:
    """Whether x lies out of the values by twice the modified tau bound."""
    n = len(values)
    if n < 3:
        return False
    t = t_quantile(1 - alpha / 2, n - 2)
    tau = t * (n - 1) / (math.sqrt(n) * math.sqrt(n - 2 + t * t))
    return abs(x - values.mean()) > 2 * tau * values.std()


def chauvenet(values: np.ndarray, x: float) -> bool:
    """Whether x is rarer than half a case among the values."""
    sd = values.std()
    return bool(sd > 0 and math.erfc(abs(x - values.mean()) / sd / math.sqrt(2)) < 1 / (2 * len(values)))


def quartile_range(values: np.ndarray, x: float) -> bool:
    lo, hi = np.percentile(values, [25, 75])
    return not lo - 1.5 * (hi - lo) <= x <= hi + 1.5 * (hi - lo)


def cut_distance(merges: list[float], is_outlier: Callable[[np.ndarray, float], bool] = thompson, min_k: float = math.inf, min_dist: float = 0.0, min_size: int = 3) -> float:
    """Where to cut ascending merge distances: before the first step that stands out; 0 where none does."""
    steps = np.abs(np.diff(merges))
    for i, step in enumerate(steps, start=1):
        wide = merges[i] >= min_dist
        if i > min_k:
            return (merges[0] + merges[1]) / 2
        if wide and i - 1 > min_size and is_outlier(steps[: i - 1], step):
            return merges[i - 1]
        if wide and i <= min_size:
            return merges[i - 1]
    return 0.0


class Tosca:
    """X-means, then single linkage of the medoids in metres, cut where the merges jump; labels follow the input's order."""

    def __init__(self, k_min: int, k_max: int, is_outlier: Callable = thompson, min_dist: float = 50.0, seed: int = 0):
        self.k_min, self.k_max, self.is_outlier, self.min_dist, self.seed = k_min, k_max, is_outlier, min_dist, seed

    def fit(self, x: np.ndarray) -> Tosca:
        x = np.asarray(x, float)
        parts = XMeans(self.k_min, self.k_max, self.seed).fit(x).labels
        parts = np.unique(parts, return_inverse=True)[1]
        heads = np.array([(p := x[parts == j])[medoid(p)] for j in range(parts.max() + 1)])
        edges = single_linkage(pairwise(heads, heads, "spherical"))
        self.cut = cut_distance([e[0] for e in edges], self.is_outlier, self.k_min, self.min_dist)
        self.labels = flat(edges, len(heads), self.cut)[parts]
        self.medoids = np.array([(p := x[self.labels == j])[medoid(p)] for j in range(self.labels.max() + 1)])
        return self
