"""Plain forms of the likeness of two tracks and of the spectral clusterings, one group in memory."""

import numpy as np

from trackweave.operators.cluster_kernels import EPS, direction, signature, unit
from trackweave.operators.kernels import lerp


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation; 0 where it isn't defined."""
    if len(a) < 2 or a.std() < 1e-15 or b.std() < 1e-15:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def curvature_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = signature(a), signature(b)
    n = min(len(x), len(y))
    if n < 2:
        return 0.0
    r = pearson(lerp(x[:, None], n)[:, 0], lerp(y[:, None], n)[:, 0])
    return max(0.0, (r + 1) / 2)


def spatial_similarity(a: np.ndarray, b: np.ndarray, scale: float = 100.0) -> float:
    """exp(-mean distance / scale) at evenly picked points."""
    n = min(len(a), len(b))
    pick = lambda p: p[np.linspace(0, len(p) - 1, n).astype(int)]
    return float(np.exp(-np.linalg.norm(pick(a) - pick(b), axis=1).mean() / scale)) if n else 0.0


def shape_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean of the positive likeness of step directions, centred and scaled."""
    n = min(len(a), len(b)) - 1
    if n < 1:
        return 0.0
    norm = lambda p: (p - p.mean(axis=0)) / (np.linalg.norm(p - p.mean(axis=0), axis=1).max() + EPS)
    x, y = unit(np.diff(norm(a), axis=0))[:n], unit(np.diff(norm(b), axis=0))[:n]
    return float(np.maximum(0, ((x * y).sum(axis=1) + 1) / 2).mean())


def polar_similarity(a: np.ndarray, b: np.ndarray) -> float:
    return 0.5 * curvature_similarity(a, b) + 0.3 * shape_similarity(a, b) + 0.2 * max(0.0, float((direction(a) @ direction(b) + 1) / 2))


def multiscale_affinity(a: np.ndarray, b: np.ndarray, scales: int = 3) -> float:
    """0.6 mean correlation of smoothed signatures + 0.4 exp(-distance / 100) of resampled tracks."""
    x, y = signature(a), signature(b)
    found = []
    for w in range(1, scales + 1):
        if min(len(x), len(y)) >= w + 2:
            p, q = np.convolve(x, np.ones(w) / w, "valid"), np.convolve(y, np.ones(w) / w, "valid")
            n = min(len(p), len(q))
            found.append(max(0.0, (pearson(p[:n], q[:n]) + 1) / 2))
    n = min(60, max(2, min(len(a), len(b))))
    near = float(np.exp(-np.linalg.norm(lerp(a, n) - lerp(b, n), axis=1).mean() / 100))
    return 0.6 * (float(np.mean(found)) if found else 0.0) + 0.4 * near


def matrix(tracks: list[np.ndarray], like, threshold: float = 0.0) -> np.ndarray:
    out = np.eye(len(tracks))
    for i in range(len(tracks)):
        for j in range(i + 1, len(tracks)):
            s = like(tracks[i], tracks[j])
            out[i, j] = out[j, i] = s if s >= threshold else 0.0
    return out


def mutual(a: np.ndarray, k: int) -> np.ndarray:
    """Only pairs of which each is among the other's ``k`` most similar."""
    order = np.argsort(-a - np.eye(len(a)) * -1e9, axis=1, kind="stable")[:, :k]
    near = np.zeros_like(a, dtype=bool)
    np.put_along_axis(near, order, True, axis=1)
    return np.where((near & near.T) | np.eye(len(a), dtype=bool), a, 0.0)


def laplacian(a: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(a.sum(axis=1), EPS))
    return np.eye(len(a)) - a * d[:, None] * d[None, :]


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, starts: int = 5) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), dtype=int))
    for _ in range(starts):
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack((c, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x)))]))
        for _ in range(rounds):
            label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[label]) ** 2).sum()
        if cost < best[0]:
            best = (cost, label)
    return best[1]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    score = np.zeros(len(x))
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() > 1 and own.sum() < len(x):
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, label == c].mean() for c in np.unique(label) if c != label[i])
            score[i] = (b - a) / max(a, b, EPS)
    return float(score.mean())


def spectral(tracks: list[np.ndarray], threshold: float = 0.5, most: int = 10) -> np.ndarray:
    """Labels by the eigengap of the affinity's Laplacian and k-means on its first eigenvectors."""
    n = len(tracks)
    if n < 2:
        return np.zeros(n, dtype=int)
    values, vectors = np.linalg.eigh(laplacian(matrix(tracks, polar_similarity, threshold)))
    k = int(min(most, max(1, np.argmax(np.diff(values[: min(n, 11)])) + 1)))
    return kmeans(unit(vectors[:, :k]), k) if k > 1 else np.zeros(n, dtype=int)


def laplacian_clusters(tracks: list[np.ndarray], neighbours: int = 10, parts: int = 10) -> np.ndarray:
    """Labels by k-means on the embedding of the mutual-neighbour affinity; k by the best silhouette."""
    n = len(tracks)
    if n < 3:
        return np.zeros(n, dtype=int)
    _, vectors = np.linalg.eigh(laplacian(mutual(matrix(tracks, multiscale_affinity), neighbours)))
    x = vectors[:, : min(parts, n - 1)]
    tried = [(silhouette(x, label := kmeans(x, k)), -k, label) for k in range(2, min(15, n))]
    return max(tried, key=lambda t: t[:2])[2] if tried else np.zeros(n, dtype=int)
