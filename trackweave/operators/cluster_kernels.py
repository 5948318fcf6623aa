"""Clustering kernels on a bounded group of tracks, each a (points, 3) array; they run inside tasks, one group each."""

from __future__ import annotations

import numpy as np

EPS = 1e-8


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + EPS)


def direction(p: np.ndarray) -> np.ndarray:
    d = p[-1] - p[0]
    n = np.linalg.norm(d)
    return d / n if n >= EPS else np.zeros(3)


def signature(p: np.ndarray) -> np.ndarray:
    """Turn at every inner point."""
    if len(p) < 3:
        return np.zeros(0)
    d = np.diff(p, axis=0)
    a, b = d[:-1], d[1:]
    return np.arccos(np.clip((a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + EPS), -1, 1))


def features(p: np.ndarray) -> np.ndarray:
    s = signature(p)
    return np.concatenate((direction(p), p[0], p[-1], p.mean(axis=0), [s.mean() if len(s) else 0.0, s.std() if len(s) else 0.0, len(p)]))


def mean_shift(tracks: list[np.ndarray], quantile: float = 0.2, rounds: int = 300, least: int = 3, width: float | None = None) -> np.ndarray:
    """Flat-kernel mean shift on standardised features; -1 for tracks in no cluster of ``least``.  Without a ``width`` it comes
    from the ``quantile`` of neighbours."""
    if not tracks:
        return np.zeros(0, dtype=int)
    x = np.array([features(p) for p in tracks])
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    if width is None:
        d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)
        width = max(0.05, float(d[:, max(1, int(len(x) * quantile)) - 1].mean())) if len(x) > 1 else 0.1
    modes = x.copy()
    for _ in range(rounds):
        near = np.linalg.norm(modes[:, None] - x[None], axis=2) <= width
        new = np.array([x[m].mean(axis=0) if m.any() else q for m, q in zip(near, modes, strict=True)])
        if np.abs(new - modes).max() < 1e-3 * width:
            break
        modes = new
    size = (np.linalg.norm(modes[:, None] - x[None], axis=2) <= width).sum(axis=1)
    centres: list[np.ndarray] = []
    for i in np.argsort(-size, kind="stable"):
        if all(np.linalg.norm(modes[i] - c) >= width for c in centres):
            centres.append(modes[i])
    dist = np.linalg.norm(x[:, None] - np.array(centres)[None], axis=2)
    label = np.where(dist.min(axis=1) <= width, dist.argmin(axis=1), -1)
    for c in np.unique(label):
        if c >= 0 and (label == c).sum() < least:
            label[label == c] = -1
    return label
