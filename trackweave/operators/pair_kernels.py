"""Likeness of tracks, block against block: matrices from stacked arrays instead of a call for each pair.

A pair is measured at the length of its shorter track.  The tracks of one length meet all longer ones at once, brought to that length
together, so that correlations and step directions are matrix products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .cluster_kernels import EPS, direction, signature, unit

#: Scale of the distances, points of a resampled pair at most, and distances that are worked on at once.
SCALE, MOST, AT_ONCE = 100.0, 60, 32_768


def _standard(rows: np.ndarray) -> np.ndarray:
    """Rows less their mean, brought to length 1; zeros for a row that doesn't vary, or of one value."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    size = np.linalg.norm(centred, axis=1, keepdims=True)
    still = (rows.std(axis=1, keepdims=True) < 1e-15) | (rows.shape[1] < 2)
    return np.where(still, 0.0, centred / np.where(size > 0, size, 1.0))


class Rows:
    """Sequences one after the other: their lengths, starts, and a flat array for each column."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = np.array([len(r) for r in rows], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        flat = np.concatenate(rows) if rows else np.zeros(0)
        self.columns = [np.ascontiguousarray(c) for c in (flat.T if flat.ndim > 1 else [flat])]

    def picked(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """Every column at ``n`` evenly picked places, rounded down, of each of ``rows``, as (place, row)."""
        size = self.n[rows]
        at = np.floor(np.arange(n)[:, None] * ((size - 1) / max(1, n - 1))).astype(np.int64)
        if n > 1:
            at[-1] = size - 1
        return [c[self.start[rows] + at] for c in self.columns]

    def lerped(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """Every column at ``n`` even places, interpolated, of each of ``rows``, as (place, row)."""
        size = self.n[rows]
        at = np.arange(n)[:, None] * ((size - 1) / max(1, n - 1))
        low = np.clip(np.floor(at).astype(np.int64), 0, np.maximum(size - 2, 0))
        part, low, high = at - low, self.start[rows] + low, self.start[rows] + np.minimum(low + 1, size - 1)
        return [c[low] + part * (c[high] - c[low]) for c in self.columns]


def _by_length(a: np.ndarray, b: np.ndarray, fill: Callable[[int, bool, np.ndarray, np.ndarray], np.ndarray], least: int) -> np.ndarray:
    """``fill(n, turned, rows, rows)`` for every pair by the length of its shorter one, whose side comes first, so turned if that is b;
    zeros for pairs shorter than ``least``."""
    out = np.zeros((len(a), len(b)))
    for n in np.unique(np.concatenate((a, b))):
        if n < least:
            continue
        (i, j), (p, q) = (np.flatnonzero(s == n) for s in (a, b)), (np.flatnonzero(s > n) for s in (a, b))
        right = np.concatenate((j, q))
        if len(i) and len(right):
            out[np.ix_(i, right)] = fill(int(n), False, i, right)
        if len(j) and len(p):
            out[np.ix_(p, j)] = fill(int(n), True, j, p).T
    return out


def _distance(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Mean distance of the points of every two tracks, columns as (place, track); a few thousand distances are worked on at once."""
    n, count = p[0].shape
    out = np.zeros((count, q[0].shape[1]))
    wide = max(1, AT_ONCE // n)
    for first in range(0, out.shape[1], wide):
        part = slice(first, first + wide)
        cross = [np.ascontiguousarray(c[:, part]) for c in q]
        for i in range(count):
            total = None
            for line, at in zip(p, cross, strict=True):
                step = at - line[:, [i]]
                step *= step
                total = step if total is None else np.add(total, step, out=total)
            out[i, part] = np.sqrt(total, out=total).sum(axis=0) / n
    return out


def _turns(tracks: list[np.ndarray]) -> list[np.ndarray]:
    return [signature(p) for p in tracks]


def curvature(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(r + 1) / 2 of the turns at inner points, at the shorter track's number of them."""
    sides = [Rows(_turns(side)) for side in (a, b)]

    def fill(n: int, turned: bool, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = (_standard(side.lerped(rows, n)[0].T) for side, rows in zip(sides[::-1] if turned else sides, (x, y), strict=True))
        return (p @ q.T + 1) / 2

    return np.maximum(0.0, _by_length(sides[0].n, sides[1].n, fill, 2))


def spatial(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    sides = [Rows(side) for side in (a, b)]

    def fill(n: int, turned: bool, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-_distance(*(side.picked(rows, n) for side, rows in zip(sides[::-1] if turned else sides, (x, y), strict=True))) / SCALE)

    return _by_length(sides[0].n, sides[1].n, fill, 1)


def shape(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Mean likeness of step directions over the shorter track's steps, centred and scaled."""

    def steps(p: np.ndarray) -> np.ndarray:
        c = p - p.mean(axis=0)
        return unit(np.diff(c / (np.linalg.norm(c, axis=1).max() + EPS), axis=0))

    size = [np.array([len(p) - 1 for p in side]) for side in (a, b)]
    n = np.minimum(size[0][:, None], size[1])
    wide = max(1, int(max((s.max() for s in size if len(s)), default=1)))
    flat = []
    for side in (a, b):
        rows = np.zeros((len(side), 3 * wide))
        for k, p in enumerate(side):
            if len(p) > 1:
                s = steps(p).ravel()
                rows[k, : len(s)] = s
        flat.append(rows)
    return np.where(n < 1, 0.0, (flat[0] @ flat[1].T / np.maximum(1, n) + 1) / 2)


def _mixed(a: list[np.ndarray], b: list[np.ndarray], turns: np.ndarray, steps: np.ndarray) -> np.ndarray:
    d = [np.array([direction(p) for p in side]).reshape(-1, 3) for side in (a, b)]
    return 0.5 * turns + 0.3 * steps + 0.2 * np.maximum(0.0, (d[0] @ d[1].T + 1) / 2)


def polar(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return _mixed(a, b, curvature(a, b), shape(a, b))


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def multiscale(a: list[np.ndarray], b: list[np.ndarray], scales: int = 3) -> np.ndarray:
    """0.6 mean correlation of smoothed turns over the shorter track's ones + 0.4 exp(-distance / 100) of resampled tracks."""
    turns = [_turns(side) for side in (a, b)]
    total, count = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for w in range(1, scales + 1):
        smooth = [[np.convolve(s, np.ones(w) / w, "valid") if len(s) >= w + 2 else np.zeros(0) for s in side] for side in turns]
        size, flat = [np.array([len(s) for s in side], dtype=int) for side in smooth], [_padded(side) for side in smooth]

        def correlated(n: int, turned: bool, x: np.ndarray, y: np.ndarray, flat: list[np.ndarray] = flat) -> np.ndarray:
            p, q = (_standard(side[rows, :n]) for side, rows in zip(flat[::-1] if turned else flat, (x, y), strict=True))
            return (p @ q.T + 1) / 2

        there = (size[0] > 0)[:, None] & (size[1] > 0)
        total += np.where(there, np.maximum(0.0, _by_length(*size, correlated, 1)), 0.0)
        count += there
    sides = [Rows(side) for side in (a, b)]

    def near(n: int, turned: bool, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-_distance(*(side.lerped(rows, n) for side, rows in zip(sides[::-1] if turned else sides, (x, y), strict=True))) / SCALE)

    return 0.6 * total / np.maximum(1, count) + 0.4 * _by_length(*(np.clip(side.n, 2, MOST) for side in sides), near, 1)


def measured(a: list[np.ndarray], b: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All ``MEASURES`` by name, each worked out once."""
    turns, steps = curvature(a, b), shape(a, b)
    return {"curvature": turns, "spatial": spatial(a, b), "shape": steps, "polar": _mixed(a, b, turns, steps), "multiscale": multiscale(a, b)}


MEASURES: dict[str, Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]] = {"curvature": curvature, "spatial": spatial, "shape": shape, "polar": polar, "multiscale": multiscale}
