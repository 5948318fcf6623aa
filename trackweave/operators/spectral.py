"""Spectral clustering of groups of any size, all groups together.

Tracks lie in blocks of ``BLOCK``; the affinity is a table of pairs of blocks, each a list of (row, column, likeness), and a product with
vectors is a join of the pairs with the vectors' blocks.  Eigenvectors come from a block Krylov space: products are made orthogonal to the
ones before by small matrices, one for each group, and the last projection gives eigenvalues and vectors.  k-means and silhouettes
work on blocks of the embedding.  No task holds more than two blocks, or a group's small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.lineage import cut
from trackweave.functions.ranks import placed

from . import pair_kernels as pk
from .cluster_kernels import EPS, unit
from .lines import packed

#: Tracks in a block, vectors multiplied at once, and products.
BLOCK, WIDE, STEPS = 400, 12, 16
#: Accepted residual of an eigenvector, and new beginnings at most.
RESIDUAL, RESTARTS = 1e-4, 30
PAIR = "gid long, left long, right long, n_left int, n_right int, r binary, c binary, v binary"
VECTOR = "gid long, block long, v binary"
STARTS, ROUNDS = 5, 100
#: Rows of a block among which first centres are drawn.
DRAWN = 64


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.float64).tobytes()


def _array(raw: bytes, columns: int = 1) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, columns) if columns > 1 else np.frombuffer(raw)


def dealt(points: DataFrame, group: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(gid, track_id, place, block, at, xs, ys, zs), places by track_id, and (gid, group, n, parts)."""
    tracks = placed(packed(points, group), group, "track_id")
    sizes = tracks.groupBy(group).agg(F.count("*").alias("n")).withColumn("one", F.lit(0))
    sizes = cut(placed(sizes, "one", group).select(F.col("__place").alias("gid"), group, "n", F.ceil(F.col("n") / block).alias("parts")))
    named = tracks.join(sizes.select("gid", F.col(group).alias("__g")), F.col(group).eqNullSafe(F.col("__g")))
    return cut(named.select("gid", "track_id", F.col("__place").alias("place"), F.floor(F.col("__place") / block).alias("block"), (F.col("__place") % block).alias("at"), "xs", "ys", "zs")), sizes


def _pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every row of a block once for every block of its group, as one of the pair (left, right)."""
    out = rows.join(sizes.select("gid", "parts"), "gid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return out.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other", "parts")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    left, right = pdf["left"].iloc[0], pdf["right"].iloc[0]
    pdf = pdf.sort_values("at")
    return pdf[pdf["block"] == left], pdf[pdf["block"] == right]


def _tracks(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.column_stack(t) for t in zip(pdf["xs"], pdf["ys"], pdf["zs"], strict=True)]


def _row(pdf: pd.DataFrame, n: tuple[int, int], s: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(s)
    first = {k: pdf[k].iloc[:1].to_numpy() for k in ("gid", "left", "right")}
    return pd.DataFrame({**first, "n_left": n[0], "n_right": n[1], "r": [r.astype(np.int32).tobytes()], "c": [c.astype(np.int32).tobytes()], "v": [_bytes(s[r, c])]})


def affinity(tracks: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Polar likeness of at least ``threshold`` between different tracks, as pairs of blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = map(_tracks, _sides(pdf))
        s = pk.polar(a, b)
        s[s < threshold] = 0.0
        if pdf["left"].iloc[0] == pdf["right"].iloc[0]:
            np.fill_diagonal(s, 0.0)
        return _row(pdf, s.shape, s)

    return cut(_pairs(tracks, sizes).groupBy("gid", "left", "right").applyInPandas(run, PAIR))


def nearest(tracks: DataFrame, sizes: DataFrame, most: int, measure: Callable = pk.multiscale) -> DataFrame:
    """(gid, i, j, s): each track's ``most`` likest others, ties to the earlier one; i and j are places in the group.

    Pairs of blocks keep each track's best ones, then each track's bests of all blocks are ranked; exact for any size.
    """

    def best(s: np.ndarray, own: int, other: int) -> pd.DataFrame:
        k = min(most, s.shape[1])
        j = np.argsort(-s, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(s)), k)
        return pd.DataFrame({"i": own + i, "j": other + j.ravel(), "s": s[i, j.ravel()]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        s = measure(_tracks(left), _tracks(right))
        a, b = int(left["place"].iloc[0]), int(right["place"].iloc[0])
        if a == b:
            np.fill_diagonal(s, -np.inf)
        found = best(s, a, b)
        if a != b:
            found = pd.concat((found, best(s.T, b, a)))
        found = found[np.isfinite(found["s"])]
        return found.assign(gid=pdf["gid"].iloc[0])[["gid", "i", "j", "s"]]

    met = _pairs(tracks, sizes).groupBy("gid", "left", "right").applyInPandas(run, "gid long, i long, j long, s double")
    ranked = met.groupBy("gid", "i").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), "j"))), 1, most).alias("b"))
    return cut(ranked.select("gid", "i", F.inline("b")).select("gid", "i", "j", (-F.col("m")).alias("s")))


def mutual(near: DataFrame, block: int = BLOCK) -> DataFrame:
    """The links of which each end is among the other's nearest, as pairs of blocks."""
    back = near.select("gid", F.col("j").alias("i"), F.col("i").alias("j"))
    both = near.join(back, ["gid", "i", "j"]).where("i < j and s != 0")
    both = both.select("gid", F.floor(F.col("i") / block).alias("left"), F.floor(F.col("j") / block).alias("right"), (F.col("i") % block).alias("r"), (F.col("j") % block).alias("c"), "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        r, c, v = (pdf[k].to_numpy() for k in ("r", "c", "s"))
        if pdf["left"].iloc[0] == pdf["right"].iloc[0]:
            r, c, v = np.concatenate((r, c)), np.concatenate((c, r)), np.concatenate((v, v))
        first = {k: pdf[k].iloc[:1].to_numpy() for k in ("gid", "left", "right")}
        return pd.DataFrame({**first, "n_left": block, "n_right": block, "r": [r.astype(np.int32).tobytes()], "c": [c.astype(np.int32).tobytes()], "v": [_bytes(v)]})

    return cut(both.groupBy("gid", "left", "right").applyInPandas(run, PAIR))


def _dense(row, n_left: int, n_right: int) -> np.ndarray:
    out = np.zeros((n_left, n_right))
    out[np.frombuffer(row.r, dtype=np.int32), np.frombuffer(row.c, dtype=np.int32)] = np.frombuffer(row.v)
    return out


def _added(parts: DataFrame) -> DataFrame:
    """Sums of vectors (gid, block, v) by block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gid": pdf["gid"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "v": [_bytes(reduce(np.add, map(_array, pdf["v"])))]})

    return parts.groupBy("gid", "block").applyInPandas(run, VECTOR)


def product(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(gid, block, v): the sums of the pairs' likenesses times the vectors (gid, block, n, q), in each block's rows."""

    def times(mine: str, turned: bool) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    q = _array(r.q).reshape(r.n, -1)
                    s = _dense(r, *((r.n, r.m) if turned else (r.m, r.n)))
                    out.append(_bytes((s.T if turned else s) @ q))
                yield pd.DataFrame({"gid": pdf["gid"], "block": pdf[mine], "v": out})

        return run

    own = vectors.select("gid", F.col("block").alias("b"), F.col("n").alias("m"))
    other = vectors.select("gid", F.col("block").alias("o"), "n", "q")
    columns = ("gid", "left", "right", "r", "c", "v", "n", "m", "q")
    side = lambda mine, far: pairs.withColumns({"b": F.col(mine), "o": F.col(far)}).join(own, ["gid", "b"]).join(other, ["gid", "o"]).select(*columns)
    down = side("left", "right").mapInPandas(times("left", False), VECTOR)
    up = side("right", "left").where(F.col("left") != F.col("right")).mapInPandas(times("right", True), VECTOR)
    return _added(down.unionByName(up))


def _small(rows: DataFrame, gram: Callable, solve: Callable, schema: str) -> DataFrame:
    """``gram`` of each block's row, added up by group, through ``solve``: one task a group, on small matrices."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"gid": pdf["gid"], "g": [_bytes(gram(r)) for r in pdf.itertuples(index=False)]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gid": pdf["gid"].iloc[:1].to_numpy(), **{k: [v] for k, v in solve(reduce(np.add, map(_array, pdf["g"]))).items()}})

    return cut(rows.mapInPandas(partial, "gid long, g binary").groupBy("gid").applyInPandas(run, schema))


def eigenvectors(pairs: DataFrame, tracks: DataFrame, most: int = 11, steps: int = STEPS, wide: int = WIDE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(gid, values) and (gid, block, n, q): the ``most`` smallest eigenvalues and vectors of each group's normalised Laplacian
    I - D^-1/2 (S + I) D^-1/2, by Rayleigh-Ritz on a Krylov space of ``steps`` products with ``wide`` vectors, begun again from its best
    vectors until every group's residuals are below ``RESIDUAL`` (eigenvalues are then right to about its square)."""
    if not most < wide:
        raise ValueError("more vectors have to be multiplied than are wanted")
    blocks = tracks.groupBy("gid", "block").agg(F.count("*").cast("int").alias("n"))
    steps = min(steps, -(-(tracks.groupBy("gid").count().agg(F.max("count")).first()[0] or 0) // wide))

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(q=[_bytes(np.ones(n)) for n in pdf["n"]])

    start = cut(blocks.mapInPandas(ones, "gid long, block long, n int, q binary"))
    degree = product(pairs, start)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [1 / np.sqrt(np.maximum(1 + (_array(v) if v is not None else np.zeros(n)), EPS)) for v, n in zip(pdf["v"], pdf["n"], strict=True)]
            q = [np.random.default_rng([seed, b]).normal(size=(n, wide)) for b, n in zip(pdf["block"], pdf["n"], strict=True)]
            yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "d": [*map(_bytes, d)], "q": [*map(_bytes, q)]})

    form = "gid long, block long, n int, d binary, q binary"
    state = cut(start.drop("q").join(degree, ["gid", "block"], "left").mapInPandas(begin, form))

    def scaled(rows: DataFrame, last: bool) -> DataFrame:
        """D^-1/2 times the last block of vectors, or times all."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = [(_array(q).reshape(n, -1)[:, -wide if last else 0 :]) * _array(d)[:, None] for q, d, n in zip(pdf["q"], pdf["d"], pdf["n"], strict=True)]
                yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "q": [*map(_bytes, q)]})

        return rows.mapInPandas(run, "gid long, block long, n int, q binary")

    def joined(rows: DataFrame, last: bool) -> DataFrame:
        """The vectors with their product by M beside them."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    q, d = _array(r.q).reshape(r.n, -1), _array(r.d)[:, None]
                    own = q[:, -wide if last else 0 :] * d
                    y = d * (own + (_array(r.v).reshape(r.n, -1) if r.v is not None else 0.0))
                    out.append(_bytes(np.hstack((q, y))))
                yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "d": pdf["d"], "q": out})

        return cut(rows.join(product(pairs, scaled(rows, last)), ["gid", "block"], "left").mapInPandas(run, form))

    def orthogonal(rows: DataFrame) -> DataFrame:
        """The last block of vectors less its part along the others, with unit columns at right angles; zeros for what isn't left."""

        def gram(r) -> np.ndarray:
            q = _array(r.q).reshape(r.n, -1)
            return q.T @ q[:, -wide:]

        def solve(g: np.ndarray) -> dict:
            g = g.reshape(-1, wide)
            along, own = g[:-wide], g[-wide:]
            value, vector = np.linalg.eigh(own - along.T @ along)
            keep = value > 1e-20 + 1e-13 * max(1.0, float(np.diag(own).max()))
            return {"along": _bytes(along), "turn": _bytes(np.where(keep, vector / np.sqrt(np.where(keep, value, 1.0)), 0.0))}

        small = _small(rows, gram, solve, "gid long, along binary, turn binary")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    q, along, turn = _array(r.q).reshape(r.n, -1).copy(), _array(r.along).reshape(-1, wide), _array(r.turn).reshape(wide, wide)
                    q[:, -wide:] = (q[:, -wide:] - q[:, :-wide] @ along) @ turn
                    out.append(_bytes(q))
                yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "d": pdf["d"], "q": out})

        return rows.join(small, "gid").mapInPandas(run, form)

    def gram(r) -> np.ndarray:
        q = _array(r.q).reshape(r.n, -1)
        q, y = np.hsplit(q, 2)
        return np.stack((q.T @ q, q.T @ y, y.T @ y))

    def solve(g: np.ndarray) -> dict:
        own, m, square = g.reshape(3, -1, int((len(g) / 3) ** 0.5))
        value, vector = np.linalg.eigh(own)
        keep = value > 1e-10
        base = vector[:, keep] / np.sqrt(value[keep])
        m = (m + m.T) / 2
        ritz, turn = np.linalg.eigh(base.T @ m @ base)
        ritz, turn = ritz[::-1][:wide], (base @ turn[:, ::-1])[:, :wide]
        off = np.einsum("ij,ij->j", turn, square @ turn) - 2 * ritz * np.einsum("ij,ij->j", turn, m @ turn) + ritz**2
        padded = np.zeros((len(own), wide))
        padded[:, : turn.shape[1]] = turn
        k = min(most, len(ritz))
        return {"values": (1 - ritz[:k]).tolist(), "turn": _bytes(padded), "off": float(np.sqrt(np.maximum(0.0, off[:k])).max(initial=0.0))}

    def project(columns: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = []
                for r in pdf.itertuples(index=False):
                    whole = _array(r.q).reshape(r.n, -1)
                    own = whole[:, : whole.shape[1] // 2]
                    q.append(_bytes((own @ _array(r.turn).reshape(own.shape[1], -1))[:, : min(columns, len(r.values)) if columns < wide else wide]))
                yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "d": pdf["d"], "q": q})

        return run

    for _ in range(RESTARTS):
        state = orthogonal(state)
        for _ in range(steps):
            state = orthogonal(joined(state, True))
        both = joined(state, False)
        small = _small(both, gram, solve, "gid long, values array<double>, turn binary, off double")
        named = both.join(small, "gid")
        if (small.agg(F.max("off")).first()[0] or 0.0) < RESIDUAL:
            break
        state = cut(named.mapInPandas(project(wide), form))
    return small.select("gid", "values"), cut(named.mapInPandas(project(most), form).drop("d"))


def _picks(x: np.ndarray, k: int) -> np.ndarray:
    """Rows by farthest first from the first one, the earliest of equally far ones."""
    own = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(own) < min(k, len(x)):
        own.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[own[-1]]) ** 2).sum(axis=1))
    return x[own]


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows drawn one by one with a chance that rises with the squared distance from those drawn."""
    own = [int(rng.integers(len(x)))]
    while len(own) < min(k, len(x)):
        far = np.min([((x - x[i]) ** 2).sum(axis=1) for i in own], axis=0)
        own.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x))))
    return x[own]


def kmeans(rows: DataFrame, counts: DataFrame, starts: int = STARTS, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(gid, k, centres, wide): for rows (gid, block, n, q) the best centres of each number of clusters in ``counts`` (gid, ks).

    Every number is tried from ``starts`` sets of first centres: farthest first over the picks of all blocks, and draws by squared
    distance from an even sample of every block.  All groups, numbers and starts move together, one job a round, until none moves.
    """
    plain = "gid long, ks array<int>, starts int, wide int, centres binary, cost binary, moved double"

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far, drawn = [], []
            for r in pdf.itertuples(index=False):
                x = _array(r.q).reshape(r.n, -1)
                far.append(_bytes(_picks(x, int(max(r.ks)))))
                drawn.append(_bytes(x[np.unique(np.linspace(0, len(x) - 1, DRAWN).astype(int))]))
            yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "wide": [len(q) // 8 // n for q, n in zip(pdf["q"], pdf["n"], strict=True)], "ks": pdf["ks"], "far": far, "drawn": drawn})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, ks = int(pdf["wide"].iloc[0]), [int(k) for k in pdf["ks"].iloc[0]]
        far, drawn = (np.vstack([_array(p).reshape(-1, wide) for p in pdf.sort_values("block")[c]]) for c in ("far", "drawn"))
        runs = np.full((len(ks) * starts, max(ks), wide), np.nan)
        for i, k in enumerate(ks):
            for s in range(starts):
                own = _spread(drawn, k, np.random.default_rng([seed, k, s])) if s else _picks(far, k)
                runs[i * starts + s, : len(own)] = own
        return pd.DataFrame({"gid": pdf["gid"].iloc[:1].to_numpy(), "ks": [ks], "starts": starts, "wide": wide, "centres": [_bytes(runs)], "cost": [b""], "moved": np.inf})

    state = cut(rows.join(counts, "gid").mapInPandas(pick, "gid long, block long, wide int, ks array<int>, far binary, drawn binary").groupBy("gid").applyInPandas(begin, plain))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = _array(r.q).reshape(r.n, -1)
                c = _array(r.centres).reshape(len(r.ks) * r.starts, -1, r.wide)
                total = np.zeros((*c.shape[:2], r.wide + 1))
                cost = np.zeros(len(c))
                for i, own in enumerate(c):
                    label, far = closest(x, own)
                    np.add.at(total[i], label, np.column_stack((x, np.ones(len(x)))))
                    cost[i] = far.sum()
                out.append(_bytes(np.concatenate((total.ravel(), cost))))
            yield pd.DataFrame({"gid": pdf["gid"], "s": out})

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples(index=False))
        c = _array(r.centres).reshape(len(r.ks) * r.starts, -1, r.wide)
        flat = reduce(np.add, map(_array, pdf["s"]))
        total, cost = flat[: -len(c)].reshape(*c.shape[:2], r.wide + 1), flat[-len(c) :]
        count = total[:, :, -1:]
        new = np.where(count > 0, total[:, :, :-1] / np.maximum(1, count), c)
        return pd.DataFrame({"gid": [r.gid], "ks": [list(r.ks)], "starts": [r.starts], "wide": [r.wide], "centres": [_bytes(new)], "cost": [_bytes(cost)], "moved": [float(np.nanmax(np.abs(new - c), initial=0.0))]})

    for _ in range(rounds):
        stepped = rows.join(state, "gid").mapInPandas(sums, "gid long, s binary")
        state = cut(stepped.join(state, "gid").groupBy("gid").applyInPandas(move, plain))
        if (state.agg(F.max("moved")).first()[0] or 0.0) < 1e-9:
            break

    def chosen(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for r in pdf.itertuples(index=False):
            c, cost = _array(r.centres).reshape(len(r.ks), r.starts, -1, r.wide), _array(r.cost).reshape(len(r.ks), r.starts)
            out += [(r.gid, int(k), _bytes(c[i, int(cost[i].argmin())]), r.wide) for i, k in enumerate(r.ks)]
        return pd.DataFrame(out, columns=["gid", "k", "centres", "wide"])

    return cut(state.mapInPandas(lambda batches: map(chosen, batches), "gid long, k int, centres binary, wide int"))


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, the first of equally near ones, and the squared distance."""
    d = np.stack([((x - own) ** 2).sum(axis=1) if not np.isnan(own).any() else np.full(len(x), np.inf) for own in c], axis=1)
    return d.argmin(axis=1), d.min(axis=1)


def _labels(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(gid, block, at, k, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                label, _ = closest(_array(r.q).reshape(r.n, -1), _array(r.centres).reshape(-1, r.wide))
                yield pd.DataFrame({"gid": r.gid, "block": r.block, "at": np.arange(r.n), "k": r.k, "label": label.astype(np.int32)})

    return rows.join(centres, "gid").mapInPandas(run, "gid long, block long, at long, k int, label int")


def silhouettes(rows: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gid, k, silhouette): the mean over all rows, zero for rows alone or without another cluster; exact, over all pairs of blocks."""
    counts = labels.groupBy("gid", "k", "label").agg(F.count("*").alias("c")).groupBy("gid").agg(F.collect_list(F.struct("k", "label", "c")).alias("counts"))
    per = labels.groupBy("gid", "block").agg(F.sort_array(F.collect_list(F.struct("k", "at", "label"))).alias("l"))
    both = rows.join(per.select("gid", "block", F.expr("transform(l, x -> x.label)").alias("l")), ["gid", "block"]).join(counts, "gid")

    def hot(l: np.ndarray, n: int, counts: list) -> tuple[np.ndarray, list[tuple[int, int, int]]]:  # noqa: E741
        keys = sorted((int(c["k"]), int(c["label"]), int(c["c"])) for c in counts)
        ks = sorted({k for k, _, _ in keys})
        by = np.asarray(l).reshape(len(ks), n)
        return np.column_stack([by[ks.index(k)] == c for k, c, _ in keys]).astype(float), keys

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("block")
        a, b = (next(pdf[pdf["block"] == pdf[side].iloc[0]].itertuples(index=False)) for side in ("left", "right"))
        x, y = (_array(r.q).reshape(r.n, -1) for r in (a, b))
        d = np.sqrt(np.maximum(0.0, np.stack([((x - own) ** 2).sum(axis=1) for own in y], axis=1)))
        out = [(a.gid, a.block, _bytes(d @ hot(b.l, b.n, b.counts)[0]))]
        if a.block != b.block:
            out.append((b.gid, b.block, _bytes(d.T @ hot(a.l, a.n, a.counts)[0])))
        return pd.DataFrame(out, columns=["gid", "block", "v"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own, keys = hot(r.l, r.n, r.counts)
                total = _array(r.v).reshape(r.n, -1)
                ks, n = sorted({k for k, _, _ in keys}), {}
                for k in ks:
                    at = [i for i, key in enumerate(keys) if key[0] == k]
                    count = np.array([keys[i][2] for i in at], dtype=float)
                    mine = own[:, at] > 0
                    size = (mine * count).sum(axis=1)
                    a = (total[:, at] * mine).sum(axis=1) / np.maximum(1, size - 1)
                    b = np.where(mine, np.inf, total[:, at] / count).min(axis=1)
                    n[k] = np.where((size > 1) & (len(at) > 1), (np.where(np.isinf(b), 0, b) - a) / np.maximum(np.maximum(a, np.where(np.isinf(b), 0, b)), EPS), 0.0).sum()
                yield pd.DataFrame({"gid": r.gid, "k": ks, "s": [n[k] for k in ks], "n": r.n})

    sums = _added(_pairs(both, sizes).groupBy("gid", "left", "right").applyInPandas(far, VECTOR))
    scored = both.join(sums, ["gid", "block"]).mapInPandas(score, "gid long, k int, s double, n long")
    return scored.groupBy("gid", "k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def _named(found: DataFrame, tracks: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """(group, track_id, cluster_id); 0 for tracks of groups without labels."""
    out = tracks.select("gid", "block", "at", "track_id").join(found.select("gid", "block", "at", "label"), ["gid", "block", "at"], "left")
    return out.join(sizes.select("gid", group), "gid").select(group, "track_id", F.coalesce("label", F.lit(0)).cast("int").alias("cluster_id"))


def spectral(points: DataFrame, group: str, threshold: float = 0.5, most: int = 10, block: int = BLOCK) -> DataFrame:
    """(group, track_id, cluster_id) by the eigengap of the thresholded polar affinity's Laplacian, and k-means on its first
    eigenvectors with rows of length 1; a group of one track is one cluster."""
    tracks, sizes = dealt(points, group, block)
    values, vectors = eigenvectors(affinity(tracks, sizes, threshold), tracks, most + 1)

    def gap(v: pd.Series) -> pd.Series:
        return v.map(lambda x: int(min(most, max(1, np.argmax(np.diff(x)) + 1))) if len(x) > 1 else 1).astype("int32")

    number = values.select("gid", F.pandas_udf(gap, "int")("values").alias("k"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [_bytes(unit(_array(q).reshape(n, -1)[:, :k])) for q, n, k in zip(pdf["q"], pdf["n"], pdf["k"], strict=True)]
            yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "q": q})

    number = cut(number)
    own = cut(vectors.join(number.where("k > 1"), "gid").mapInPandas(rows, "gid long, block long, n int, q binary"))
    centres = kmeans(own, number.where("k > 1").select("gid", F.array("k").alias("ks")))
    return _named(_labels(own, centres), tracks, sizes, group)


def laplacian(points: DataFrame, group: str, neighbours: int = 10, parts: int = 10, block: int = BLOCK) -> DataFrame:
    """(group, track_id, cluster_id) by k-means on the embedding of the mutual-neighbour affinity, with the number of clusters of the
    best silhouette (the smallest of equally good ones); a group of fewer than three tracks is one cluster."""
    tracks, sizes = dealt(points, group, block)
    links = mutual(nearest(tracks, sizes, neighbours), block)
    _, vectors = eigenvectors(links, tracks, parts)
    many = sizes.where("n > 2")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = [_bytes(_array(q).reshape(n, -1)[:, : min(parts, all_ - 1)]) for q, n, all_ in zip(pdf["q"], pdf["n"], pdf["all"], strict=True)]
            yield pd.DataFrame({"gid": pdf["gid"], "block": pdf["block"], "n": pdf["n"], "q": q})

    own = cut(vectors.join(many.select("gid", F.col("n").alias("all")), "gid").mapInPandas(rows, "gid long, block long, n int, q binary"))
    centres = kmeans(own, many.select("gid", F.expr("sequence(2, cast(least(15, n) as int) - 1)").alias("ks")))
    labels = cut(_labels(own, centres))
    best = silhouettes(own, labels, sizes).groupBy("gid").agg(F.max_by("k", F.struct(F.round("silhouette", 12), -F.col("k"))).alias("k"))
    return _named(labels.join(best, ["gid", "k"]), tracks, sizes, group)
