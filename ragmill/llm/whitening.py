"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Eigenvalues of less than this share of all variance count as none, and their directions as no components.
LEAST_SHARE = 1e-12
#: Sums of entries are kept in two halves, so that no long overflows.
HALF = 1 << 26


def whole_entries(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and x, array<long>: each entry c as floor(scale * c), of the vectors that take part, repeated ones too.

    Left out are vectors that are null, empty or hold an entry that is null, non-finite or whose x is over 2^53 in
    size, and those that haven't as many entries as most others (of equally common lengths the largest counts).
    """
    ok = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < 2.0**53))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("_v")).where(ok & (F.size("_v") > 0))
    rows = stored(rows.select("id", F.transform("_v", lambda c: F.floor(c * scale)).alias("x")), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def blocks_of(rows: DataFrame, size: int = 2048) -> DataFrame:
    """Each distinct x once, `size` to a block of bytes, as a stored table that the passes read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [np.asarray(x, np.int64) for x in batch["x"]]
            while len(held) >= size:
                yield pd.DataFrame({"d": [held[0].size], "block": [np.stack(held[:size]).tobytes()]})
                del held[:size]
        if held:
            yield pd.DataFrame({"d": [held[0].size], "block": [np.stack(held).tobytes()]})

    return stored(rows.select("x").distinct().mapInPandas(run, "d int, block binary"), "whitening-blocks")


def summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of part(matrix of longs) over all blocks: each task adds up its own, one grouping adds the tasks'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for d, block in zip(batch["d"], batch["block"], strict=True):
                here = part(np.frombuffer(block, np.int64).reshape(-1, d))
                total = here if total is None else total + here
        if total is not None:
            yield pd.DataFrame({"total": [total]})

    parts = blocks.mapInPandas(run, f"total array<{kind}>").select(F.posexplode("total").alias("at", "y"))
    got = {r["at"]: r["y"] for r in parts.groupBy("at").agg(F.sum("y").alias("y")).collect()}
    return np.array([got[i] for i in range(len(got))])


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, most: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """V (d x k, orthonormal) and the upper bidiagonal B (k x k) with X V = U B, for X known by product(p) = (X'Xp, |Xp|^2).

    A step takes u = Xv less its part along the u before, then X'u less its part along v. Every u and every v is
    orthogonalised against all before it. As u = Xw for a w of d numbers, the products of u with all earlier ones are
    those of w's with X'Xp, and taking out what is left of them is linear in p: no column of U is ever stored, and one
    pass over the rows makes both products of a step. Where a step ends in nothing (an invariant space is found, as
    with repeated eigenvalues), the next starts from another vector orthogonal to all. It ends after d steps, or when
    the residuals of the `most` largest values are under `tolerance` times the largest.
    """
    rng = np.random.default_rng(11)
    v, alphas, betas = [], [], []
    w, xu = np.zeros((0, d)), np.zeros((0, d))  # of each u: w with u = Xw, and X'u
    beta, scale, after = 0.0, 0.0, None

    def against_all(x: np.ndarray) -> np.ndarray:
        for _ in range(3):
            for q in v:
                x = x - q * (q @ x)
        return x

    while len(v) < d:
        if after is None:
            x = against_all(rng.standard_normal(d))
            after = x / np.linalg.norm(x)
        v.append(after)
        p = v[-1] - (beta * w[-1] if beta else 0)
        y, size = product(p)
        along = w @ y  # products with all earlier u, nought but for rounding
        p, y, size = p - along @ w, y - along @ xu, size - along @ along
        alpha = float(np.sqrt(max(size, 0.0)))
        scale = max(scale, alpha, beta)
        if alpha <= 1e-12 * scale or alpha == 0:
            alpha, p, y = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, y = p / alpha, y / alpha
        w, xu = np.vstack([w, p]), np.vstack([xu, y])
        alphas.append(alpha)
        rest = against_all(y - alpha * v[-1])
        beta = float(np.linalg.norm(rest))
        after = rest / beta if beta > 1e-12 * scale and beta > 0 else None
        beta = beta if after is not None else 0.0
        betas.append(beta)
        if tolerance and len(v) >= most and beta:
            left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[:-1], 1))
            if (beta * np.abs(left[-1, :most]) <= tolerance * values[0]).all():
                break
    return np.array(v).T, np.diag(alphas) + np.diag(betas[:-1], 1)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of x, their sums, unit components by falling eigenvalue, and what of the variance each explains."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exactly; None where no long holds it."""
        reach = self.n * float(np.abs(x).max(initial=0)) + max((abs(float(s)) for s in self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) < 2.0**62:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        whole = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [t if t < 1 << 63 else None for t in whole]


def fit(rows: DataFrame, most: int = 16, tolerance: float = 0.0) -> Whitening:
    """Components of whole_entries() rows, each distinct x counted once.

    Bidiagonalisation makes one pass over the rows a step; the driver holds only vectors of one number a dimension, as
    many as there were steps. `tolerance` 0 takes as many steps as dimensions, which finds repeated eigenvalues too;
    1e-14 or so ends earlier on long vectors. Without rows, or variance, there are no components.
    """
    blocks = blocks_of(rows)
    halves = summed(blocks, lambda x: np.concatenate([[x.shape[0]], (x // HALF).sum(0), (x % HALF).sum(0)]), "long").astype(object)
    d = (len(halves) - 1) // 2 if len(halves) else 0
    n, sums = (int(halves[0]), [int(a) * HALF + int(b) for a, b in zip(halves[1 : d + 1], halves[d + 1 :], strict=True)]) if d else (0, [])
    mean = np.array([s / n for s in sums])
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    variance = float(summed(blocks, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n if d else 0.0
    if not variance:
        return none

    def product(p: np.ndarray) -> tuple[np.ndarray, float]:
        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            u = x @ p
            return np.append(x.T @ u, u @ u)

        both = summed(blocks, part)
        return both[:-1], float(both[-1])

    v, b = bidiagonalise(product, d, most, tolerance)
    _, values, right = np.linalg.svd(b)
    eigen = values**2 / n
    k = int((eigen[:most] > LEAST_SHARE * variance).sum())
    components = v @ right[:k].T
    components *= np.where(np.take_along_axis(components, np.abs(components).argmax(0)[None], 0) < 0, -1, 1)
    model = Whitening(n, sums, components, eigen[:k], eigen[:k] / variance, 0.0)

    def squares(x: np.ndarray) -> np.ndarray:
        z = model.project(x)
        return (z.T @ z).reshape(-1)

    error = float(np.abs(summed(blocks, squares).reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, components, eigen[:k], eigen[:k] / variance, error)


def whiten(rows: DataFrame, model: Whitening, kind: str = "long") -> DataFrame:
    """id (of type `kind`), deviation and whitened, one number for each component, of every row of whole_entries().

    No shuffle; the model, one number for each dimension and component, goes with the tasks. Rows that repeat are
    whitened as often as they come; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack([np.asarray(v, np.int64) for v in batch["x"]]) if len(batch) else np.zeros((0, len(model.sums)), np.int64)
            yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(model.deviation(x), "Int64"), "whitened": list(model.project(x))})

    return rows.select("id", "x").mapInPandas(run, f"id {kind}, deviation long, whitened array<double>")
