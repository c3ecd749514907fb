"""Whitening by the leading components of an embedding table.

Chebyshev-filtered subspace iteration. The covariance matrix is never formed:
every step is one distributed pass that gives the product of the centred
vectors' covariance with a narrow block of columns. A polynomial recurrence of
such products damps the unwanted part of the spectrum, the block is made
orthonormal (QR) and rotated to Ritz pairs, and this repeats until the residuals
of the wanted pairs certify them. The interval to damp ends at the block's least
Ritz value; where it begins is learned from a Lanczos column that rides along
with the first products, so that a spectrum far from zero is damped as well.

What a pass sends to the driver has the size of the block (dimensions x
columns), whatever the number of rows: blocks are added up by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.scratch import Scratch

SCALE, GUARD, DEGREE, TIGHT = 256, 12, 10, 2e-14
LONG = (1 << 63) - 1
SLICE = 4096


def scaled(vector: Column) -> Column:
    """``floor(256 c)`` of each entry c as long; null where the vector is null or has an entry that is null, not finite or too large for a long."""
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= 2.0**54))
    return F.when(vector.isNotNull() & ~bad, entries)


def matrix(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The vectors of column ``x``, some thousand rows at a time."""
    column = batch["x"]
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)
    for low in range(0, len(rows), SLICE):
        yield rows[low : low + SLICE]


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``part`` of all slices of ``x``, added up: in each task, then by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in matrix(batch, width):
                made = part(x)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

    parts = rows.select("x").mapInArrow(run, "part array<double>")
    sums = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    got = sums.toPandas()
    out = np.zeros(int(got["at"].max()) + 1 if len(got) else 0)
    out[got["at"].to_numpy(np.int64)] = got["value"].to_numpy()
    return out


def _totals(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            for x in matrix(batch, width):
                n += len(x)
                small = np.abs(x).max(initial=0) < LONG // SLICE
                here = x.sum(axis=0).tolist() if small else [sum(c) for c in x.T.tolist()]
                sums = [a + b for a, b in zip(sums, here, strict=True)]
        if n:
            values = pa.array([[Decimal(v) for v in [n, *sums]]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([values], ["part"])

    parts = rows.select("x").mapInArrow(run, "part array<decimal(38,0)>")
    got = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in got}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(width)]


class Centre:
    """Takes the exact mean off integer vectors: its whole part in integers, the rest in doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole = [round(s / n) if abs(s) < 1 << 53 else s // n for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, exact; null where no long holds it."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 31 and most * most * max(1, len(self.sums)) <= LONG:
            gap = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v <= LONG else None for v in exact]


class Components:
    """The leading components: ``vectors`` (columns), ``values``, ``share`` of the trace, ``identity_error``, ``passes``."""

    def __init__(self, fit: DataFrame, centre: Centre, wanted: int = 4, most_passes: int = 400):
        self.fit, self.centre, self.width, self.passes = fit, centre, len(centre.sums), 0
        self.trace = float(self._moment(lambda c: np.array([np.einsum("ij,ij->", c, c)]))[0]) if self.width else 0.0
        values, vectors = self._solved(min(wanted, self.width), most_passes) if self.trace > 0 else (np.zeros(0), np.zeros((self.width, 0)))
        real = values > max(self.width, 1) * np.finfo(float).eps * (values[0] if len(values) else 0)
        self.values, self.vectors = values[real], vectors[:, real]
        self.share = self.values / self.trace if self.trace > 0 else self.values
        white, k = self.vectors / np.sqrt(self.values), len(self.values)
        got = self._moment(lambda c: ((w := c @ white).T @ w)).reshape(k, k) if k else np.zeros((0, 0))
        self.identity_error = float(np.abs(got - np.eye(k)).max(initial=0.0))

    def _moment(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        self.passes += 1
        centre = self.centre
        return _summed(self.fit, self.width, lambda x: part(centre(x))) / centre.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times ``block``: one pass over the fit list."""
        return self._moment(lambda c: c.T @ (c @ block)).reshape(block.shape)

    def _solved(self, wanted: int, most_passes: int) -> tuple[np.ndarray, np.ndarray]:
        d, k = self.width, min(self.width, wanted + GUARD)
        pick = np.random.default_rng(11)
        block = np.linalg.qr(pick.standard_normal((d, k)))[0]
        lanczos = _Lanczos(pick.standard_normal(d))
        low, before = 0.0, math.inf
        image = self._with(lanczos, block)
        while True:
            # Rayleigh-Ritz on the orthonormal block, whose image is at hand.
            values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            block, image = block @ turn, image @ turn
            residual = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max(initial=0.0)
            floor = TIGHT * values[0]
            stuck = residual <= 1e3 * floor and residual > before / 2  # rounding, not the filter, decides now
            if k == d or residual <= floor or stuck:
                return values[:wanted], block[:, :wanted]
            if self.passes > most_passes:  # a flat spectrum: with all columns the block is exact
                k, block = d, np.linalg.qr(np.hstack([block, pick.standard_normal((d, d - k))]))[0]
                image = self.times(block)
                continue
            before, low = residual, max(low, lanczos.least())
            high = max(values[-1], 1e-6 * values[0])  # a block may hold more columns than there is spectrum
            block = np.linalg.qr(self._filtered(block, image, min(low, high * 0.99), high, values[0], lanczos))[0]
            image = self._with(lanczos, block)

    def _with(self, lanczos: _Lanczos, block: np.ndarray) -> np.ndarray:
        """The block's product; while the Lanczos column is open it rides along."""
        if lanczos.closed:
            return self.times(block)
        made = self.times(np.column_stack([block, lanczos.column]))
        lanczos.step(made[:, -1])
        return made[:, :-1]

    def _filtered(self, block: np.ndarray, image: np.ndarray, low: float, high: float, top: float, lanczos: _Lanczos) -> np.ndarray:
        """The Chebyshev polynomial of degree ``DEGREE`` on [low, high], scaled to stay near one at ``top``."""
        middle, half = (high + low) / 2, (high - low) / 2
        sigma = first = half / (top - middle)
        now = (image - middle * block) * (first / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / first - sigma)
            block, now = now, (self._with(lanczos, now) - middle * now) * (2 * following / half) - block * (sigma * following)
            sigma = following
        return now


class _Lanczos:
    """A lower bound of the spectrum from products with one column."""

    def __init__(self, start: np.ndarray, most: int = 2 * DEGREE):
        self.basis, self.alpha, self.beta, self.most = [start / np.linalg.norm(start)], [], [], most

    @property
    def closed(self) -> bool:
        return len(self.alpha) >= self.most or len(self.basis) > min(self.most, len(self.basis[0]))

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, image: np.ndarray) -> None:
        self.alpha.append(float(self.column @ image))
        space = np.array(self.basis)
        for _ in range(2):  # orthogonal to all before
            image = image - space.T @ (space @ image)
        self.beta.append(float(np.linalg.norm(image)))
        if self.beta[-1] > 1e-10 * abs(self.alpha[0]):
            self.basis.append(image / self.beta[-1])
        else:
            self.most = len(self.alpha)

    def least(self) -> float:
        """The least Ritz value less its residual; not above the least eigenvalue but for rare starts, which cost passes only."""
        n = len(self.alpha)
        off = np.diag(self.beta[: n - 1], 1)
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + off + off.T)
        return max(0.0, float(values[0] - self.beta[n - 1] * abs(vectors[-1, 0])))


def whiten(embeddings: DataFrame, wanted: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector, up to ``wanted`` components.

    Vectors that are null or hold a null or non-finite entry (or one of 2**54 or
    more) are left out, and so are vectors of another length than the most
    frequent one (the longer at a tie). Entries become ``floor(256 c)``. The
    model is fitted on the distinct vectors, so repeated rows do not weigh on
    it; every row gets its scores, repeated ids and null ids too. ``deviation``
    is null where no long holds it. A component without variance is not given: equal
    vectors alone, a single vector or an empty table give no rows. Other columns are ignored.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select("vec_id", scaled(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width = best["width"] if best else 0
    rows = rows.where(F.size("x") == width)
    fit = scratch.keep("fit", rows.select("x").distinct())
    n, sums = _totals(fit, width)
    centre = Centre(n, sums) if n else None
    found = Components(fit, centre, wanted) if n else None
    white = found.vectors / np.sqrt(found.values) if n else np.zeros((0, 0))
    k = white.shape[1]
    share, error = (found.share.tolist(), found.identity_error) if n else ([], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for x in matrix(batch, width) if k else ():
                m = len(x)
                ids = pa.array(np.repeat(np.arange(low, low + m), k))
                low += m
                scores = centre(x) @ white
                gap = pa.array(centre.deviation(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(ids),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        gap.take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(scores.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)
