"""Whitening of embeddings by exact integer scatter from bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Steps per unit of an entry, and what its long is shifted by; components that are given out.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Exact sums travel as limbs of 60 bits: the top one carries the sign.
LIMB = 60
#: A component counts as having no variance below this share of the largest one's.
FLAT = 1e-13

SUMS = "dim int, i int, j int, low long, mid long, high long"
PRODUCTS = "dim int, i int, j int, total double"
SCORES = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows whose vector has finite entries only, as steps of 1 / 64.

    An entry whose step has no long (2 ** 62 and more) counts as not finite.
    """
    entries = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= float(1 << 62))
    steps = F.transform("entries", lambda c: F.floor(c * SCALE).cast("long"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("entries"))
        .filter(F.col("entries").isNotNull() & ~F.exists("entries", bad))
        .select("vec_id", steps.alias("v"))
    )


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """One matrix of steps per length of vector, with the places of its rows and their ids."""
    lengths = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        if dim:
            part = batch.take(pa.array(rows))
            yield rows, part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), part["vec_id"]


def plane_products(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact column sums and cross-products of a block of steps.

    Every column is shifted to start at 0, and each bit of it becomes a plane: one bit per row, packed
    into words. Two planes meet in as many rows as the AND of their words has bits; weighted by the
    planes' powers of two these counts are the cross-products of the shifted columns.
    """
    rows, dim = x.shape
    least = x.min(axis=0)
    y = (x - least).view(np.uint64)
    padded = np.zeros((-(-rows // 64) * 64, dim), np.uint64)
    padded[:rows] = y
    words, weights = [], []
    for column, top in enumerate(y.max(axis=0).tolist()):
        for bit in range(top.bit_length()):
            plane = ((padded[:, column] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
            words.append(np.packbits(plane).view(np.uint64))
            weights.append((column, bit))
    weight = np.zeros((dim, len(words)), object)
    for at, (column, bit) in enumerate(weights):
        weight[column, at] = 1 << bit
    both = np.zeros((len(words), len(words)), np.int64)
    if words:
        planes = np.stack(words)
        for at in range(len(planes)):
            both[at, at:] = np.bitwise_count(planes[at] & planes[at:]).sum(axis=1, dtype=np.int64)
        both = np.maximum(both, both.T)
    widest = max((bit for _, bit in weights), default=0)
    exact = np.int64 if 2 * widest + 2 + rows.bit_length() < 62 else object
    weight, both = weight.astype(exact), both.astype(exact)
    ones = np.diagonal(both)  # rows that have the bit
    cross = (weight @ both @ weight.T).astype(object) if words else np.zeros((dim, dim), object)
    sums = [int(s) for s in weight @ ones] if words else [0] * dim
    low = least.tolist()
    for i in range(dim):
        for j in range(dim):
            cross[i, j] = int(cross[i, j]) + low[i] * sums[j] + low[j] * sums[i] + rows * low[i] * low[j]
    return [s + rows * m for s, m in zip(sums, low)], cross


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    totals: dict[int, tuple] = {}
    for batch in batches:
        for _, x, _ in matrices(batch):
            dim = x.shape[1]
            sums, cross = plane_products(x)
            before = totals.get(dim)
            totals[dim] = (sums, cross) if before is None else ([a + b for a, b in zip(before[0], sums)], before[1] + cross)
            counts[dim] = counts.get(dim, 0) + len(x)
    for dim, (sums, cross) in totals.items():
        keys = [(-1, -1), *((i, -1) for i in range(dim)), *((i, j) for i in range(dim) for j in range(i, dim))]
        values = [counts[dim], *sums, *(int(cross[i, j]) for i in range(dim) for j in range(i, dim))]
        mask = (1 << LIMB) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dim] * len(keys), pa.int32()),
                pa.array([i for i, _ in keys], pa.int32()),
                pa.array([j for _, j in keys], pa.int32()),
                pa.array([v & mask for v in values], pa.int64()),
                pa.array([v >> LIMB & mask for v in values], pa.int64()),
                pa.array([v >> 2 * LIMB for v in values], pa.int64()),
            ],
            names=["dim", "i", "j", "low", "mid", "high"],
        )


class Fit:
    """What the vectors of one length are whitened by."""

    def __init__(self, n: int, sums: list[int], cross: dict[tuple[int, int], int], components: int):
        self.n, self.sums, dim = n, sums, len(sums)
        centred = np.empty((dim, dim))
        for (i, j), total in cross.items():
            # Integers up to here; Python divides them to the nearest double.
            centred[i, j] = centred[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(centred)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, vectors = values[order], vectors[:, order]
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
        self.live = self.values > FLAT * max(float(values.max(initial=0.0)), 0.0)
        self.explained = np.where(self.live, self.values / max(float(np.trace(centred)), 1e-300), 0.0)
        self.matrix = vectors / np.sqrt(np.where(self.live, self.values, 1.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as longs where they fit and as Python's integers where not."""
        reach = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        parts = self.centred(x)
        reach = max((abs(int(p)) for p in (parts.max(initial=0), parts.min(initial=0))), default=0)
        kind = np.int64 if reach * reach * max(x.shape[1], 1) < 1 << 62 else object
        squared = parts.astype(kind) ** 2
        return [int(s) if s < 1 << 63 else None for s in squared.sum(axis=1).tolist()]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fits by length of vector. The driver meets one sum per pair of dimensions, whatever the number of rows."""
    big = lambda name: F.sum(F.col(name).cast("decimal(20,0)")).alias(name)
    totals = rows.mapInArrow(_scatter, SUMS).groupBy("dim", "i", "j").agg(big("low"), big("mid"), big("high"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in totals.collect():
        value = int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << 2 * LIMB)
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = value
    return {
        dim: Fit(cells.pop((-1, -1)), [cells.pop((i, -1)) for i in range(dim)], cells, components)
        for dim, cells in found.items()
    }


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all rows."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, _ in matrices(batch):
                live = fits[x.shape[1]].live
                w = np.hstack([fits[x.shape[1]].whitened(x)[:, live], np.ones((len(x), 1))])
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + w.T @ w
        for dim, total in totals.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)),
                 pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["dim", "i", "j", "total"],
            )

    sums = rows.mapInArrow(products, PRODUCTS).groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    tables: dict[int, np.ndarray] = {d: np.zeros((int(f.live.sum()) + 1,) * 2) for d, f in fits.items()}
    for r in sums.collect():
        tables[r["dim"]][r["i"], r["j"]] = r["total"]
    errors: dict[int, float | None] = {}
    for dim, total in tables.items():
        n, means = total[-1, -1], total[-1, :-1] / total[-1, -1]
        covariance = total[:-1, :-1] / n - np.outer(means, means)
        errors[dim] = float(np.abs(covariance - np.eye(len(covariance))).max()) if len(covariance) else None
    return errors


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Vectors(vec_id, embedding) on their leading components, scaled to variance one.

    Columns: vec_id, component (from 1 by falling variance), n, deviation, whitened, explained,
    identity_error; ``components`` rows a vector, fewer where it has fewer entries. Signs make each
    component's largest entry positive.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped. Vectors of each length
    are a space of their own, with their own fit; empty ones have no component and no row. A component
    without variance has ``whitened`` null, ``explained`` 0 and takes no part in ``identity_error``, which
    is null if no component has any (one row, equal rows). A deviation past a long is null. A null
    vec_id stays null, repeated rows each count and come out. An empty table gives no rows.

    Three scans and two aggregates of one row a task and pair of dimensions; nothing else is shuffled.
    """
    rows = usable(vectors)
    fits = fit(rows, components)
    errors = identity_errors(rows, fits) if fits else {}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, ids in matrices(batch):
                own = fits[x.shape[1]]
                k = len(own.values)
                white = own.whitened(x)
                repeated = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(repeated),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, own.n, np.int64)),
                        pa.array(own.deviations(x), pa.int64()).take(repeated),
                        pa.array(white.ravel(), mask=np.tile(~own.live, len(x))),
                        pa.array(np.tile(own.explained, len(x))),
                        pa.array([errors[x.shape[1]]] * (len(x) * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(scores, f"{SCORES}, identity_error double")
