"""Whitening of embeddings by the singular values of the centred rows; no product of rows is ever formed.

Tasks reduce their centred rows block by block to triangular QR factors, which are stacked and reduced again until one
d by d factor R is left: its size is that of a vector squared, whatever the number of rows. R is made bidiagonal, dqds
finds its singular values and twisted factorisations the directions (``bidiagonal``). A last scan projects every row.

Rows that count: entries become long x = floor(1024 * c) + 100000 (saturated at the range of long). A vector that is
null, or holds a null or non-finite entry, is dropped; so is one shorter than the longest, whose missing entries count
as null. Sums are exact integers, and so is ``deviation``; it is null where it leaves the range of long. A component
whose variance rounding cannot tell from zero has no direction: its ``whitened`` is 0, so ``identity_error`` is 1 then.
Without any variance ``explained`` is 0. Equal variances share their plane: any unit directions in it are right, and
all rows use the same ones. Repeated rows and identifiers count and return as often as they occur, a null identifier
is kept, vectors without entries and an empty table give no rows, and columns other than the two are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.bidiagonal import right_vectors
from colloquy.operators.staging import stage

COMPONENTS = 8
GRID, OFFSET = 1024, 100_000
BLOCK_ROWS = 4096
FAN_IN = 16
_LONG = (1 << 63) - 1


def _exact(n: int, reach: int) -> bool:
    """Whether integers up to n * reach fit in a long."""
    return n * (reach + 1) <= _LONG


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(len(vectors), -1)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact; Python integers where a long is too short."""
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if _exact(n, 2 * reach) and max(map(abs, sums), default=0) <= _LONG // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows, None above the range of long."""
    big = int(max(abs(y.max(initial=0)), abs(y.min(initial=0))))
    if big * big * y.shape[1] <= _LONG:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v <= _LONG else None for v in exact]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of ``rows``, padded with zero rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


@dataclass
class Whitener:
    """What the fit list yields: n, exact sums, directions (columns) with their singular values, and shares of variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    scales: list[float]
    explained: list[float]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened components of rows given as n * x - S."""
        z = (y.astype(np.float64) / self.n) @ self.directions
        flat = np.array(self.scales)
        return np.where(flat > 0, z / np.where(flat > 0, flat, 1), 0.0)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the long entries x of the rows that count."""
    c = F.col(vector_col)
    usable = c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    # the list's second look at an entry is after the filter, so no null or endless one reaches the floor
    x = F.transform(c, lambda v: F.least(F.floor(v.cast("double") * GRID), F.lit(_LONG - OFFSET)) + F.lit(OFFSET).cast("long"))
    kept = vectors.filter(usable & (F.size(c) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    longest = kept.agg(F.max(F.size("x")).alias("d")).first().d
    return kept.filter(F.size("x") == (longest or 0))


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension; one partial sum a task and dimension is shuffled."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, None
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf["x"])
                reach = max(abs(int(x.max())), abs(int(x.min())))
                part = x.sum(axis=0).tolist() if _exact(len(x), reach) else [sum(col) for col in x.T.tolist()]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            yield pd.DataFrame({"dim": range(len(sums)), "n": n, "s": [str(s) for s in sums]})

    parts = rows.select("x").mapInPandas(add, "dim int, n long, s string")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (int(found[0].n), [int(r.s) for r in found]) if found else (0, [])


def _factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: one factor a task, then ``FAN_IN`` factors to one until one is left."""
    d = len(sums)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, task = None, 0
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at:at + BLOCK_ROWS]
                block = _numerators(_rows(part["x"]), n, sums).astype(np.float64) / n
                r, task = _triangle(block if r is None else np.vstack([r, block])), int(part["task"].iloc[0])
        if r is not None:
            yield pd.DataFrame({"task": [task], "r": [r.tobytes()]})

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf.sort_values("task")
        r = _triangle(np.vstack([np.frombuffer(b).reshape(d, d) for b in found["r"]]))
        return pd.DataFrame({"task": [int(found["task"].iloc[0]) // FAN_IN], "r": [r.tobytes()]})

    parts = stage(rows.select("x", F.spark_partition_id().alias("task")).mapInPandas(reduce_rows, "task int, r binary"), "factors")
    while parts.count() > 1:
        parts = stage(parts.groupBy(F.floor(F.col("task") / FAN_IN)).applyInPandas(stack, "task int, r binary"), "factors")
    return np.frombuffer(parts.first().r).reshape(d, d)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on all of ``rows`` (``x``); None without rows."""
    n, sums = _totals(rows)
    if not n:
        return None
    values, z = right_vectors(_factor(rows, n, sums), components)
    d = len(sums)
    k = min(components, d)
    directions = np.zeros((d, k))
    directions[:, :z.shape[1]] = z
    scales = [float(values[j]) / math.sqrt(n) if j < z.shape[1] else 0.0 for j in range(k)]
    top = float(values[0]) if d else 0.0
    shares = (values / top) ** 2 if top > 0 else np.zeros(d)
    explained = [float(shares[j] / shares.sum()) if top > 0 else 0.0 for j in range(k)]
    return Whitener(n, sums, directions, scales, explained)


def _identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(w.scales)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for pdf in batches:
            if len(pdf):
                z = w.project(_numerators(_rows(pdf["x"]), w.n, w.sums))
                total += np.hstack([z.T @ z, z.sum(axis=0)[:, None]])
        yield pd.DataFrame({"at": range(total.size), "v": total.ravel()})

    parts = rows.select("x").mapInPandas(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r.v for r in parts]).reshape(k, k + 1) / w.n
    mean = total[:, k]  # the rows are centred already, what is left is rounding
    return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that counts."""
    ident = dict(vectors.dtypes)[id_col]
    schema = f"vec_id {ident}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stage(prepared(vectors, id_col, vector_col), "vectors")
    w = fit(rows, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = _identity_error(rows, w), len(w.scales)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = _numerators(_rows(pdf["x"]), w.n, w.sums)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": pd.array(_squares(y), "Int64"), "z": list(w.project(y))})

    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")  # pandas would turn longs beside a null into floats
    out = named.mapInPandas(project, "vec_id string, deviation long, z array<double>")
    long = out.select(F.col("vec_id").cast(ident).alias("vec_id"), "deviation", F.posexplode("z").alias("at", "whitened"))
    shares = F.array(*[F.lit(v) for v in w.explained])
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def report(vectors: DataFrame) -> DataFrame:
    return whiten(vectors.select("vec_id", "embedding"))
