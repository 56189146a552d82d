"""Whitening of embeddings from exact bit-sliced cross-products.

Components become integers. In a block of rows each dimension is shifted to start at zero and cut into bit
planes; a plane is packed along the rows, 64 to a word. The sum of products of two dimensions is then the
number of rows in which bit a of one and bit b of the other are set, an AND and a population count, weighted by
2**(a + b). With the shifts put back these are exact integers that Spark adds up over the blocks. They are centred as integers, so
nothing cancels, and only then divided for the eigenvectors.

The fit list holds each distinct vector once, so copies weigh nothing. What reaches the driver is one sum for each pair of
dimensions, whatever the number of vectors.

Nulls: a null vector and one with a null or non-finite component is dropped; a null id keeps its row. Rows that
repeat are whitened each. Vectors whose length is not the most common one (the longer of two as common), and empty ones, are dropped.
Vectors with fewer dimensions than components have as many components as dimensions. A component without
variance (all vectors equal, say) has null for `whitened`; the identity is then tested on the others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm.text import sliced
from transitloom.llm.vectorcodes import common_length, finite, integers

COMPONENTS = 4
# Rows of a block: 64 words to a plane.
BLOCK = 4096
# An eigenvalue of no more than this share of the largest is rounding.
FLAT = 1e-12
# Weights and counts up to this many bits add up in 64-bit integers, beyond it in Python's.
SHORT_BITS = 62

Store = Callable[[DataFrame, str], DataFrame]


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of a block of numbers from zero up: packed words (plane, word), and dimension and bit of each plane.

    Planes without a set bit are left out.
    """
    words, of, bit = [], [], []
    for b in range(int(y.max(initial=0)).bit_length()):
        ones = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        there = np.flatnonzero(ones.any(axis=1))
        packed = np.packbits(ones[there], axis=1)
        words.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64))
        of.append(there)
        bit.append(np.full(len(there), b))
    if not words:
        return np.zeros((0, 1), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(words), np.concatenate(of), np.concatenate(bit)


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of products of every two dimensions of a block, and sums of each, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    words, of, bit = planes(x.view(np.uint64) - low.view(np.uint64))
    short = 2 * int(bit.max(initial=0)) + 2 + n.bit_length() < SHORT_BITS
    weight = np.left_shift(1, bit) if short else np.array([1 << int(b) for b in bit], dtype=object)
    cross = np.zeros((d, d), np.int64 if short else object)
    for plane, i, w in zip(words, of, weight, strict=True):
        common = np.bitwise_count(plane & words).sum(axis=1, dtype=np.int64)
        np.add.at(cross[i], of, common * weight * w)
    sums = np.zeros(d, np.int64 if short else object)
    np.add.at(sums, of, np.bitwise_count(words).sum(axis=1, dtype=np.int64) * weight)
    cross, sums, low = cross.astype(object), sums.astype(object), low.astype(object)
    return cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low), sums + n * low


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in sliced(batches, BLOCK):
        yield np.ascontiguousarray(batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums, and sums of products of the fit list, exact."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cross, sums = 0, np.zeros((d, d), object), np.zeros(d, object)
        for x in _blocks(batches, d):
            more, each = products(x)
            n, cross, sums = n + len(x), cross + more, sums + each
        if n:
            told = [n, *sums, *cross[upper]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(told)), pa.int64()), pa.array([Decimal(int(v)) for v in told], pa.decimal128(38, 0))], names=["cell", "value"])

    found = fit.select("x").mapInArrow(run, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    told = [int(r["value"]) for r in found.orderBy("cell").collect()]
    if not told:
        return 0, [], []
    cross = [[0] * d for _ in range(d)]
    for i, j, v in zip(*upper, told[d + 1:], strict=True):
        cross[i][j] = cross[j][i] = v
    return told[0], told[1:d + 1], cross


def principal(n: int, sums: list[int], cross: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as rows, eigenvalues and their shares of the trace, largest first.

    Centred sums n * cross - sums * sums are exact; each is divided by n squared once. The sign makes the largest entry positive.
    """
    centred = [[n * c - a * b for c, b in zip(row, sums, strict=True)] for row, a in zip(cross, sums, strict=True)]
    values, vectors = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in centred]))
    top = np.argsort(-values, kind="stable")[:most]
    vectors = vectors.T[top]
    flip = np.sign(vectors[np.arange(len(top)), np.abs(vectors).argmax(axis=1)])
    trace = sum(centred[i][i] for i in range(len(sums))) / (n * n)
    return vectors * flip[:, None], values[top], values[top] / trace if trace else np.zeros(len(top))


def projected(x: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whitened components of each row; the difference to the mean is an exact integer before it is divided."""
    apart = (x.astype(object) * n - np.array(sums, object)) if n * int(np.abs(x).max(initial=0)) >= 1 << 52 else x * n - np.array(sums, np.int64)
    return ((apart / n).astype(np.float64) @ vectors.T) / np.sqrt(values)


def squared(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums)**2, exact."""
    largest = 2 * n * (int(np.abs(x).max(initial=0)) + 1)
    if largest * largest * x.shape[1] < 1 << 62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def identity_error(fit: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, in size, measured on the rows."""
    d, k = len(sums), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = np.zeros((k, k))
        for x in _blocks(batches, d):
            w = projected(x, n, sums, vectors, values)
            cross += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int64()), pa.array(cross.reshape(-1))], names=["cell", "value"])

    found = fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
    return float(np.abs(np.array([r["value"] for r in found]).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, store: Store, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    `store` writes a frame to the shared folder and reads it back.
    """
    d = common_length(vectors, vector)
    usable = vectors.where(finite(F.col(vector)) & (F.size(vector) == d) & F.lit(d > 0)).select(
        F.col(id).alias("vec_id"), integers(F.col(vector)).alias("x"))
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return usable.sparkSession.createDataFrame([], schema)
    fit = store(usable.select("x").dropDuplicates(["x"]), "whitening-fit")
    n, sums, cross = scatter(fit, d)
    axes, values, shares = principal(n, sums, cross, components)
    has = values > FLAT * max(values[0], 0)
    off = identity_error(fit, n, sums, axes[has], values[has])
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            x = next(_blocks(iter([batch]), d))
            rows = len(x)
            white = np.full((rows, k), math.nan)
            white[:, has] = projected(x, n, sums, axes[has], values[has])
            repeat = np.repeat(np.arange(rows), k)
            deviation = pa.array([Decimal(v) for v in squared(x, n, sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(repeat)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), deviation.take(pa.array(repeat)),
                pa.array(white.reshape(-1), from_pandas=True), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, off)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, schema)
