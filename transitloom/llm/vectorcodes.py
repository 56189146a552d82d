"""Product codes of vectors, with nearest entries found through pivots (LAESA).

Components become integers, vectors are cut into equal parts, and each part position has a small codebook
that two rounds of assignment and averaging refine. Squared distances of every part to a few fixed pivots
are computed once and stored with the vectors. A round only measures its entries against the pivots: by
the triangle inequality |d(part, pivot) - d(entry, pivot)| bounds d(part, entry) from below. Entries are
visited by rising bound, and a part is done when the next bound passes its best distance. Distances are
compared as exact integers; bounds give way by more than their rounding error, so no nearest entry is lost.

A round sends sums and counts of each entry, at most one row for each task, entry and component, so what
reaches the driver is the size of the codebooks whatever the number of vectors.

Nulls: a null vector and one with a null or non-finite component is dropped; a null id sorts last and keeps
its row; null labels are one label. Equal ids are ordered by their vectors. Rows that repeat are coded each.
Vectors whose length is not the most common one (the longer of two as common), and empty ones, are dropped: they have no
parts to compare. An empty table gives an empty result. Components of 2**18 or more in size are refused,
as exact sums of squares would not fit in a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.llm.text import sliced

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256
# Exact sums of squares of this size fit in 64 bits for vectors of up to 1,024 components.
LARGEST = 1 << 26
ROWS = 2048
# Far above the rounding of a square root in 32 bits, or of a difference of two.
SLACK = 2e-6

Store = Callable[[DataFrame, str], DataFrame]


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def common_length(vectors: DataFrame, vector: str) -> int:
    """The most common length of the usable vectors; zero if there are none."""
    sizes = vectors.where(finite(F.col(vector)) & (F.size(vector) > 0)).groupBy(F.size(vector).alias("n")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def pivots_of(book: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Fixed pivots of one part position: entries far from each other, each the farthest from those before."""
    chosen = [0]
    near = ((book - book[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(book)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((book - book[chosen[-1]]) ** 2).sum(1))
    return book[chosen]


def nearest(x: np.ndarray, away: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry and squared distance to it for each part, and how many distances were evaluated.

    `away` holds the squared distances of the parts to the pivots.
    """
    n = len(x)
    to = np.sqrt(away.astype(np.float64)).astype(np.float32)
    between = np.sqrt(((book[:, None, :] - pivots[None, :, :]) ** 2).sum(2).astype(np.float64)).astype(np.float32)
    low = np.zeros((n, len(book)), np.float32)
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to[:, p, None] - between[:, p]), out=low)
    low -= SLACK * (to.max(initial=0) + between.max())
    np.maximum(low, 0, out=low)
    low *= low
    low *= np.float32(1 - SLACK)
    best, at, rows, evaluated = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.arange(n), 0
    while rows.size:
        # of the entries not visited yet, the one of the lowest bound; among equals that of the lowest index
        entry = low.argmin(axis=1)
        still = low[np.arange(len(rows)), entry] <= best[rows]
        if not still.all():
            rows, entry, low = rows[still], entry[still], low[still]
        evaluated += rows.size
        exact = ((x[rows] - book[entry]) ** 2).sum(1)
        better = (exact < best[rows]) | ((exact == best[rows]) & (entry < at[rows]))
        best[rows[better]], at[rows[better]] = exact[better], entry[better]
        low[np.arange(len(rows)), entry] = np.inf
    return at, best, evaluated


def _matrix(batch: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)


def _measured(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with `away`, the squared distances of each part to the pivots of its position."""
    parts, count, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            x = _matrix(batch, "x", parts, width)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST // SCALE} or more")
            away = np.stack([((x[:, p, None, :] - pivots[p]) ** 2).sum(2) for p in range(parts)], axis=1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts * count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(away.reshape(-1)))],
                                             names=[*batch.schema.names, "away"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kept}, away array<bigint>")


def _refined(measured: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, and each entry becomes the floored mean of its parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in sliced(batches, ROWS):
            x, away = _matrix(batch, "x", parts, width), _matrix(batch, "away", parts, pivots.shape[1])
            for p in range(parts):
                at, _, _ = nearest(x[:, p], away[:, p], books[p], pivots[p])
                np.add.at(sums[p], at, x[:, p])
                counts[p] += np.bincount(at, minlength=entries)
        used = np.flatnonzero(counts.reshape(-1))
        cells = (used[:, None] * width + np.arange(width)).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(sums.reshape(-1)[cells]), pa.array(np.repeat(counts.reshape(-1)[used], width))], names=["cell", "total", "held"])

    found = measured.select("x", "away").mapInArrow(run, "cell long, total long, held long")
    new = books.reshape(-1).copy()
    for cell, total, held in found.groupBy("cell").agg(F.sum("total"), F.sum("held")).collect():
        new[cell] = total // held
    return new.reshape(books.shape)


def _coded(measured: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    out = [f for f in measured.schema.fields if f.name not in ("x", "away")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            x, away = _matrix(batch, "x", parts, width), _matrix(batch, "away", parts, pivots.shape[1])
            found = [nearest(x[:, p], away[:, p], books[p], pivots[p]) for p in range(parts)]
            codes = np.stack([at for at, _, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d, _ in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in out), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                names=[*(f.name for f in out), "code", "error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out)
    return measured.mapInArrow(run, f"{kept}, code string, error long")


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, store: Store, id: str = "vec_id", vector: str = "embedding", label: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """`vec_id`, `label`, `code` and `error` of every usable vector, and the codebooks (part, entry, component).

    `store` writes a frame to the shared folder and reads it back. At most 256 entries have codes of two digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of two hexadecimal digits have 1 to 256 entries")
    length = common_length(vectors, vector)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    usable = vectors.where(finite(F.col(vector)) & (F.size(vector) == length) & F.lit(length > 0)).select(
        F.col(id).alias("vec_id"), F.col(label).alias("label"), integers(F.col(vector)).alias("x"))
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return usable.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, length // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    pivots = np.stack([pivots_of(book) for book in books])
    measured = store(_measured(usable, pivots), "vector-pivots")
    for _ in range(rounds):
        books = _refined(measured, books, pivots)
    return _coded(measured, books, pivots), books


def codes(vectors: DataFrame, store: Store, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes and errors, with the error summed over each label and the digest of the codebooks."""
    found, books = encode(vectors, store, id, vector, label)
    coded = store(found, "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
