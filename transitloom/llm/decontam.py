"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of ten words of the benchmark items. The search looks at the last two words of
a window-sized stretch of text. A shift table says how far ahead a window ending on that pair can be, so
stretches that cannot hold one are skipped; a shift of zero leads to a bucket of windows chosen by the
hashes of their last and first pairs, and direct comparison confirms. Items too short for a window are searched whole,
one table for each length.

Benchmark items are a stated query set and are searched in blocks of bounded size. Spark writes the blocks to the shared
folder and hands the files to the executors. The documents are read once: a task takes them in chunks of bounded size, and
for each chunk builds the tables of one block after another, so it holds one block at a time; a single block is built once a task.

Nulls: a null text has no words; a null item has none and is never found; a null item id is written as
"null". Rows that repeat are each searched; equal items are found together. An empty benchmark finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitloom.llm.text import as_bytes, blank, free_name, sliced
from transitloom.session import scratch_path

WINDOW = 10
# Tables of a block take about 200 bytes of memory for each byte of its text (measured: 1.4 GB for 8 MB).
BLOCK_BYTES = 2_000_000
# Documents that meet one block after another, so that tables of several blocks are not built for every few texts.
CHUNK_BYTES = 32_000_000
ROWS = 256
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class Tables:
    """Shift table and buckets for test strings of one length, over word numbers."""

    def __init__(self, length: int, strings: dict[tuple[int, ...], set[str]]):
        self.length, self.strings = length, strings
        self.pair = min(2, length)
        self.far = length - self.pair + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[tuple[int, ...], tuple[int, ...]], list[tuple[int, ...]]] = {}
        for s in strings:
            for end in range(self.pair, length + 1):
                block = s[end - self.pair:end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault((s[-self.pair:], s[:self.pair]), []).append(s)

    def search(self, ids: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Start and string of every occurrence."""
        end, n, size, pair = self.length, len(ids), self.length, self.pair
        shift, far = self.shift, self.far
        while end <= n:
            last = tuple(ids[end - pair:end])
            step = shift.get(last, far)
            if step:
                end += step
                continue
            start = end - size
            for s in self.buckets.get((last, tuple(ids[start:start + pair])), ()):
                if tuple(ids[start:end]) == s:
                    yield start, s
            end += 1


class Block:
    """A block of benchmark items, its words numbered from one; zero stands for any other word."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, ws in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in ws]
            k = min(WINDOW, len(ids))
            for i in range(len(ids) - k + 1):
                by_length.setdefault(k, {}).setdefault(tuple(ids[i:i + k]), set()).add(item)
        self.tables = [Tables(k, strings) for k, strings in sorted(by_length.items()) if k]

    def find(self, ws: list[bytes]) -> tuple[list[int], set[str]]:
        """Numbers of the words within occurrences, and the items found."""
        number = self.number
        ids = [number.get(w, 0) for w in ws]
        hit: set[int] = set()
        items: set[str] = set()
        for t in self.tables:
            for start, s in t.search(ids):
                hit.update(range(start, start + t.length))
                items |= t.strings[s]
        return sorted(hit), items


def block_files(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the benchmark in blocks of about `block_bytes` to the shared folder and hand the files to the executors; their names.

    Spark deals the items out; only file names pass through the driver.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    path = scratch_path(spark, "benchmark-blocks")
    rows.repartition(-(-size // block_bytes)).write.json(path)
    names = []
    for file in spark.read.text(path).inputFiles():
        spark.sparkContext.addFile(file)
        names.append(unquote(file.rsplit("/", 1)[1]))
    return sorted(names)


def load_block(name: str) -> Block:
    """The tables of one block, built where they are used."""
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), encoding="utf-8") as lines:
        return Block([(row["item"], tokens(row["text"].encode())) for row in map(json.loads, lines)])


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES,
           chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names are returned too: numbers of the words hit, and items found."""
    hits, items = free_name(docs.columns, "hits"), free_name(docs.columns, "items")
    kinds = [T.StructField(hits, T.ArrayType(T.IntegerType())), T.StructField(items, T.ArrayType(T.StringType()))]
    names = block_files(benchmark, block_bytes)

    def found(held: list[pa.RecordBatch], only: Block | None) -> Iterator[pa.RecordBatch]:
        hit: list[list[set[int]]] = [[set() for _ in range(b.num_rows)] for b in held]
        items_of: list[list[set[str]]] = [[set() for _ in range(b.num_rows)] for b in held]
        for name in names:
            block = only or load_block(name)
            for batch, of_batch, items_of_batch in zip(held, hit, items_of, strict=True):
                for k, t in enumerate(as_bytes(batch, text)):
                    at, which = block.find(tokens(t))
                    of_batch[k].update(at)
                    items_of_batch[k] |= which
            del block
        for batch, h, i in zip(held, hit, items_of, strict=True):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([sorted(x) for x in h], pa.list_(pa.int32())), pa.array([sorted(x) for x in i], pa.list_(pa.string()))],
                names=[*batch.schema.names, hits, items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        only = load_block(names[0]) if len(names) == 1 else None
        for batch in sliced(batches, ROWS):
            held.append(batch)
            size += batch.nbytes
            if only or size >= chunk_bytes:
                yield from found(held, only)
                held, size = [], 0
        if held:
            yield from found(held, only)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *kinds])), hits, items


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per text: words, words hit, items found, their digest, and whether it is contaminated."""
    n_words = F.size(F.array_remove(F.split(blank(F.col("text")), BETWEEN), "")).cast("long")
    numbered = docs.select("doc_id", "text", n_words.alias("n_words"))
    out, hits, items = search(numbered, benchmark, block_bytes=block_bytes, chunk_bytes=chunk_bytes)
    return out.select(
        "doc_id", "n_words", F.size(hits).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(hits) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with their columns."""
    out, hits, _ = search(docs, benchmark, text)
    return out.where(F.size(hits) == 0).select(*docs.columns)
