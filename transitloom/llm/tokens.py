"""Token counts by a separator scan.

A flat token file holds the tokens of one document after another as two-byte big-endian numbers, each document ended by a separator
and nothing else: no index, no lengths. The scan looks at a block of the file at a time: the separators of the block
are found in one vector comparison. A prefix scan over the blocks adds the tokens and separators before each, and
stitches documents that cross a border.

Nulls: a null text has no tokens, a null id stays null. Ids are whole numbers: the files beside the tokens hold them as
digits, which the separator cannot be part of. Rows that repeat are documents each. Without documents no file is written, and the result is empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitloom.llm.archives import unzipped
from transitloom.llm.text import as_bytes, sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# An identifier beyond the vocabulary whose two bytes are one character, so that Spark's text writer can put it.
SEPARATOR = 0xC480
FILE_DOCUMENTS = 20000
BLOCK_TOKENS = 1 << 19
ROWS = 256


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> None:
    """Token files below `kind=tokens`, and below `kind=ids` files of the same names with the ids in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(vocabulary).encode_ordinary, 0
        for batch in sliced(batches, ROWS):
            ids, texts = (c.to_pylist() for c in batch.columns)
            flat = [np.array(encode(t or ""), dtype=">u2").tobytes() for t in texts]
            numbers = range(at, at + len(ids))
            at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["ids"] * len(ids) + ["tokens"] * len(ids)), pa.array([*numbers, *numbers], pa.int64()),
                 pa.array([b"" if i is None else str(i).encode() for i in ids] + flat, pa.binary())],
                names=["kind", "at", "value"])

    made = docs.select("doc_id", "text").mapInArrow(run, "kind string, at long, value binary")
    made.sortWithinPartitions("kind", "at").select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option(
        "lineSep", separator.to_bytes(2, "big").decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)


def files_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """File name and content of the files of one kind below a path; none where no document was written."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    kept = found.where(F.col("kind") == kind) if "kind" in found.columns else found.limit(0)
    return kept.select(F.regexp_extract("path", r"(part-[^/]*)$", 1).alias("file"), "content")


def blocks(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each block of flat files (file, content): its length and the positions of its separators.

    A file that doesn't end with a separator gets one behind its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), as_bytes(batch, "content"), strict=True):
                n, closed = 0, True
                for piece in _blocks_of(unzipped(data), 2 * block_tokens):
                    ids = np.frombuffer(piece, ">u2")
                    closed = ids[-1] == separator
                    yield _block(name, n, len(ids), np.flatnonzero(ids == separator))
                    n += 1
                if not closed:
                    yield _block(name, n, 1, np.zeros(1, dtype=np.int64))

    return files.mapInArrow(run, "file string, block long, tokens long, seps array<bigint>")


def _block(name: str, n: int, tokens: int, seps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64()), pa.array([seps.astype(np.int64)], pa.list_(pa.int64()))],
        names=["file", "block", "tokens", "seps"])


def _blocks_of(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Pieces of any size as blocks of one size, but for the last."""
    held = b""
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def documents(scanned: DataFrame) -> DataFrame:
    """One row for each document: file, its number in the file, where it starts and how many tokens it has."""
    upto = W.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    started = scanned.withColumn("start", F.sum("tokens").over(upto) - F.col("tokens"))
    placed = started.withColumns({
        "ahead": F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)),
        "ended": F.coalesce(F.max(F.col("start") + F.element_at(F.col("seps"), F.when(F.size("seps") > 0, -1))).over(before), F.lit(-1)),
    })
    at = placed.select("file", "ahead", "start", "ended", "seps", F.posexplode("seps").alias("k", "sep"))
    begin = F.when(F.col("k") == 0, F.col("ended")).otherwise(F.col("start") + F.get("seps", F.col("k") - 1)) + 1
    return at.select("file", (F.col("ahead") + F.col("k")).alias("number"), begin.alias("begin"),
                     (F.col("start") + F.col("sep") - begin).alias("n_tokens"))


IDS = "file string, number long, doc_id long"


def ids(files: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """The ids beside flat files: file, number in the file, doc_id."""
    mark = separator.to_bytes(2, "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), as_bytes(batch, "content"), strict=True):
                told = b"".join(unzipped(data)).split(mark)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(told), pa.string()), pa.array(range(len(told)), pa.int64()),
                     pa.array([int(x) if x else None for x in told], pa.int64())], names=["file", "number", "doc_id"])

    return files.mapInArrow(run, IDS)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens of every document in the flat files that `write_flat` has put below a path."""
    found = documents(blocks(files_of(spark, path, "tokens")))
    return found.join(ids(files_of(spark, path, "ids")), ["file", "number"], "full").select("doc_id", "n_tokens")
