"""Words, matches and row carriage shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# What runs in Python workers travels by value, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for a null."""
    return F.array_remove(F.split(blank(text), GAP), "")


PIECE = "array<struct<kind:string,gap:bigint,hit:string,before:string>>"


def pieces(text: Column, kind: str, pattern: str, context: int = 0) -> Column:
    """A text cut at the matches of one pattern: what precedes each match, and the match.

    Texts without a match give an empty array and are searched once. The last piece has no match.
    """
    cut = F.zip_with(
        F.split(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(
            F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), hit.alias("hit"),
            F.right(gap, F.lit(context)).alias("before"),
        ),
    )
    return F.when(text.rlike(pattern), cut.cast(PIECE)).otherwise(F.array().cast(PIECE))


def matches(docs: DataFrame, text: str, patterns: dict[str, str], keep: list[str], context: int = 0) -> DataFrame:
    """One row for each match, with its code-point positions; one row without a kind for a text that has none.

    Rows carry `row`, a number of the input row, so equal or null ids stay apart. Positions are running
    sums over the pieces of one text, so a text with very many matches costs no more for each of them.
    """
    body = blank(F.col(text))
    found = docs.select(
        *keep, F.monotonically_increasing_id().alias("row"),
        F.concat(*(pieces(body, kind, p, context) for kind, p in patterns.items())).alias("cut"),
    ).select(*keep, "row", F.posexplode_outer("cut").alias("at", "piece"))
    upto = W.partitionBy("row", "kind").orderBy("at")
    placed = found.select(*keep, "row", "at", "piece.*").withColumns({
        "start": F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(upto) - F.coalesce(F.length("hit"), F.lit(0)),
        "after": F.lead("gap").over(upto),
    })
    # the piece behind the last match stays only where it stands for the whole text
    return placed.where(F.col("hit").isNotNull() | F.col("kind").isNull()).select(
        *keep, "row", "kind", F.col("hit").alias("value"), "before", "start",
        (F.col("start") + F.length("hit")).alias("end"),
    )


def span_text(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


def spans_of(when: Column, order: Column) -> Column:
    """The spans of one text for which a condition holds, by start, then by the given order of kinds."""
    listed = F.sort_array(F.collect_list(F.when(when, F.struct(
        F.col("start").alias("start"), order.alias("order"), F.col("end").alias("end"),
        span_text(F.col("kind"), F.col("start"), F.col("end")).alias("span")))))
    return F.array_join(F.transform(listed, lambda x: x["span"]), ",")


def free_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows. What a worker makes of a batch is bounded by this; the size of the batches that
    Spark sends stays as the session has it, as a setting would reach every other query of the session too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def add_columns(df: DataFrame, rows: int, names: list[str], types: str,
                work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Append columns computed batch by batch; the other columns pass through untouched.

    `names` must be free in `df`; `types` is their schema in the same order.
    """
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(types).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
