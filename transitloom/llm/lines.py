"""Line dedup by site-relative frequency.

The pages of a host that hold a line, divided by the pages of the host; lines above the ratio are
boilerplate there and are dropped wherever they occur on that host. A line without a word is never dropped.
What stands on a single page is no boilerplate, whatever the size of the host. Rows of one host
with equal texts are one page: a text does not become boilerplate by being copied.

Nulls: a null host is a host of its own; a null text stays null and counts as an empty page. Rows that repeat
are one page, and each gets the same text. A text that loses every line becomes empty and stays. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.llm.text import SPACES, free_name

RATIO = 0.05
# A line is shared from its second page on.
FEWEST = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _counted(docs: DataFrame, host: str, text: str, ratio: float, fewest: int) -> tuple[DataFrame, DataFrame]:
    """Pages with the lines that may be boilerplate (host, page, line), and the lines that are (host, line,
    holding, pages).

    Rows are counted first, added up before they are shuffled; that count is never below the pages. Only the few
    lines that pass with it are told apart by page, so a line on a third of all pages is as cheap as any other.
    """
    page = _digest(F.coalesce(F.col(text), F.lit("")))
    pages = docs.select(F.col(host).alias("site"), page.alias("page")).groupBy("site").agg(F.countDistinct("page").alias("pages"))
    told = F.filter(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    held = docs.select(F.col(host).alias("host"), page.alias("page"), F.explode(F.array_distinct(F.transform(told, _digest))).alias("line"))

    def above(counted: DataFrame) -> DataFrame:
        often = counted.agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= fewest)
        return often.join(pages, F.col("host").eqNullSafe(F.col("site"))).drop("site").where(F.col("holding") > ratio * F.col("pages"))

    some = above(held.groupBy("host", "line")).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    found = held.join(some, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi").distinct()
    return found, above(found.groupBy("host", "line"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, fewest: int = FEWEST) -> DataFrame:
    """The lines to drop: host, digest of the line, pages that hold it and pages of the host."""
    return _counted(docs, host, text, ratio, fewest)[1]


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, fewest: int = FEWEST) -> DataFrame:
    """`docs` with the boilerplate lines taken out of the text; the number dropped is in `dropped_lines`.

    What is dropped depends on host and text alone. So the lines to drop, few for any host, come back to the
    rows by host and digest of the text.
    """
    found, bad = _counted(docs, host, text, ratio, fewest)
    bad = bad.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    site, page = free_name(docs.columns, "site"), free_name(docs.columns, "page")
    of, at, gone, kept = (free_name(docs.columns, x) for x in ("_site", "_page", "_gone", "_kept"))
    hit = found.join(bad, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi")
    lost = hit.groupBy(F.col("host").alias(of), F.col("page").alias(at)).agg(F.collect_list("line").alias(gone))
    keyed = docs.withColumns({site: F.col(host), page: _digest(F.coalesce(F.col(text), F.lit("")))})
    joined = keyed.join(lost, F.col(site).eqNullSafe(F.col(of)) & (F.col(page) == F.col(at)), "left")
    joined = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), F.filter(
        _lines(F.col(text)), lambda x: ~F.array_contains(F.col(gone), _digest(x)))))
    cleaned = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(kept).isNull(), 0).otherwise(F.size(_lines(F.col(text))) - F.size(kept))
    count = free_name(docs.columns, "dropped_lines")
    return joined.select(*(cleaned.alias(c) if c == text else F.col(c) for c in docs.columns), dropped.cast("long").alias(count))
