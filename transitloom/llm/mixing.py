"""Mixing sources to target weights by a low-discrepancy schedule.

Van der Corput points are mapped through the cumulative target shares, so every stretch of the schedule
holds the sources in proportion. Slots are ranked within their source and take its blocks in that order:
equal numbers of words of the shuffled source, passed over again where the target exceeds its size.

Nulls: a null text has no words, a null source is a source of its own and comes last, a text with a null id
is placed in the shuffle by its content. Rows that repeat stay apart. A text without words, and every row of an empty table, takes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitloom.llm.text import words

BLOCK = 256
SLOTS_RANKED_TOGETHER = 16384
CELLS = 1024
BITS = 40
MOST_PASSES = 3


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Words of each text, and the place of the text in the shuffle of its source."""
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).cast("binary")).alias("place"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: its words, weight, target and interval of cumulative shares.

    Sources by code point, null last, weigh 1, 2, 3 and so on again. A target stops at three times the
    source's size; what exceeds it is shared by weight among the others. With sources sorted by the level
    at which each stops, the common level is the first that does not pass its own source's stop.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everyone = W.partitionBy()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("s", F.row_number().over(by_name)).withColumns({
        "weight": (F.col("s") - 1) % 3 + 1, "stop": MOST_PASSES * F.col("source_size"),
    }).withColumns({"full_at": F.col("stop") / F.col("weight"), "words": F.sum("source_size").over(everyone),
                    "weights": F.sum("weight").over(everyone)})
    by_stop = W.orderBy("full_at", "s")
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("level", (F.col("words") - F.coalesce(F.sum("stop").over(before), F.lit(0)))
                         / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    first = by_stop.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("common", F.first(F.when(F.col("full_at") >= F.col("level"), F.col("level")), ignorenulls=True).over(first))
    per = per.withColumn("target", F.when(F.col("full_at") < F.col("common"), F.col("stop").cast("double"))
                         .otherwise(F.col("common") * F.col("weight")))
    upto = W.orderBy("s")
    per = per.withColumn("high", F.coalesce(F.try_divide(F.sum("target").over(upto), F.sum("target").over(everyone)), F.lit(0.0)))
    quota, blocks = F.floor("target"), F.ceil(F.col("source_size") / BLOCK)
    whole = F.floor(F.try_divide(quota, F.col("source_size")))
    return per.select(
        "s", "source", "source_size", "target", F.coalesce(F.lag("high").over(upto), F.lit(0.0)).alias("low"), "high",
        quota.alias("quota"), blocks.alias("blocks"),
        F.when(F.col("source_size") > 0,
               whole * blocks + F.ceil((quota - whole * F.col("source_size")) / BLOCK)).otherwise(0).cast("long").alias("need"),
    )


def slots(goal: DataFrame, words_in_all: int) -> DataFrame:
    """The schedule: slot number, source and rank of the slot within its source.

    Ranks are counted in stretches of the schedule and added up over them, so no source is ranked in one
    task. A source that its points leave short of its target gets the slots it lacks at the end.
    """
    spark = goal.sparkSession
    n = -(-words_in_all // BLOCK)
    point = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn(
        "cell", F.floor(F.col("point") * CELLS))
    cells = goal.where("high > low").select("s", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    # the last interval is closed: its upper end may be a rounding error below one
    top = goal.agg(F.max("high")).first()[0] or 1.0
    inside = (F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | (F.col("high") == F.lit(top)))
    drawn = points.join(cells, "cell").where(inside).select(
        "slot", "s", F.floor(F.col("slot") / SLOTS_RANKED_TOGETHER).alias("stretch"))
    ahead = drawn.groupBy("s", "stretch").count().withColumn(
        "ahead", F.sum("count").over(W.partitionBy("s").orderBy("stretch")) - F.col("count"))
    ranked = drawn.withColumn("within", F.row_number().over(W.partitionBy("s", "stretch").orderBy("slot")) - 1).join(
        ahead, ["s", "stretch"]).select("slot", "s", (F.col("ahead") + F.col("within")).alias("rank"))
    had = ahead.groupBy("s").agg(F.sum("count").alias("had"))
    short = goal.join(had, "s", "left").where(F.col("need") > F.coalesce("had", F.lit(0))).select(
        "s", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(short.select((F.lit(n) + F.col("rank")).alias("slot"), "s", "rank"))


def mix(docs: DataFrame, store: Callable[[DataFrame, str], DataFrame], unused: bool = False, seed: str = "mix") -> DataFrame:
    """The mix: for each slot, the stretches of texts it takes (`pass`, `word_from`, `taken` words of `doc_id`).

    `store` writes a frame to the shared folder and reads it back. `unused` adds rows without a slot for
    the texts, or parts of texts, that no slot takes. `s`, `shard` and `number` name an input row.
    """
    sized = store(sizes(docs, seed), "mix-sizes")
    goal = store(targets(sized), "mix-targets")
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    # offsets in the shuffled source: within shards of it, then over the shards
    rows = sized.withColumn("shard", F.substring("place", 1, 3)).join(
        goal.select("s", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    shards = rows.groupBy("s", "shard").agg(F.sum("size").alias("held")).select(
        "s", "shard", (F.sum("held").over(W.partitionBy("s").orderBy("shard")) - F.col("held")).alias("ahead"))
    in_shard = W.partitionBy("s", "shard").orderBy("place", "doc_id", "size")
    rows = rows.withColumns({
        "number": F.row_number().over(in_shard),
        "offset": F.sum("size").over(in_shard.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"),
    }).join(shards, ["s", "shard"]).withColumn("offset", F.col("offset") + F.col("ahead")).drop("ahead")
    last = F.floor((F.col("offset") + F.col("size") - 1) / BLOCK)
    parts = rows.withColumn("block", F.explode_outer(
        F.when(F.col("size") > 0, F.sequence(F.floor(F.col("offset") / BLOCK), last))))
    plan = slots(goal, total).join(goal.select("s", "blocks", "need"), "s").where("rank < need").select(
        "slot", "s", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))
    begin = F.greatest("offset", F.col("block") * BLOCK)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * BLOCK)
    left = F.col("quota") - F.col("pass") * F.col("source_size") - begin
    joined = parts.join(plan, ["s", "block"], "left" if unused else "inner").join(
        goal.select("s", "source_size", "target", "quota"), "s")
    return joined.select(
        "slot", "s", "shard", "number", "doc_id", "source", "size", "source_size", "target", "pass", "block",
        (begin - F.col("offset")).alias("word_from"),
        F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(F.least(end - begin, left), F.lit(0))).cast("long").alias("taken"),
    )


def taken(docs: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """For each row of the input, the words that the mix takes of it, repeats counted, with the first slot of the
    schedule that takes any and the number of slots that do."""
    used = F.when(F.col("taken") > 0, F.col("slot"))
    return mix(docs, store, unused=True).groupBy("s", "shard", "number").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken"),
        F.min(used).alias("first_slot"), F.count(used).alias("n_slots"),
    ).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
