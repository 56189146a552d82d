"""Quality rules as a short-circuit cascade, ordered by what a sample says each rule rejects for its cost.

A rule's cost is the mean work it does on a text of the sample: the characters of each pass over it, a regular
expression's counted REGEX times, a search that guards another pass only where it lets it through, and one for
a rule on counts that are there anyway. Its selectivity is the share it rejects of what earlier rules leave. The
order never changes which texts are kept, only how much work the rejected ones cause.

Nulls: a null text has no words and fails for being short. Rows that repeat get equal verdicts; an empty
table gives an empty result, with the rules in the order of their names. Other columns pass through, those
named like a result too: the row travels in a struct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.llm.text import SPACES, blank, free_name, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEWEST_WORDS = 50
MOST_REPEATED_PER_CENT = 50


def counts(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each whole in the struct `row`, with its text and the counts.

    Windows of three words are compared by 64-bit hashes. Only texts in which two hashes agree have their
    windows sorted; the words covered by repeated windows are then counted from the sorted start positions.
    """
    text = blank(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = docs.select(F.struct(*docs.columns).alias("row"), "text", words(F.col("text")).alias("_words"), lines.alias("_lines"))
    w = F.col("_words")
    d = d.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "_hashes": F.when(F.size(w) > 2, F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>")),
    }).drop("_words", "_lines")
    h = F.col("_hashes")
    d = d.withColumn("_sorted", F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_hashes")
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    p = F.col("_starts")
    covered = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    repeated = F.aggregate(F.filter(covered, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda total, x: total + x)
    # A condition on the counts must not be pushed below the arrays, where each would be built anew for
    # every element that refers to it. The optimizer moves no condition past an expression that numbers rows.
    held = F.when(F.monotonically_increasing_id() >= 0, repeated)
    return d.select("row", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", held.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PER_CENT * F.col("n_words"))


# Steps of a regular expression at a character, in those of a plain search (measured: 6 to 11 on prose).
REGEX = 8


@dataclass(frozen=True)
class Rule:
    """A named reason to reject a text, and the work of telling, in characters looked at."""

    name: str
    rejects: Callable[[], Column]
    work: Callable[[], Column]


def _share(counted: Column, per_cent: int, of: str) -> Column:
    return 100 * counted > per_cent * F.col(of)


def _count(pattern: str) -> Column:
    return F.regexp_count(blank(F.col("text")), F.lit(pattern))


def _marks(mark: str) -> Column:
    return F.length(blank(F.col("text"))) - F.length(F.replace(blank(F.col("text")), F.lit(mark), F.lit("")))


def _guarded_ellipses() -> Column:
    """Lines that end in an ellipsis; a search for bytes passes over texts without any."""
    text = blank(F.col("text"))
    return F.when(text.contains("...") | text.contains("…"), _count(r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)")).otherwise(0)


def _chars(passes: int) -> Callable[[], Column]:
    return lambda: passes * F.length(blank(F.col("text")))


def _counts_only() -> Column:
    return F.lit(1)


def _guarded_work() -> Column:
    text = blank(F.col("text"))
    return F.length(text) * F.when(text.contains("...") | text.contains("…"), 2 + REGEX).otherwise(2)


# A word without a letter, with the white space before it.
NO_LETTER = r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
RULES = [
    Rule("alphabetic", lambda: _share(_count(NO_LETTER), 40, "n_words"), _chars(REGEX)),
    Rule("bullets", lambda: _share(_count(r"(?m)^[\x20\t]*[-*•]\x20"), 90, "n_lines"), _chars(REGEX)),
    Rule("capitals", lambda: _share(F.length(F.regexp_replace(blank(F.col("text")), r"\P{Lu}+", "")), 50, "word_chars"), _chars(REGEX + 1)),
    Rule("duplicate_lines", lambda: _share(F.col("n_dup_lines"), 40, "n_lines"), _counts_only),
    Rule("ellipses", lambda: _share(_guarded_ellipses(), 30, "n_lines"), _guarded_work),
    Rule("exclamations", lambda: _share(_marks("!"), 50, "n_words"), _chars(2)),
    Rule("symbols", lambda: _share(F.col("n_symbols"), 10, "n_words"), _counts_only),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")), _counts_only),
]


def plan(sample: DataFrame, rules: list[Rule] = RULES) -> list[Rule]:
    """The rules by rejection per cost, each judged on what the chosen ones leave of the sample.

    Only the counts of the combinations of verdicts reach the driver, with the work of each rule: at most
    two to the number of rules.
    """
    votes = sample.where(~base_failed()).select(
        *(F.coalesce(r.rejects(), F.lit(False)).alias(r.name) for r in rules), *(r.work().alias(f"_{r.name}") for r in rules))
    seen = votes.groupBy(*(r.name for r in rules)).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_{r.name}").alias(f"_{r.name}") for r in rules)).collect()
    rows = sum(x["n"] for x in seen)
    cost = {r.name: max(sum(x[f"_{r.name}"] for x in seen) / rows, 1.0) if rows else 1.0 for r in rules}
    left, order, rest = list(seen), [], sorted(rules, key=lambda r: r.name)
    while rest:
        gain = [sum(x["n"] for x in left if x[r.name]) / cost[r.name] for r in rest]
        best = rest.pop(max(range(len(rest)), key=lambda i: (gain[i], -i)))
        order.append(best)
        left = [x for x in left if not x[best.name]]
    return order


RESULTS = [*COUNTS, "base_failed", "rejected_by", "kept"]


def judged(docs: DataFrame, sample_rows: int = 2000, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of `docs`, each whole in the struct `row`, with the counts, `base_failed`, `rejected_by` (the first rule
    that rejects, or null) and `kept`.

    The order of the rules comes from a random sample of about `sample_rows` texts, a bound that does not
    grow with the table; the rules themselves judge every text.
    """
    total = docs.count()
    sample = counts(docs.select("text").sample(min(1.0, sample_rows / total), seed=17) if total else docs.select("text"))
    cascade = F.when(base_failed(), F.lit("base"))
    for rule in plan(sample, rules):
        cascade = cascade.when(rule.rejects(), F.lit(rule.name))
    made = counts(docs).withColumn("rejected_by", cascade)
    return made.withColumns({"base_failed": base_failed(), "kept": F.col("rejected_by").isNull()}).select("row", *RESULTS)


def judge(docs: DataFrame, sample_rows: int = 2000, rules: list[Rule] = RULES) -> DataFrame:
    """`docs` with the results of `judged`. A result whose name is taken gets underscores behind it."""
    return judged(docs, sample_rows, rules).select("row.*", *(F.col(c).alias(free_name(docs.columns, c)) for c in RESULTS))
