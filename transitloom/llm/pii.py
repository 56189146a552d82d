"""Personal data by weak supervision.

Candidates are all matches of the base patterns, whether or not they pass their test, and of some looser
patterns that overlap no base span. Labelers vote yes, no or not at all on each: shape (the strict form of its kind), checksum,
gazetteer (a word before it names its kind, or another), context (running prose before it, or a word or sign that speaks against it),
edge (it begins where a word may, or within one) and alone (no other digits shortly before it, or some). Counts of the combinations
of votes, a few hundred rows whatever the size of the input, go to the driver. There expectation-maximisation
estimates how reliable each labeler is and how likely each combination is to be personal data. A
classifier over features of the span is then trained on these probabilities, and decides about
candidates beyond the base, which stays as it is.

Nulls: a null text has no candidates, a null id keeps its row. Rows that repeat count each for itself.
An empty table trains nothing and adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitloom.llm.text import matches, spans_of

# Possessive repeats match what the greedy ones do and need no stack; the look-behind keeps a long run
# without an @ from being tried at each of its characters, and \\G lets a match start where one has ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = [*BASE, *LOOSE]
CONTEXT = 32
# Words that name a kind, and what speaks against any of them.
NAMES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel", "ip": "ip|address|host|client|server",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte", "phone": "phone|tel|call|mobile|fax|telefon",
    "email_spelled": "e-?mail|mail|contact|kontakt|correo|courriel", "phone_local": "phone|tel|call|mobile|fax|telefon",
    "ssn": "ssn|social security", "iban": "iban|account|konto|cuenta|compte",
}
AGAINST = r"(?i)(?:\b(?:version|release|isbn|issn|order|invoice|part|serial|build|figure|page|section|chapter|no|nr)\b[.:#\x20]*|[#§$€£=/])$"
PROSE = r"\p{Ll}{2}[,.;:]?[\x20\n]$"
BEGINS, WITHIN = r"(?:^|[\x20\x09-\x0D(\[<\"':;,])$", r"[\p{L}\p{N}_]$"
LABELERS = ["shape", "checksum", "gazetteer", "context", "edge", "alone"]
FEATURES = ["kind", *LABELERS, "width"]
SURE = 0.9
ROUNDS = 50


def _digits() -> Column:
    return F.regexp_replace("value", r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of at most 19 digits is right."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).try_cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice")))
    total = F.aggregate(at, F.lit(0), lambda a, x: a + F.when(x["twice"], F.floor(x["d"] * 2 / 10) + x["d"] * 2 % 10).otherwise(x["d"]).cast("int"))
    return total % 10 == 0


def _passes() -> Column:
    """The tests of the base kinds."""
    digits, n = _digits(), F.length(_digits())
    parts = F.split("value", r"\.")
    small = F.forall(parts, lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3) & F.forall(
        parts, lambda x: F.right(x, F.lit(3)).try_cast("int") <= 255)
    return (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", small)
            .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
            .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(False))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("kind")]


def _iban_sum_holds() -> Column:
    """Modulo 97 of the rearranged number, digit by digit."""
    plain = F.regexp_replace("value", " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    spelled = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return spelled == 1


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All candidates with their votes and features; one row without a kind for a text that has none.

    A base candidate that fails its test and is too short or long to be of its kind at all (a number of
    a few digits, say) is no candidate.
    """
    c = matches(docs, text, BASE | LOOSE, ["doc_id"], CONTEXT)
    n, kind = F.length(_digits()), F.col("kind")
    odd = (kind == "card") & ~n.between(12, 19)
    c = c.withColumn("kind", F.when(~odd, kind)).withColumn("base", F.coalesce(_passes() & F.col("kind").isNotNull(), F.lit(False)))
    named = F.regexp_like("before", F.concat(F.lit(r"(?i)\b(?:"), _by_kind(NAMES), F.lit(r")\b[^\n]{0,16}$")))
    of_another = F.col("before").rlike(r"(?i)\b(?:" + "|".join(dict.fromkeys(NAMES.values())) + r")\b[^\n]{0,16}$")
    strict = (F.when(kind.isin(*BASE), F.col("base")).when(kind == "email_spelled", F.col("value").rlike(r"[\[(](?:dot|DOT)[\])]"))
              .when(kind == "phone_local", F.col("value").rlike(r"^\([0-9]{3}\)\x20"))
              .when(kind == "ssn", ~F.col("value").rlike("^(?:000|666|9)|-00-|-0000$")).when(kind == "iban", F.lit(True)))
    sums = F.when(kind == "card", F.when(F.col("base"), 1).otherwise(-1)).when(
        kind == "iban", F.when(_iban_sum_holds(), 1).otherwise(-1)).otherwise(0)
    return c.withColumns({
        "shape": _vote(strict, ~strict), "checksum": sums, "gazetteer": _vote(named, of_another),
        "context": F.when(F.col("before").rlike(AGAINST), -1).when(F.col("before").rlike(PROSE), 1).otherwise(0),
        "edge": _vote(F.col("before").rlike(BEGINS), F.col("before").rlike(WITHIN)),
        "alone": _vote(~F.col("before").rlike("[0-9]"), F.col("before").rlike("[0-9]")),
        "width": F.least(F.floor(F.length("value") / 8), F.lit(4)).cast("int"),
    })


def reliabilities(seen: list[dict], rounds: int = ROUNDS) -> tuple[dict[str, float], list[float]]:
    """Expectation-maximisation over counted combinations of votes: each labeler's accuracy, and the
    probability that each combination is personal data. An abstention says nothing; accuracies start at 0.8
    and are smoothed by two right and one wrong vote."""
    right = dict.fromkeys(LABELERS, 0.8)
    prior, sure = 0.5, [0.5] * len(seen)
    for _ in range(rounds):
        sure = []
        for row in seen:
            odds = math.log(prior / (1 - prior))
            for name in LABELERS:
                odds += row[name] * math.log(right[name] / (1 - right[name]))
            sure.append(1 / (1 + math.exp(-odds)))
        total = sum(row["n"] for row in seen)
        prior = (1 + sum(row["n"] * p for row, p in zip(seen, sure, strict=True))) / (2 + total)
        for name in LABELERS:
            voting = [(row, p) for row, p in zip(seen, sure, strict=True) if row[name]]
            agree = sum(row["n"] * (p if row[name] > 0 else 1 - p) for row, p in voting)
            right[name] = min((2 + agree) / (3 + sum(row["n"] for row, _ in voting)), 0.99)
    return right, sure


def classifier(seen: list[dict], sure: list[float]) -> tuple[float, dict[tuple[str, object], float]]:
    """Weights of evidence of each feature value under the estimated probabilities, counts smoothed by one."""
    yes = sum(r["n"] * p for r, p in zip(seen, sure, strict=True))
    no = sum(r["n"] for r in seen) - yes
    weights = {}
    for name in FEATURES:
        values = sorted({r[name] for r in seen}, key=str)
        for v in values:
            has = [(r["n"], p) for r, p in zip(seen, sure, strict=True) if r[name] == v]
            y, n = sum(k * p for k, p in has), sum(k * (1 - p) for k, p in has)
            weights[name, v] = math.log((y + 1) / (yes + len(values))) - math.log((n + 1) / (no + len(values)))
    return math.log((yes + 1) / (no + 1)), weights


def beside_base(found: DataFrame) -> DataFrame:
    """The candidates without those of looser kinds that overlap a base span of their text, which stays."""
    base = F.coalesce("base", F.lit(False))
    text = W.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(text.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(text.rowsBetween(0, W.unboundedFollowing))
    overlaps = F.col("kind").isin(*LOOSE) & F.coalesce((before > F.col("start")) | (after < F.col("end")), F.lit(False))
    return found.withColumn("__out", overlaps).where(~F.coalesce("__out", F.lit(False))).drop("__out")


def train(found: DataFrame) -> tuple[float, dict[tuple[str, object], float]]:
    seen = [r.asDict() for r in found.where(F.col("kind").isNotNull()).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()]
    seen.sort(key=lambda r: [str(r[f]) for f in FEATURES])
    return classifier(seen, reliabilities(seen)[1])


def scored(found: DataFrame, model: tuple[float, dict[tuple[str, object], float]]) -> DataFrame:
    """The candidates with `score`, the classifier's probability."""
    start, weights = model
    odds = F.lit(start)
    for name in FEATURES:
        of = [(v, w) for (f, v), w in weights.items() if f == name]
        if of:
            odds = odds + F.coalesce(F.create_map(*(F.lit(x) for vw in of for x in vw))[F.col(name)], F.lit(0.0))
    return found.withColumn("score", 1 / (1 + F.exp(-odds)))


def scan(docs: DataFrame, store: Callable[[DataFrame, str], DataFrame], text: str = "text") -> DataFrame:
    """One row for each text: counts of the base kinds, the digest of their spans, and all spans.

    `store` writes the candidates to the shared folder and reads them back, as they train the classifier
    and are then judged by it. A candidate of a looser kind is added if its score reaches SURE.
    """
    found = beside_base(store(candidates(docs, text), "pii-candidates"))
    judged = scored(found, train(found))
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    base = F.coalesce("base", F.lit(False))
    added = F.col("kind").isin(*LOOSE) & (F.col("score") >= SURE)
    return judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE),
        F.sha2(spans_of(base, order).cast("binary"), 256).alias("base_sha256"),
        spans_of(base | F.coalesce(added, F.lit(False)), order).alias("spans"),
    ).drop("row")
