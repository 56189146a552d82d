"""Secret scan with linking of the parts of a credential.

Strong findings (`assign`, `access`, `hex`) are reported as they are. Weak ones are reported only next to
what completes them: a weak secret near an access identifier, a login near a secret, an endpoint near
both. Parts are linked when at most REACH characters lie between them, by an interval join within each
text: in order of position, the furthest end seen so far and the nearest start to come say for every part
at once whether one of another role lies within reach, so no pairs are made.

Nulls: a null text has no findings, a null id keeps its row. Rows that repeat are scanned each for itself;
an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitloom.llm.text import matches, spans_of

REACH = 200
STRONG = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
WEAK = {
    "key": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}",
    "passphrase": r"""(?i:pass|pwd|passphrase|credential)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{6,}""",
    "login": r"""(?i:user|username|user_id|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "endpoint": r"""(?i:https?|ftp|s3|jdbc:[a-z]+|mongodb|postgres|postgresql|redis|amqp)://[^\x20\x09-\x0D"'<>]+""",
}
KINDS = [*STRONG, *WEAK]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "key": "secret", "passphrase": "secret", "login": "id", "endpoint": "endpoint"}
SHORTEST_VALUE = 12
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""


def findings(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """All parts with their role, whether they are strong, and `reported`; one row without a kind for a text that has none."""
    found = matches(docs, text, STRONG | WEAK, ["doc_id"])
    value = F.regexp_extract("value", VALUE, 1)
    short = (F.col("kind") == "assign") & (F.length(value) < SHORTEST_VALUE)
    # a text whose only matches fail keeps a row without a kind
    found = found.withColumn("kind", F.when(~short, F.col("kind")))
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")]
    found = found.withColumns({"role": role, "strong": F.col("kind").isin(*STRONG)})
    ahead = W.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    near = {
        r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("end"))).over(ahead) + reach >= F.col("start"), F.lit(False))
        | F.coalesce(F.min(F.when(F.col("role") == r, F.col("start"))).over(behind) <= F.col("end") + reach, F.lit(False))
        for r in ("id", "secret")
    }
    linked = (F.when(F.col("role") == "secret", near["id"]).when(F.col("role") == "id", near["secret"])
              .when(F.col("role") == "endpoint", near["id"] & near["secret"]))
    return found.withColumn("reported", F.col("strong") | linked)


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each text: counts of strong findings, the digest of their spans, and all reported spans."""
    found = findings(docs, text, reach)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    strong = F.coalesce("strong", F.lit(False))
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in STRONG),
        F.sha2(spans_of(strong, order).cast("binary"), 256).alias("base_sha256"),
        spans_of(F.coalesce("reported", F.lit(False)), order).alias("spans"),
    ).drop("row")
