"""One registered query for each operator, over its whole table, and the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.llm import archives, chat, decontam, langid, lines, mixing, pii, quality, secrets, simhash, tokens, vectorcodes, whitening
from transitloom.session import scratch_path, store_and_reload


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"), store_and_reload)


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), store_and_reload)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "source", "dropped_lines", "text")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select("row.doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for n, role in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    return chat.parse(chat.segments(turns.unionByName(more)))


def op7_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archives.convert(archives.legacy_archives(table(spark, folder, "pages")), path)
    return archives.read_warc(spark, path)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_flat(table(spark, folder, "documents"), path)
    return tokens.counts(spark, path)


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_pii_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"), store_and_reload)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.codes(table(spark, folder, "embeddings"), store_and_reload)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"), store_and_reload)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.held_out(table(spark, folder, "documents"), store_and_reload)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_simhash_near_dedup, op3_line_dedup, op4_quality_rules, op5_secret_scan, op6_chat_format,
    op7_arc_to_warc, op8_token_counts, op9_benchmark_decontamination, op10_pii_weak_supervision,
    op11_vector_codes, op12_embedding_whitening, op13_language_id)}

# ---- the checks --------------------------------------------------------------------------------------
# White space between words; the engine of the checks reads the same classes.
GAP = r"[\x20\x09-\x0D]+"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{GAP}'), lambda x: x <> '')"


MIX_SQL = f"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len({words_sql('text')}) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place FROM {{documents}}),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
levels AS (
  SELECT *, 3 * source_size / weight AS full_at,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, full_at) AS common FROM levels WHERE full_at >= level),
goal AS (
  SELECT source, source_size, CASE WHEN full_at < common THEN CAST(3 * source_size AS DOUBLE) ELSE common * weight END AS target FROM levels, common),
share AS (
  SELECT *, sum(target) OVER w / sum(target) OVER () AS high, CAST(ceil(source_size / {mixing.BLOCK}) AS BIGINT) AS blocks, max(rank) OVER () AS top FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM goal) WINDOW w AS (ORDER BY rank)),
point AS (
  SELECT slot, list_sum(list_transform(range(0, {mixing.BITS}), lambda b: ((slot >> b) & 1) / pow(2, b + 1))) AS x
  FROM range(0, CAST(ceil((SELECT sum(size) FROM sized) / {mixing.BLOCK}) AS BIGINT)) slots(slot)),
drawn AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM point JOIN (SELECT *, coalesce(lag(high) OVER (ORDER BY rank), 0) AS low FROM share) ON x >= low AND (x < high OR rank = top)),
needed AS (
  SELECT *, unnest(range(0, CAST(3 * blocks AS BIGINT))) AS k FROM share),
ranked AS (
  SELECT n.source, n.k // n.blocks AS pass, n.k % n.blocks AS block, coalesce(d.slot, (SELECT count(*) FROM point) + n.k) AS slot
  FROM needed n LEFT JOIN drawn d ON d.source IS NOT DISTINCT FROM n.source AND d.rank = n.k),
placed AS (
  SELECT s.row, s.doc_id, s.source, s.size, CAST(g.source_size AS BIGINT) AS source_size, g.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS begin
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(sum(part) AS BIGINT) AS taken, min(slot) FILTER (part > 0) AS first_slot, count(slot) FILTER (part > 0) AS n_slots
FROM (
  SELECT p.*, slot, greatest(least(begin + size, (block + 1) * {mixing.BLOCK}, floor(target) - pass * source_size) - greatest(begin, block * {mixing.BLOCK}), 0) AS part
  FROM placed p LEFT JOIN ranked r ON r.source IS NOT DISTINCT FROM p.source AND p.size > 0
    AND (block + 1) * {mixing.BLOCK} > begin AND block * {mixing.BLOCK} < begin + size)
GROUP BY row, doc_id, size, source_size, target"""

LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, *, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{documents}}),
held AS (SELECT DISTINCT source, coalesce(text, '') AS page, unnest(lines) AS line FROM d),
often AS (SELECT source, line, count(*) AS holding FROM held WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line HAVING count(*) >= {lines.FEWEST}),
bad AS (
  SELECT o.source, list(o.line) AS bad FROM often o JOIN (SELECT source, count(DISTINCT coalesce(text, '')) AS pages FROM {{documents}} GROUP BY source) p
    ON o.source IS NOT DISTINCT FROM p.source WHERE holding > {lines.RATIO} * pages GROUP BY o.source)
SELECT d.doc_id, d.source,
  len(lines) - len(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false))) AS dropped_lines,
  CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)), chr(10)) END AS text
FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source"""

QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {words_sql('text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM {{documents}}),
grams AS (SELECT row, i, w[i:i+2] AS gram FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 3) g(k) GROUP BY row),
c AS (
  SELECT d.row, doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, w, lines
  FROM d LEFT JOIN covered ON covered.row = d.row),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\\pL'))) > 40 * n_words
    OR 100 * len(regexp_extract_all(text, '(?m)^[\\x20\\t]*[-*•]\\x20')) > 90 * n_lines
    OR 100 * (length(text) - length(regexp_replace(text, '\\p{{{{Lu}}}}', '', 'g'))) > 50 * word_chars
    OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * len(regexp_extract_all(text, '(?:\\.\\.\\.|…)[\\x20\\t\\r]*(?:\\n|$)')) > 30 * n_lines
    OR 100 * (length(text) - length(replace(text, '!', ''))) > 50 * n_words
    OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rejected
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v"""


def _found_sql(kind: str, pattern: str, test: str = "true") -> str:
    """Matches of a pattern with positions, from the pieces between them. Patterns have no look-around here."""
    p = pattern.replace("'", "''")
    return f"""
SELECT row, '{kind}' AS kind, start, start + length(value) AS "end", value FROM (
  SELECT row, value, sum(length(gap) + length(value)) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) - length(value) AS start
  FROM (SELECT row, unnest(regexp_split_to_array(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS value,
    unnest(range(1, len(regexp_split_to_array(text, '{p}')) + 1)) AS i FROM d WHERE regexp_matches(text, '{p}'))) WHERE value IS NOT NULL AND {test}"""


# A key has no look-around here: maximal runs of its characters, tested for what they hold.
_PARTS = {
    **secrets.STRONG, **secrets.WEAK,
    "key": "[A-Za-z0-9+/_-]+",
}
_TESTS = {
    "assign": f"length(regexp_extract(value, '{secrets.VALUE.replace(chr(39), chr(39) * 2)}', 1)) >= {secrets.SHORTEST_VALUE}",
    "key": "length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')",
}
_ROLE = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{r}'" for k, r in secrets.ROLES.items()) + " END"
_ORDER = "list_position([" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "], kind)"


def _near_sql(role: str) -> str:
    return (f"EXISTS (SELECT 1 FROM parts q WHERE q.row = p.row AND q.role = '{role}' AND q.start <= p.\"end\" + {secrets.REACH} "
            f"AND q.\"end\" + {secrets.REACH} >= p.start)")


_SPAN = "concat(kind, ':', start, ':', \"end\")"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {{documents}}),
parts AS (SELECT *, {_ROLE} AS role, kind IN ({', '.join(f"'{k}'" for k in secrets.STRONG)}) AS strong FROM (
{" UNION ALL ".join(_found_sql(k, p, _TESTS.get(k, 'true')) for k, p in _PARTS.items())})),
judged AS (
  SELECT *, strong OR CASE role WHEN 'secret' THEN {_near_sql('id')} WHEN 'id' THEN {_near_sql('secret')}
    ELSE {_near_sql('id')} AND {_near_sql('secret')} END AS reported FROM parts p)
SELECT first(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY start, {_ORDER}) FILTER (strong), '')) AS base_sha256,
  coalesce(string_agg({_SPAN}, ',' ORDER BY start, {_ORDER}) FILTER (reported), '') AS spans
FROM d LEFT JOIN judged j ON j.row = d.row GROUP BY d.row"""

CHAT_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
moved AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS prev, lead(n) OVER w IS NULL AS last
  FROM (SELECT *, 0 AS n FROM said) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
t AS (
  SELECT *, CASE WHEN n = 1 THEN role NOT IN ('system', 'user')
    ELSE (prev, role) NOT IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS wrong,
    CASE role WHEN '' THEN 'no role' ELSE role END || ' after ' || CASE WHEN n = 1 OR prev = '' THEN 'the start' ELSE prev END AS move
  FROM moved)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + len(regexp_extract_all(role, '[\\\\|\\n]')) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars,
  coalesce(arg_min(move, n) FILTER (wrong), 'ends with ' || arg_max(role, n) FILTER (last AND role <> 'assistant')) AS problem
FROM t GROUP BY conv_id"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "CAST('0x' || substr(hex, g * 5 + 1, 5) AS BIGINT)"
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: {' || '.join(f"substr('{_BASE32}', (({_FIVE} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN m USING (hex)"""

_WORD9 = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
DECONTAM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORD9} AS w FROM {{documents}}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORD9} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), {decontam.WINDOW}) AS k FROM b WHERE len(w) > 0),
strings AS (
  SELECT DISTINCT item, k, w[i:i+k-1] AS s FROM (
    SELECT item, w, least(len(w), {decontam.WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {decontam.WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
stretches AS (SELECT row, i, k, w[i:i+k-1] AS s FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hits AS (SELECT row, i, x.k, item FROM stretches x JOIN strings y ON x.k = y.k AND x.s = y.s),
words AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.row = d.row LEFT JOIN items ON items.row = d.row"""

_PART = f"x[p * (len(x) // {vectorcodes.PARTS}) + 1:(p + 1) * (len(x) // {vectorcodes.PARTS})]"
_PLACES = f"range(0, {vectorcodes.PARTS}) places(p)"


def _nearest_sql(book: str) -> str:
    """Squared distance and entry of the nearest in one number, so that ties go to the lower entry."""
    apart = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))"
    return f"SELECT row, p, any_value(v) AS v, min(CAST({apart} AS BIGINT) * 256 + k) AS near FROM part JOIN {book} USING (p) GROUP BY row, p"


def _refined_sql(near: str, book: str) -> str:
    mean = "list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i)"
    return f"""
SELECT p, k, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN (
  SELECT p, k, {mean} AS e FROM (
    SELECT p, near % 256 AS k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {near}) GROUP BY p, near % 256, i)
  GROUP BY p, k) m USING (p, k)"""


CODES_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {vectorcodes.SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS (SELECT row, p, {_PART} AS v FROM usable, {_PLACES}),
first AS (SELECT x, row_number() OVER (ORDER BY vec_id, x) - 1 AS k FROM usable QUALIFY k < {vectorcodes.ENTRIES}),
book0 AS (SELECT p, k, {_PART} AS e FROM first, {_PLACES}),
near0 AS ({_nearest_sql("book0")}), book1 AS ({_refined_sql("near0", "book0")}),
near1 AS ({_nearest_sql("book1")}), book2 AS ({_refined_sql("near1", "book1")}),
near2 AS ({_nearest_sql("book2")}),
coded AS (
  SELECT row, string_agg(printf('%02x', near % 256), '' ORDER BY p) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN usable USING (row), digest"""

DOCUMENTS_SQL = {
    "op1_mix_sources": MIX_SQL, "op3_line_dedup": LINES_SQL, "op4_quality_rules": QUALITY_SQL,
    "op5_secret_scan": SECRETS_SQL, "op9_benchmark_decontamination": DECONTAM_SQL,
}
ORACLE = {name: sql.replace("{documents}", "documents").replace("{{", "{").replace("}}", "}").strip() for name, sql in DOCUMENTS_SQL.items()}
ORACLE |= {"op6_chat_format": CHAT_SQL.strip(), "op7_arc_to_warc": WARC_SQL.strip(), "op11_vector_codes": CODES_SQL.strip()}
