"""What the operators' rules do: ratio of lines, schedule of the mix, order of the cascade, settings left alone."""

from collections import Counter

from pyspark.sql import functions as F

from transitloom.llm import archives, chat, lines, mixing, quality, queries, tokens
from transitloom.session import scratch_path, store_and_reload


def test_lines_above_the_ratio_go_on_small_hosts_too(spark):
    pages = [(i, ("menu\n" if i < 4 else "") + f"own words of page {i}", "sixty") for i in range(60)]
    pages += [(100 + i, f"top\nown {i}", "three") for i in range(3)] + [(200, "alone\nalone too", "one")]
    got = {r.doc_id: r.dropped_lines for r in lines.drop_boilerplate(spark.createDataFrame(pages, "doc_id int, text string, source string")).collect()}
    assert got == {i: int(i < 4 or 100 <= i < 103) for i, _, _ in pages}


def test_a_table_without_words_takes_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, " \n", None)], "doc_id int, text string, source string")
    got = mixing.taken(docs, store_and_reload).collect()
    assert sorted((r.size, r.source_size, r.target, r.taken, r.first_slot, r.n_slots) for r in got) == [(0, 0, 0.0, 0, None, 0)] * 3


def test_null_ids_are_spread_over_the_shuffle(spark):
    docs = spark.range(300).select(F.lit(None).cast("int").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w "), "id").alias("text"))
    assert mixing.sizes(docs).select("place").distinct().count() == 300


def test_every_prefix_of_the_schedule_holds_the_sources_in_proportion(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 7, F.lit(3))).alias("source"), F.repeat(F.lit("word "), 90).alias("text"))
    goal = store_and_reload(mixing.targets(mixing.sizes(docs)), "goal")
    share = {r.s: r.high - r.low for r in goal.collect()}
    made = [r.s for r in mixing.slots(goal, 4000 * 90).where(F.col("slot") < 4000 * 90 // mixing.BLOCK).orderBy("slot").collect()]
    seen = Counter()
    for n, s in enumerate(made, 1):
        seen[s] += 1
        # a van der Corput prefix is off by at most one point for each binary digit of its length, at either end of an interval
        assert all(abs(seen[k] - n * share[k]) <= 2 * n.bit_length() for k in share), n
    assert abs(sum(share.values()) - 1) < 1e-9


def test_rules_of_equal_rejection_go_by_cost(spark):
    told = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    texts = [" ".join(told) + "!" * 40, " ".join(told), " ".join(told).upper()] * 20
    sample = quality.counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    rules = {r.name: r for r in quality.RULES}
    marks, capitals = rules["exclamations"], rules["capitals"]
    assert [r.name for r in quality.plan(sample, [capitals, marks])] == ["exclamations", "capitals"]
    dear = quality.Rule("exclamations", marks.rejects, lambda: 50 * marks.work())
    assert [r.name for r in quality.plan(sample, [capitals, dear])] == ["capitals", "exclamations"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one = {tuple(r) for r in quality.judged(docs, rules=[capitals, marks]).select("row.doc_id", "kept").collect()}
    assert one == {tuple(r) for r in quality.judged(docs, rules=[capitals, dear]).select("row.doc_id", "kept").collect()}
    assert {k for _, k in one} == {True, False}


def test_no_documents_have_no_tokens(spark, none):
    path = scratch_path(spark, "no-tokens")
    tokens.write_flat(none, path)
    assert tokens.counts(spark, path).collect() == []


def test_arrow_settings_of_the_session_are_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for query in (queries.op2_simhash_near_dedup, queries.op6_chat_format, queries.op7_arc_to_warc, queries.op8_token_counts, queries.op11_vector_codes):
        query(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == before


def test_odd_pages(spark):
    kinds = "page_id bigint, url string, html string"
    path = scratch_path(spark, "no-warc")
    archives.convert(archives.legacy_archives(spark.createDataFrame([], kinds)), path)
    assert archives.read_warc(spark, path).collect() == []
    rows = [(1, "u", "x" * 3_000_000), (1, "u", "x" * 3_000_000), (2, "v", "x" * 3_000_000), (3, "u", "y")]
    pages = spark.createDataFrame(rows, kinds).selectExpr("*", "1 AS record_type", "2 AS content")
    path = scratch_path(spark, "odd-warc")
    archives.convert(archives.legacy_archives(pages), path)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.read_warc(spark, path).collect())
    assert got == [(1, 3_000_000, "response", None)] * 2 + [(2, 3_000_000, "revisit", 1), (3, 1, "response", None)]


def test_odd_turns(spark):
    long = "<|im_end|>" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS segment", "2 AS loss", "3 AS problem")
    got = {r.conv_id: r for r in chat.parse(chat.segments(turns)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].problem) == (4, 3, "assistant after assistant")
    assert (got[2].n_turns, got[2].loss_chars, got[2].problem) == (1, 0, "ends with user")
