"""Language identification: held-out accuracy, filters against plain sets, odd rows."""

import zlib

import numpy as np

from transitloom.llm import langid
from transitloom.llm.queries import QUERIES
from transitloom.session import store_and_reload

FOLDER = "/root/testdata/sf0.001"


def test_held_out_documents_are_told_apart(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op13_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]
    assert len(out) > 20 and sum(out) >= 0.95 * len(out)


def plain_grams(text):
    low = "".join(c.lower() if c.isalpha() else " " for c in text)
    one = " " + " ".join(low.split()) + " "
    return [one[i:i + n] for n in langid.ORDERS for i in range(len(one) - n + 1)]


def hashed(text):
    codes = langid.folded(text, langid.folding())
    return np.concatenate([h for p in langid.chunks([(0, codes)]) for h, _ in langid.grams(*p)])


def test_grams_are_those_of_a_plain_version():
    for text in ("Das ist, ein Text!", "a", "É 1 b\n\n_c", "x" * 50):
        want, got = plain_grams(text), hashed(text)
        assert len(want) == len(got) and len(set(want)) == len(set(got.tolist()))
        assert [want.index(g) for g in want] == [got.tolist().index(g) for g in got.tolist()]


def test_long_texts_are_cut_without_losing_grams():
    codes = langid.folded("one two three four five six seven " * 40, langid.folding())
    whole = sorted(h for p in langid.chunks([(0, codes)]) for x, _ in langid.grams(*p) for h in x.tolist())
    for size in (7, 64, 333):
        pieces = list(langid.chunks([(5, codes), (6, codes)], size))
        assert max(len(p[0]) for p in pieces) <= max(size, size + max(langid.ORDERS) - 1)
        for owner in (5, 6):
            assert sorted(h for p in pieces for x, k in langid.grams(*p) for h in x[k == owner].tolist()) == whole


def test_filters_hold_all_their_grams_and_corrected_counts_are_near_the_sets():
    rng = np.random.default_rng(2)
    languages = [f"l{i:02d}" for i in range(11)]
    sets = [rng.integers(-2**62, 2**62, 900 + 40 * k) for k in range(11)]
    model = langid.build(languages, [(int(g), k) for k, s in enumerate(sets) for g in s], 0)
    assert model.table.shape[1] == 2
    other = rng.integers(-2**62, 2**62, 20000).view(np.uint64)
    for k, s in enumerate(sets):
        def has(h, k=k):
            mask = np.bitwise_and.reduce([model.table[a] for a in langid.slots_of(h, len(model.table))])
            return mask[:, k >> 3] >> (k & 7) & 1
        assert has(s.view(np.uint64)).all()
        assert abs(has(other).mean() - model.false_rate[k]) < 0.02


def test_odd_rows_have_defined_results(spark, odd, none):
    model = langid.train(odd, store_and_reload)
    found, guess, sure = langid.identify(odd.selectExpr("*", "1 AS lang_pred", "2 AS score"), model)
    rows = [(r.text, r[guess], r[sure], r.lang_pred, r.score) for r in found.collect()]
    assert len(rows) == odd.count() and all(r[3:] == (1, 2) for r in rows)
    assert {(r[1], r[2]) for r in rows if not r[0] or not r[0].strip()} == {("und", 0.0)}
    assert {r[1] for r in rows if r[0] and r[0].strip()} == {"en"}
    strange = spark.createDataFrame([(1, "щщщ", 0), (2, "12 % 3", 0), (3, None, 0)], "doc_id bigint, text string, n int")
    assert [(r.lang_pred, r.score) for r in langid.identify(strange, model)[0].orderBy("doc_id").collect()] == [("en", 0.0), ("und", 0.0), ("und", 0.0)]
    assert langid.train(none, store_and_reload) is None and langid.train(odd.where("lang IS NULL"), store_and_reload) is None
    assert langid.held_out(none, store_and_reload).collect() == []
    assert {r.lang_pred for r in langid.held_out(odd.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"), store_and_reload).collect()} == {"und"}
