"""Registered queries against their SQL, or against brute force where there is none."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import regex
import xxhash

import __spark_entry__ as contract
import corpus_pipeline
from transitloom.llm import pii, simhash, tokens
from transitloom.llm.queries import ORACLE, QUERIES
from transitloom.session import store_and_reload

FOLDER = os.environ.get("TRANSITLOOM_DATA", "/root/testdata/sf0.001")
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    frame, cursor = QUERIES[name](spark, FOLDER), duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()


def rows_of(spark, name="documents"):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def test_simhash_matches_brute_force(spark):
    docs = sorted(rows_of(spark), key=lambda r: r.doc_id)
    made = []
    for d in docs:
        w = re.findall(SPACE, fold(d.text))
        grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        made.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    fps = np.array(made, dtype=np.uint64)
    linked = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if j > i]
    root = roots(len(docs), linked)
    want = {(d.doc_id, f"{f:016x}", docs[r].doc_id) for d, f, r in zip(docs, made, root, strict=True)}
    assert {tuple(r) for r in QUERIES["op2_simhash_near_dedup"](spark, FOLDER).collect()} == want


def test_token_counts_match_the_tokenizer(spark):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    want = sorted((d.doc_id, len(encode(d.text))) for d in rows_of(spark))
    assert sorted(tuple(r) for r in QUERIES["op8_token_counts"](spark, FOLDER).collect()) == want


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PII_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d),
            "phone": 9 <= len(d) <= 15}.get(kind, False)


def plain_candidates(text):
    """Candidates of one text with their votes, looser ones that overlap a base span left out."""
    out = []
    for kind, pattern in {**PII_BASE, **pii.LOOSE}.items():
        for m in regex.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "card" and not 12 <= len(digits) <= 19:
                continue
            # what stands before a match goes back to the match of its kind before it
            cut = max([c["end"] for c in out if c["all"] == kind], default=0)
            out.append({"all": kind, "kind": kind, "start": m.start(), "end": m.end(), "value": m[0], "digits": digits, "base": passes(kind, m[0]),
                        "before": text[max(cut, m.start() - pii.CONTEXT):m.start()]})
    spans = [(c["start"], c["end"]) for c in out if c["base"]]
    out = [c for c in out if c["kind"] in PII_BASE or not any(s < c["end"] and c["start"] < e for s, e in spans)]
    any_name = "|".join(dict.fromkeys(pii.NAMES.values()))
    for c in out:
        k, v, said = c["kind"], c["value"], c["before"]
        strict = {"email_spelled": bool(re.search(r"[\[(](dot|DOT)[\])]", v)), "phone_local": bool(re.match(r"\([0-9]{3}\)\x20", v)),
                  "ssn": not re.search("^(000|666|9)|-00-|-0000$", v), "iban": True}.get(k, c["base"])
        plain = v.replace(" ", "")
        iban = k == "iban" and int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1
        has = lambda p, said=said: bool(regex.search(p, said))
        c |= {"shape": 1 if strict else -1, "checksum": (1 if c["base"] else -1) if k == "card" else (1 if iban else -1) if k == "iban" else 0,
              "gazetteer": 1 if has(rf"(?i)\b(?:{pii.NAMES[k]})\b[^\n]{{0,16}}$") else -1 if has(rf"(?i)\b(?:{any_name})\b[^\n]{{0,16}}$") else 0,
              "context": -1 if has(pii.AGAINST) else 1 if has(pii.PROSE) else 0, "edge": 1 if has(pii.BEGINS) else -1 if has(pii.WITHIN) else 0,
              "alone": -1 if has("[0-9]") else 1, "width": min(len(v) // 8, 4)}
    return out


def check_pii(docs, got):
    found = {d.doc_id: plain_candidates(d.text or "") for d in docs}
    counted = {}
    for c in (c for cs in found.values() for c in cs):
        counted[tuple(c[f] for f in pii.FEATURES)] = counted.get(tuple(c[f] for f in pii.FEATURES), 0) + 1
    seen = [dict(zip(pii.FEATURES, k, strict=True), n=n) for k, n in counted.items()]
    seen.sort(key=lambda r: [str(r[f]) for f in pii.FEATURES])
    right, sure = pii.reliabilities(seen)
    start, weights = pii.classifier(seen, sure)
    added = 0
    for r in got:
        base, every = [], []
        for c in found[r.doc_id]:
            at = (c["start"], pii.KINDS.index(c["kind"]), f"{c['kind']}:{c['start']}:{c['end']}")
            score = 1 / (1 + np.exp(-(start + sum(weights[f, c[f]] for f in pii.FEATURES))))
            base += [at] if c["base"] else []
            every += [at] if c["base"] or c["kind"] in pii.LOOSE and score >= pii.SURE else []
        added += len(every) - len(base)
        assert [r[f"n_{k}"] for k in PII_BASE] == [sum(x[2].startswith(k + ":") for x in base) for k in PII_BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(base)).encode()).hexdigest()
        assert r.spans == ",".join(x[2] for x in sorted(every)), r.doc_id
    return right, {k: sum(r["n"] for r in seen if r[k]) for k in pii.LABELERS}, added


def test_pii_matches_a_plain_version(spark):
    docs = rows_of(spark)
    check_pii(docs, QUERIES["op10_pii_weak_supervision"](spark, FOLDER).collect())
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    right, votes, _ = check_pii(docs, QUERIES["op10_pii_weak_supervision"](spark, folder).collect())
    assert sum(votes[k] > 0 and abs(right[k] - 2 / 3) > 0.05 for k in pii.LABELERS) >= 3


def test_pii_adds_what_the_base_patterns_miss(spark):
    texts = [f"words of prose and mail{i} [at] host{i} [dot] org then" for i in range(40)] + [f"the ssn is 12{i % 10}-45-67{i % 90 + 10} here" for i in range(40)]
    texts += [f"call (604) 555-{1000 + i} today" for i in range(40)] + [f"order no. 604-555-{1000 + i}#604.555.{2000 + i}" for i in range(40)]
    texts += [f"say +1 (604) 555-{1000 + i} or mail a{i}@b.org or 10.0.0.{i} or 4111 1111 1111 1111 now" for i in range(40)] + ["", "none at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = pii.scan(docs, store_and_reload).collect()
    _, _, added = check_pii(docs.collect(), got)
    assert added >= 80
    assert all("phone_local" not in r.spans for r in got if texts[r.doc_id].startswith("say"))


def keeps_quality(text):
    """Whether no quality rule rejects a text, counted the plain way."""
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    n, chars = len(w), sum(map(len, w))
    grams = [tuple(w[i:i + 3]) for i in range(n - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    count = lambda pattern: len(regex.findall(pattern, text))
    return not (
        100 * sum(not regex.search(r"\p{L}", x) for x in w) > 40 * n or 100 * count(r"(?m)^[\x20\t]*[-*•]\x20") > 90 * len(lines)
        or 100 * count(r"\p{Lu}") > 50 * chars or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or 100 * count(r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)") > 30 * len(lines) or 100 * text.count("!") > 50 * n
        or 100 * count(r"[#*$%&|<>]") > 10 * n or chars < 2 * n or chars > 15 * n)


def without_boilerplate(rows):
    """Texts by id after lines above the ratio of their source's pages are gone, counted the plain way."""
    pages, holding = {}, {}
    for source, text in {(r.source, r.text or "") for r in rows}:
        pages[source] = pages.get(source, 0) + 1
        for line in {x for x in text.split("\n") if re.search(SPACE, x)}:
            holding[source, line] = holding.get((source, line), 0) + 1
    gone = {k for k, n in holding.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for r in rows}


def leaks(text, items):
    """Whether a text holds a window of ten words, or all words of a shorter item."""
    said = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    w = said(text)
    windows = {tuple(i[k:k + min(10, len(i))]) for i in map(said, items) if i for k in range(len(i) - min(10, len(i)) + 1)}
    return any(tuple(w[k:k + size]) in windows for size in {len(x) for x in windows} for k in range(len(w) - size + 1))


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store_and_reload(stage(spark, docs, FOLDER), name)
        seen.append(name)
        had, has = before.collect(), docs.collect()
        if name != "mix_sources":
            assert docs.columns == before.columns
        if name == "quality_rules":
            assert sorted(map(str, has)) == sorted(str(r) for r in had if keeps_quality(r.text))
        elif name == "line_dedup":
            want = without_boilerplate(had)
            assert {r.doc_id: (r.text, r.n_chars) for r in has} == {k: (t, len(t)) for k, t in want.items()} and len(has) == len(had)
            assert any(r.text != want[r.doc_id] for r in had)
        elif name == "near_dedup":
            had = sorted(had, key=lambda r: r.doc_id)
            grams = [set(simhash.shingles((r.text or "").encode(), 5)) for r in had]
            linked = [(i, j) for i in range(len(had)) for j in range(i + 1, len(had))
                      if (grams[i] or grams[j]) and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) or grams[i] == grams[j]]
            root = roots(len(had), linked)
            assert {r.doc_id for r in has} == {had[x].doc_id for x in set(root)}
        elif name == "decontaminate":
            assert sorted(map(str, has)) == sorted(str(r) for r in had if not leaks(r.text, items)) and len(has) < len(had)
    assert seen == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    assert docs.groupBy("source_size", "target").agg({"taken": "sum"}).where("abs(`sum(taken)` - target) > 1").count() == 0


def test_reliable_labelers_are_told_from_noisy_ones():
    rng = np.random.default_rng(3)
    seen = {}
    for _ in range(4000):
        truth = 1 if rng.random() < 0.5 else -1
        votes = tuple(int(truth if rng.random() < p else -truth) for p in (0.95, 0.9, 0.85, 0.6, 0.8, 0.7))
        seen[votes] = seen.get(votes, 0) + 1
    rows = [dict(zip(pii.LABELERS, v, strict=True), n=n, kind="x", width=0) for v, n in seen.items()]
    right, sure = pii.reliabilities(rows)
    assert [abs(right[k] - p) < 0.05 for k, p in zip(pii.LABELERS, (0.95, 0.9, 0.85, 0.6, 0.8, 0.7), strict=True)] == [True] * 6
    assert all(p > 0.5 for r, p in zip(rows, sure, strict=True) if all(r[k] > 0 for k in pii.LABELERS[:3]))
