"""Near-duplicates by similarity against a brute-force version."""

import numpy as np

from transitloom.llm import simhash
from transitloom.session import store_and_reload


def brute(texts):
    """The smallest position of each text's class."""
    grams = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out, least, _ = simhash.near_duplicates(df, store_and_reload)
    return [r[least] for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def edited(words, rng, edits):
    """The words with so many of them replaced, far enough apart that each breaks five shingles of its own."""
    out = list(words)
    for at in rng.choice(len(words) // 10, edits, replace=False) * 10 + rng.integers(4, 6):
        out[at] = f"x{rng.integers(10**9)}"
    return out


def test_copies_are_linked_through_their_original_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    original = [f"w{i}" for i in range(300)]
    texts = [" ".join(x) for x in [*(edited(original, rng, 6) for _ in range(300)), original]]
    # a template whose copies are too far from one another, and from its original
    other = [f"v{i}" for i in range(300)]
    texts += [" ".join(edited(other, rng, 9)) for _ in range(60)] + [" ".join(other)]
    want = brute(texts)
    assert want[:301] == [0] * 301 and len(set(want)) > 50
    assert found(spark, texts) == want
    monkeypatch.setattr(simhash, "PIECE_SETS", 16)
    assert found(spark, texts) == want


def test_set_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(9)
    for n in (2, 30, 80):
        sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14))).astype(np.uint64) for _ in range(n)]
        tree = np.arange(n)
        side = rng.integers(0, 2, n)
        for of in (None, side):
            near = {(i, j) for i in range(n) for j in range(n) if i != j and (of is None or of[i] != of[j])
                    and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
            links = simhash.set_forest(sets, tree, 0.8, of)
            assert set(links) <= near and len(links) < n
            root = list(range(n))
            for i, j in links:
                root = [root[i] if r == root[j] else r for r in root]
            assert all(root[i] == root[j] for i, j in near)


def test_short_texts_at_the_bound_share_a_sign():
    rng = np.random.default_rng(10)
    for common, mine, other in [(4, 0, 1), (8, 1, 1), (4, 1, 0), (12, 0, 3), (16, 2, 2), (50, 12, 0), (60, 5, 10), (60, 15, 0), (63, 0, 15), (1, 0, 0)]:
        for _ in range(200):
            x = rng.integers(0, 2**64, common + mine + other, dtype=np.uint64)
            a, b = np.sort(x[:common + mine]), np.sort(np.concatenate([x[:common], x[common + mine:]]))
            assert set(simhash.signs(a, 0.8)) & set(simhash.signs(b, 0.8))


def test_short_texts_match_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = ["a", "a b c d e", "a b c d e f"]
    for i in range(60):
        words = [f"w{i}_{j}" for j in range(rng.integers(4, 90))]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[1:]), " ".join([*words[:-2], "x", "y", "z"])]
    texts += [" ".join(f"t{j}" for j in range(8)), " ".join(f"t{j}" for j in range(9))]
    want = brute(texts)
    assert want[-1] == want[-2] and len(set(want)) > 60
    assert found(spark, texts) == want


def test_pivots_rule_out_pairs_but_no_similar_one(spark):
    rng = np.random.default_rng(12)
    sets, ruled_out = [], 0
    for _ in range(40):
        own = rng.integers(0, 2**64, rng.integers(5, 200), dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate([own[len(own) // 10:], rng.integers(0, 2**64, len(own) // 10, dtype=np.uint64)]))]
    table = np.array([simhash.pivots(s) for s in sets])
    near = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            apart = np.abs(table[i] - table[j]).max()
            assert apart <= len(sets[i]) + len(sets[j]) - 2 * both
            out = apart > simhash.farthest(np.array(len(sets[i])), len(sets[j]), 0.8)
            ruled_out += bool(out)
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                near.add((i, j))
                assert not out
    assert near and ruled_out > 1000
    links = simhash.set_forest(sets, np.arange(len(sets)), 0.8, None, table)
    assert links and links == simhash.set_forest(sets, np.arange(len(sets)), 0.8)
    rows = [(bytes([i]), s.astype("<u8").tobytes(), simhash.pivots(s).tolist()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "key binary, grams binary, pivots array<bigint>")
    pairs = held.selectExpr("key AS src").crossJoin(held.selectExpr("key AS dst")).where("src < dst")
    left = {(r.dst[0], r.src[0]) for r in simhash.reachable(pairs, held, 0.8).collect()}
    assert near <= left and len(left) <= len(sets) * (len(sets) - 1) / 2 - ruled_out
    assert {(r.dst[0], r.src[0]) for r in simhash.verified(pairs, held, 0.8).collect()} == near
