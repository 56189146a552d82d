"""Vector codes and whitening against plain versions, and what they do with odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from transitloom.llm import queries, vectorcodes, whitening
from transitloom.session import store_and_reload

VECTORS = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def whole(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.4, 32)], int(i) % 3) for i in rng.permutation(150)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (900, rows[5][1], None), (901, None, 1), (902, [None] + [0.5] * 31, 1)]
    rows += [(903, [math.nan] + [0.5] * 31, 1), (904, [math.inf] + [0.5] * 31, 2), (905, [0.0] * 32, 7), (906, [], 7), (907, [1.0] * 3, 7), (908, [-9.5] * 32, 7)]
    return rows


def plain_codes(rows, parts=16, entries=64):
    """Codes and errors by looking at every entry."""
    rows = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if whole(v) and len(v) == 32]
    w = 32 // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][p * w:p * w + w] for r in first] for p in range(parts)]

    def assigned():
        out = []
        for _, x, _ in rows:
            code = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(x[p * w:p * w + w], e, strict=True)) for e in books[p]]
                code.append((d.index(min(d)), min(d)))
            out.append(code)
        return out

    for _ in range(2):
        found = assigned()
        for p in range(parts):
            held = defaultdict(list)
            for (_, x, _), code in zip(rows, found, strict=True):
                held[code[p][0]].append(x[p * w:p * w + w])
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = assigned()
    total = defaultdict(int)
    for (_, _, label), code in zip(rows, found, strict=True):
        total[label] += sum(d for _, d in code)
    return sorted(str((i, "".join(f"{k:02x}" for k, _ in code), sum(d for _, d in code), total[label]))
                  for (i, _, label), code in zip(rows, found, strict=True)), books


def test_codes_match_a_plain_version(spark, odd_rows):
    want, books = plain_codes(odd_rows)
    got = vectorcodes.codes(table(spark, odd_rows).selectExpr("*", "1 AS x", "2 AS away", "3 AS code", "4 AS of"), store_and_reload).collect()
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {vectorcodes.book_digest(np.array(books))}


def test_few_or_no_vectors(spark):
    assert vectorcodes.codes(table(spark, []), store_and_reload).collect() == []
    assert vectorcodes.codes(table(spark, [(1, None, 1)]), store_and_reload).collect() == []
    got = vectorcodes.codes(table(spark, [(1, [0.5] * 16, 1), (2, [0.25] * 16, None)]), store_and_reload).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.codes(table(spark, [(1, [0.5] * 10, 1)]), store_and_reload)


def test_bounds_prune_and_lose_no_nearest_entry():
    rng = np.random.default_rng(8)
    for width in (1, 4, 16):
        book = rng.integers(-300, 300, (64, width))
        book[7] = book[5]
        x = np.concatenate([rng.integers(-300, 300, (500, width)), book])
        pivots = vectorcodes.pivots_of(book)
        away = ((x[:, None] - pivots) ** 2).sum(2)
        later = book + rng.integers(-3, 4, book.shape)
        for entries in (book, later):
            at, best, evaluated = vectorcodes.nearest(x, away, entries, pivots)
            full = ((x[:, None] - entries) ** 2).sum(2)
            assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
            # bounds say little about unstructured parts of many components
            assert evaluated < (0.6 if width <= 4 else 1) * full.size


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for low, high in ((-140, 160), (5, 6), (-(1 << 40), 1 << 40)):
        x = rng.integers(low, high, (777, 9))
        cross, sums = whitening.products(x)
        exact = x.astype(object)
        assert (cross == exact.T @ exact).all() and (sums == exact.sum(axis=0)).all()


def plain_white(rows, d=32):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, _ in rows if whole(v) and len(v) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit * n - total
    v = (centred.astype(object).T @ centred.astype(object)).astype(float) / n**3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    white = {str((i, x)): ((np.array(x) - total / n) @ vectors) / np.sqrt(values) for i, x in kept}
    return kept, n, total, values / np.trace(v), white


def test_whitening_matches_a_plain_version(spark, odd_rows):
    kept, n, total, shares, white = plain_white(odd_rows)
    got = whitening.whiten(table(spark, odd_rows).selectExpr("*", "1 AS x", "2 AS n"), store_and_reload).collect()
    assert len(got) == 4 * len(kept)
    exact = sorted((str(i), k, sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))) for i, x in kept for k in (1, 2, 3, 4))
    assert sorted((str(r.vec_id), r.component, int(r.deviation)) for r in got) == exact
    of = {str(i): white[str((i, x))] for i, x in kept}
    for r in got:
        assert r.n == n and abs(abs(r.whitened) - abs(of[str(r.vec_id)][r.component - 1])) < 1e-9
        assert abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    signs = {k: {np.sign(r.whitened * of[str(r.vec_id)][k - 1]) for r in got if r.component == k} - {0.0} for k in (1, 2, 3, 4)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_few_or_equal_vectors(spark):
    assert whitening.whiten(table(spark, []), store_and_reload).collect() == []
    assert whitening.whiten(table(spark, [(1, None, 1)]), store_and_reload).collect() == []
    same = whitening.whiten(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]), store_and_reload).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened) for r in same] == [(1, 1, 0, None), (2, 1, 0, None)] * 2
    line = whitening.whiten(table(spark, [(1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1), (2, [1.0, 1.0], 1)]), store_and_reload).collect()
    assert sorted((r.vec_id, r.component, r.n, r.whitened) for r in line if r.component == 1) == [(1, 1, 2, -1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0)]
    assert all(r.whitened is None for r in line if r.component == 2)


def test_the_registered_query_casts_the_deviation(spark):
    made = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(made.dtypes)["deviation"] == "bigint" and made.count() == 2000
