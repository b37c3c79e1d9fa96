import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideflow.llm import anchors, codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, LABEL string, code string, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab,
                                   "x", "c", 1, "y") for i, v, lab in rows], SCHEMA)


def vectors(n, dims, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (6, dims))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(0, spread / 4, (n, dims))).astype(np.float32)
    return [(i, v.tolist(), int(rng.integers(0, 4)) if rng.random() < 0.9 else None) for i, v in enumerate(x)]


def edges(rows):
    """Ties, repeated rows, NULL ids, and rows that are not usable."""
    dims = len(rows[0][1])
    bad = [None, [None] * dims, [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [-math.inf] * dims, [0.5, None]]
    rows = rows + [(1000 + i, v, 1) for i, v in enumerate(bad)]
    rows += [rows[3]] * 5 + [(2000 + i, rows[4][1], None) for i in range(60)] + [(None, rows[5][1], 2)] * 2
    return rows + [(3000, [0.0] * dims, 0), (3001, [-0.0005] * dims, 0)]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_codes(rows, parts, entries, rounds):
    rows = usable(rows)
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 1024).astype(np.int64)
    width = x.shape[1] // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    code, error, books = [], 0, []
    for p in range(parts):
        pts = x[:, p * width:(p + 1) * width]
        book = pts[first].copy()
        for r in range(rounds + 1):
            d = ((pts[:, None] - book[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            if r < rounds:
                for e in range(len(book)):
                    if (own == e).any():
                        book[e] = pts[own == e].sum(axis=0) // (own == e).sum()
        code.append(own)
        error = error + d.min(axis=1)
        books.append(book)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    per = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        per[r[2]] = per.get(r[2], 0) + e
    return sorted([(r[0], "".join(f"{c[i]:02x}" for c in code), int(error[i]), per[r[2]], sha)
                   for i, r in enumerate(rows)], key=repr)


def coded(spark, rows, parts, entries, rounds):
    got, books, dims = codes.compress(frame(spark, rows), parts, entries, rounds)
    sha = codes.digest(books, dims)
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], sha)
                   for r in codes.label_errors(got).collect()], key=repr)


@pytest.mark.parametrize("n,dims,entries,chunk", [(1500, 16, 32, 4096), (700, 8, 256, 100), (40, 4, 256, 7)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dims, entries, chunk):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    rows = edges(vectors(n, dims, seed=n))
    assert coded(spark, rows, 4, entries, 4) == brute_codes(rows, 4, entries, 4)


def test_codes_of_few_or_no_rows(spark):
    rows = vectors(3, 8)
    assert coded(spark, rows, 4, 256, 4) == brute_codes(rows, 4, 256, 4)
    assert coded(spark, [(1, None, 1)], 4, 256, 4) == []
    assert codes.label_errors(codes.compress(frame(spark, rows).limit(0))[0]).collect() == []
    one = [(7, [0.25] * 8, None)] * 30
    assert coded(spark, one, 4, 256, 4) == brute_codes(one, 4, 256, 4)


def test_vectors_of_odd_length_and_another_length(spark):
    rows = [(i, v[:7], lab) for i, v, lab in vectors(50, 8)]
    got = coded(spark, rows + [(99, [0.0] * 9, 1)], 4, 16, 2)
    padded = [(i, v + [0.0], lab) for i, v, lab in rows]
    assert [g[:4] for g in got] == [w[:4] for w in brute_codes(padded, 4, 16, 2)]
    with pytest.raises(Exception, match="beyond"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 1)]))


def test_balls_hold_their_points():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(-300, 300, (3000, 5)), axis=0)
    weight = rng.integers(1, 4, len(x))
    t = anchors.build(x, weight)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for b in range(len(t.centre)):
        own = t.order[t.first[b]:t.last[b]]
        assert t.number[b] == weight[own].sum()
        assert (t.total[b] == (x[own] * weight[own][:, None]).sum(axis=0)).all()
        assert anchors.distances(x[own], t.centre[b]).max() <= t.radius[b]
        if t.left[b] >= 0:
            assert t.number[b] == t.number[t.left[b]] + t.number[t.right[b]]
    # tight groups: balls are owned whole, far from every point being looked at
    x = np.unique((np.arange(4)[:, None, None] * 5000 + rng.integers(0, 40, (4, 900, 5))).reshape(-1, 5), axis=0)
    t = anchors.build(x, np.ones(len(x), dtype=np.int64))
    sums, counts = anchors.owners(t, x, np.ones(len(x), dtype=np.int64), x[[0, 1000, 2000, 3000]])
    own = ((x[:, None] - x[[0, 1000, 2000, 3000]][None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (counts == np.bincount(own, minlength=4)).all()
    assert (sums == np.array([x[own == e].sum(axis=0) for e in range(4)])).all()


def brute_whitening(rows, m):
    rows = usable(rows)
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    e, vec = np.linalg.eigh(z.T @ z / n)
    e, vec = e[::-1][:m], vec[:, ::-1][:, :m]
    return rows, ((n * x - s) ** 2).sum(axis=1), z @ vec / np.sqrt(e), e / (z ** 2).sum() * n


@pytest.mark.parametrize("dims,steps", [(16, 64), (40, 12)])
def test_whitening_equals_eigenvectors(spark, monkeypatch, dims, steps):
    monkeypatch.setattr(whitening, "STEPS", steps)
    rows = edges(vectors(900, dims, seed=dims))
    want, deviation, white, share = brute_whitening(rows, 8)
    got = whitening.whiten(frame(spark, rows), 8).collect()
    assert len(got) == 8 * len(want)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {c: np.sign(by[(0, c)][0]["whitened"] * white[0, c - 1]) for c in range(1, 9)}
    for i, r in enumerate(want):
        for c in range(1, 9):
            g = by[(r[0], c)][0]
            assert g["n"] == len(want) and g["deviation"] == deviation[i]
            assert abs(g["whitened"] * sign[c] - white[i, c - 1]) < 1e-7
            assert abs(g["explained"] - share[c - 1]) < 1e-9
            assert g["identity_error"] < 1e-9


def test_equal_deviations_and_low_rank(spark):
    # the corners of a cube: three equal deviations, and a fourth dimension that is constant
    rows = [(i, [(i >> k & 1) * 0.5 for k in range(3)] + [0.25], None) for i in range(8)]
    got = whitening.whiten(frame(spark, rows), 8).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    assert all(abs(sum(r["whitened"] ** 2 for r in got if r["vec_id"] == i) - 3) < 1e-9 for i in range(8))


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5] * 4, 1)] * 3)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [None], 1)])).collect() == []
    assert whitening.whiten(frame(spark, vectors(3, 4)).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5] * 4, 1)]).where(F.lit(False))).schema.names[:2] == ["vec_id", "component"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [(-1) ** i * 2e6], None) for i in range(3000)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3000 and all(r["deviation"] is None for r in got)
