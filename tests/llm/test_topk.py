import random

import pytest
from pyspark.sql import functions as F

from wideflow.llm import topk


def brute(rows, queries, k):
    seen = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    out = {}
    for q, c in queries:
        if q is not None and c is not None:
            near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in seen)[:k]
            out[q] = near
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.distance, r.id))
    return out


def frames(spark, rows, queries):
    return (spark.createDataFrame(rows, "id long, code long"),
            spark.createDataFrame(queries, "query_id long, code long"))


def test_search_is_exact(spark):
    rng = random.Random(1)
    code = lambda: rng.getrandbits(64) - 2**63
    rows = [(i, code()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + i, rows[4][1] ^ (1 << i % 60)) for i in range(40)]
    rows += [(None, 5), (3000, None), rows[0], rows[0]]
    queries = [(i, c) for i, c in rows if i is not None and i % 20 == 0] + [(7777, 0), (None, 1), (8888, None)]
    assert got(topk.top_k(*frames(spark, rows, queries), 7)) == brute(rows, queries, 7)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(1, 0), (2, -1), (3, 255)]
    assert got(topk.top_k(*frames(spark, rows, rows), 10)) == brute(rows, rows, 10)
    assert topk.top_k(*frames(spark, [], rows), 10).count() == 0
    assert topk.top_k(*frames(spark, rows, []), 10).count() == 0


def test_sign_codes(spark):
    vectors = [(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, []), (4, [-1.0] * 63 + [1.0]), (5, [None, 1.0])]
    frame = spark.createDataFrame(vectors, "id long, v array<float>")
    out = {r.id: r.c for r in frame.select("id", topk.sign_code(F.col("v")).alias("c")).collect()}
    assert out == {1: [0b1001], 2: None, 3: [0], 4: [-2**63], 5: [2]}
    wide = spark.createDataFrame([(1, [1.0] + [-1.0] * 126 + [1.0])], "id long, v array<float>")
    assert topk.words_for(wide, "v") == 2
    assert wide.select(topk.sign_code(F.col("v"), 2).alias("c")).first().c == [1, -2**63]
    with pytest.raises(Exception, match="more than 64 components"):
        wide.select(topk.sign_code(F.col("v"), 1)).collect()


def test_vectors_of_128_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(128)]) for i in range(80)]
    rows += [(200 + i, rows[7][1][:64] + [-x for x in rows[7][1][64:]]) for i in range(3)]     # 64 signs apart
    rows += [(300 + i, [-x if j in (i, 100 + i) else x for j, x in enumerate(rows[9][1])]) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, v array<float>").withColumns({"ID2": F.lit(1), "Code": F.lit("x")})
    codes = frame.select("id", topk.sign_code(F.col("v"), topk.words_for(frame, "v")).alias("code"))
    queries = codes.where(F.col("id") % 10 == 7).withColumnRenamed("id", "query_id")
    want = {}
    for i, v in rows:
        if i % 10 == 7:
            want[i] = sorted((sum((a > 0) != (b > 0) for a, b in zip(v, w)), j) for j, w in rows)[:6]
    assert got(topk.top_k(codes, queries, 6)) == want
