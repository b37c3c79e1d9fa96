import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wideflow.llm import mixing, shard
from wideflow.llm.common import WORD, pick

SIZES = "doc_id long, size long, source string, digest string, _salt string, _part string, shard string"


def sized(spark, rows):
    return spark.createDataFrame([(i, n, s, str(i), "a", "b", "c") for i, n, s in rows], SIZES)


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i if i % 3 else None, 1 + i * 7919 % 500, None) for i in range(500)]
    out = shard.assign_shards(sized(spark, rows).drop("_salt", "_part"), 16, "size", ["doc_id"]).collect()
    assert len(out) == 500
    total, by = sum(r[1] for r in rows), Counter()
    slots = defaultdict(list)
    for r in out:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(by) == set(range(16))
    assert max(abs(v - total / 16) for v in by.values()) <= 500
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # contiguous: shards follow doc_id, NULLs last
    ids = sorted(((r.doc_id is None, r.doc_id or 0, r.shard) for r in out))
    assert [x[2] for x in ids if not x[0]] == sorted(x[2] for x in ids if not x[0])


def test_shards_of_one_repeated_row_and_of_nothing(spark):
    same = shard.assign_shards(sized(spark, [(1, 10, None)] * 320).drop("_salt", "_part"), 16, "size", ["doc_id"])
    assert Counter(r.shard for r in same.collect()) == {i: 20 for i in range(16)}
    assert shard.assign_shards(sized(spark, []).drop("_salt", "_part"), 16, "size", ["doc_id"]).count() == 0
    zero = shard.assign_shards(sized(spark, [(1, 0, None)] * 3).drop("_salt", "_part"), 4, "size", ["doc_id"])
    assert {r.shard for r in zero.collect()} == {0}


def test_shard_query_digests(spark, make_docs, edge_rows, tmp_path):
    from wideflow.llm.queries import op3_byte_shards

    d = make_docs(edge_rows, extra=False)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = op3_byte_shards(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by reshuffling the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return share | {s: cap * sizes[s] for s in capped}
        capped |= set(over)


@pytest.mark.parametrize("plan", [
    {"a": 100, "b": 3, None: 40, "c": 5}, {"x": 50}, {"a": 10_000, "b": 1, "é": 1, "z": 1, None: 1}, {"a": 0, "b": 7}])
def test_mix_targets_and_budgets(spark, plan):
    rows, i = [], 0
    for s, n in plan.items():
        for _ in range(n):
            rows.append((i, 1 + i * 31 % 17, s))
            i += 1
        if not n:
            rows.append((i, 0, s))
            i += 1
    frame = sized(spark, rows).drop("_salt", "_part")
    out = mixing.mix(frame).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    want, taken = fill(dict(size)), Counter()
    for r in out:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 17
    again = mixing.mix(frame.orderBy(F.desc("doc_id"))).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_documents_with_edge_rows(spark, make_docs, edge_rows):
    import re

    docs = make_docs(edge_rows)
    out = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter(
        (i, len(re.findall(WORD, t or ""))) for i, t, _, _ in edge_rows)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    texts = Counter(t for _, t, _, _ in edge_rows)
    got = Counter(r.text for r in pick(rows, "text").collect())
    assert all(got[t] <= 3 * texts[t] for t in got)


def test_oracle_of_the_mix(spark, make_docs, edge_rows, tmp_path):
    import duckdb

    from wideflow.llm.queries import OP9_SQL, op9_mix_sources

    make_docs(edge_rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(OP9_SQL).fetchall()
    got = [tuple(r) for r in op9_mix_sources(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    strip = lambda rows: sorted(((r[0], r[2], r[6]) for r in rows), key=key)
    assert strip(got) == strip(want)
