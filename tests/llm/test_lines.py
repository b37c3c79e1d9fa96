import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wideflow.llm import lines


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_docs, min_chars=1):
    docs = {(i, t) for i, t in rows}
    found = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < max(min_chars, 1) or found[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=repr)


def run(docs, *args, **kw):
    return sorted([tuple(r) for r in lines.drop_common_lines(docs, *args, **kw).select(
        "doc_id", "text", "n_lines", "n_dropped").collect()], key=repr)


@pytest.mark.parametrize("min_docs,min_chars,batches", [(10, 1, 6), (2, 1, 4), (3, 6, 1)])
def test_equals_brute_force(spark, make_docs, edge_rows, min_docs, min_chars, batches):
    rng = random.Random(min_docs)
    shared = [f"Shared line {i}" for i in range(12)] + ["", "  ", "É accent", "\x0bA\t", "x" * 9000]
    rows = list(edge_rows)
    for i in range(100, 260):
        body = [rng.choice(shared + [f"own {i} {j}"]) for j in range(rng.randint(1, 9))]
        body = [rng.choice(["", " ", "\t"]) + rng.choice([b, b.upper(), b]) + rng.choice(["", " \r"]) for b in body]
        rows.append((i, "\n".join(body), "en", "a"))
    rows.append((300, "\n".join(["shared line 1", "keep me"] * 3000), "en", "a"))     # a very long text
    rows.append((301, "\n\n", "en", "a"))
    rows += [rows[-3]] * 12                                         # a row repeated is one document
    rows += [(None, "É ACCENT\nrest", "en", "b")]
    got = run(make_docs(rows), min_docs, min_chars, batches=batches)
    assert got == brute([(r[0], r[1]) for r in rows], min_docs, min_chars)


def test_one_line_in_every_document(spark, make_docs):
    rows = [(i, f"common\nnumber {i}\nCOMMON ", "en", "a") for i in range(400)]
    got = run(make_docs(rows, extra=False), 10)
    assert got == brute([(r[0], r[1]) for r in rows], 10)
    assert {r[3] for r in got} == {2}


def test_below_the_threshold_nothing_goes(spark, make_docs):
    rows = [(i, "nine times", "en", "a") for i in range(9)] + [(9, "nine times\nnine times", "en", "a")][:0]
    assert {r[3] for r in run(make_docs(rows, extra=False), 10)} == {0}
    rows += [(9, "Nine Times\nalone", "en", "a")]
    assert [r[1] for r in run(make_docs(rows, extra=False), 10)] == [""] * 9 + ["alone"]


def test_empty_table(spark, make_docs):
    assert run(make_docs([(1, "a", "en", "a")]).limit(0)) == []


def test_runs_are_compacted_and_agree_with_one_count(spark):
    n = 900
    occ = spark.range(n).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"),
                                F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("rid"))
    index = lines.LineRuns(spark, 40, fanout=2)
    for i in range(5):
        index.add(occ.where(F.col("doc_id") % 5 == i))
        assert all(len(level) < 2 for level in index.levels)
    got = sorted(tuple(r) for r in index.common().collect())
    assert got == sorted(k for k, c in Counter((i % 7, i % 3) for i in range(n)).items() if c >= 40)
    assert lines.LineRuns(spark, 2).common().count() == 0
