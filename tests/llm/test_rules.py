import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from wideflow.llm import rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = [False] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = True
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(marked)


def test_base_columns(spark, make_docs, edge_rows):
    rng = random.Random(2)
    texts = ["a b c a b c", "a b a b a b a", "x\nx\n x\n\n\nx", "#$ | a b c <\t>", "a\x0bb\x0cc\rd", "é é é é"]
    texts += ["".join(rng.choice("ab \n\t#") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = edge_rows + [(1000 + i, t, "en", "a") for i, t in enumerate(texts)]
    out = rules.apply_rules(make_docs(rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((i, *base(t)) for i, t, _, _ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)              # no labels, no cutoffs


def exact_k(n, rate, mistake):
    p, total, k = Fraction(rate), Fraction(0), -1
    for j in range(n + 1):
        total += comb(n, j) * p**j * (1 - p) ** (n - j)
        if total > Fraction(mistake):
            break
        k = j
    return k


def test_binomial_bound(spark):
    cases = [(n, rate, m) for n in (0, 1, 5, 50, 300, 900) for rate in (0.01, 0.05, 0.25) for m in (0.05, 1e-4)]
    frame = spark.createDataFrame(cases, "n long, rate double, m double")
    out = frame.select("n", "rate", "m", rules.allowed_failures(F.col("n"), F.col("rate"), F.col("m")).alias("k"))
    for r in out.collect():
        assert r.k == exact_k(r.n, r.rate, r.m), r


def texts(rng, n, junk=""):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    return [" ".join(word() + junk for _ in range(rng.randint(60, 90))) for _ in range(n)]


def frames(spark, rows, good):
    docs = spark.createDataFrame([(i, t, lang, "a", 0) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, 1) for i in good] + [(None, 1)], "doc_id long, quality int")


def test_cutoffs_hold_per_stratum_and_reject_junk(spark):
    rng = random.Random(4)
    good = [(i, t, ["en", "fr"][i % 2]) for i, t in enumerate(texts(rng, 3000))]
    junk = [(5000 + i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts(rng, 60, "$$##"))]
    empty = [(7000, None, "en"), (7001, "", "fr"), (7002, " ", None)]
    docs, labels = frames(spark, good + junk + empty, [i for i, *_ in good] + [good[0][0]])
    out = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    for lang in ("en", "fr"):
        own = [out[i] for i, _, x in good if x == lang]
        assert sum(not r.kept for r in own) <= rules.ALLOWED * len(own)
        assert not any(out[i].kept for i, _, x in junk if x == lang)
    assert all(out[i].base_failed and not out[i].kept for i, *_ in empty)
    # no labels in this stratum: nothing beyond the base is rejected
    assert all(out[i].kept for i, _, x in junk if x is None)
    assert rules.apply_rules(docs.limit(0), labels).count() == 0


def test_repeated_rows_and_copies_are_no_evidence(spark):
    rng = random.Random(5)
    one = texts(rng, 1)[0]
    rows = [(1, one, "en")] * 1200 + [(2 + i, one, "en") for i in range(300)]
    junk = [(9000 + i, t, "en") for i, t in enumerate(texts(rng, 30, "$$##"))]
    docs, labels = frames(spark, rows + junk, range(1, 302))
    out = rules.apply_rules(docs, labels).collect()
    assert all(r.kept for r in out)                        # one text certifies nothing
    few, _ = frames(spark, [(i, t, "en") for i, t in enumerate(texts(rng, 100))] + junk, [])
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert all(r.kept for r in rules.apply_rules(few, labels).collect() if r.doc_id >= 9000)


def certified(design, test, strata, steps=rules.STEPS, stride=rules.STRIDE):
    """The step and cutoffs of one stratum by hand, from (statistics per rule) rows."""
    path = []
    for i in range(steps + 1):
        limit = int(len(design) * i * stride + 1e-9)
        path.append({r: next((c for c in cuts if sum(x[r] > c for x in design) <= limit), None)
                     for r, (_, cuts) in rules.RULES.items()})
    k, best = exact_k(len(test), rules.ALLOWED, rules.MISTAKE / strata), None
    for i, cuts in enumerate(path):
        if sum(any(c is not None and x[r] > c for r, c in cuts.items()) for x in test) > k:
            break
        best = (i, cuts)
    return best


def test_sequence_by_hand(spark):
    rng = random.Random(9)
    good = texts(rng, 900) + texts(rng, 12, "%") + [" ".join(t.split()[:55] * 2) for t in texts(rng, 6)]
    good += ["\n".join(t.split()) + "\nab\nab" for t in texts(rng, 30)]
    rows = [(i, t, "en") for i, t in enumerate(good)]
    docs, labels = frames(spark, rows, range(len(rows)))
    stats = docs.select(*[c.alias(n) for n, c in rules.base_columns(F.col("text")).items()],
                        F.lit("aen").alias("stratum"), (F.substring(F.md5("text"), 1, 1) < "8").alias("design"))
    stats = stats.where(~rules.base_failed())
    got = rules.certified_cutoffs(stats).first()
    x = [{r: row[r] for r in rules.RULES} | {"design": row["design"]} for row in stats.select(
        "design", *[F.coalesce(F.expr(s), F.lit(0.0)).alias(r) for r, (s, _) in rules.RULES.items()]).collect()]
    want = certified([v for v in x if v["design"]], [v for v in x if not v["design"]], 1)
    assert (got["step"], got["cuts"].asDict()) == want and 0 < got["step"] <= rules.STEPS


def test_chance_of_a_mistake(spark):
    """Where the true rate of false rejections is known, a step above the allowed
    rate is certified in no more than the stated share of draws."""
    wrong, draws = 0, 400
    spec = {"symbols": ("x", (0.9, 0.93, 0.94))}
    # x is uniform, so the lowest cutoff rejects a tenth, the others 7 and 6 percent
    rows = spark.range(draws * 400).select(
        F.concat(F.lit("s"), (F.col("id") % draws).cast("string")).alias("stratum"),
        (F.col("id") % 3 == 0).alias("design"), F.rand(3).alias("x"))
    out = rules.certified_cutoffs(rows, spec, allowed=0.06, mistake=0.05 * draws, steps=10, stride=0.01)
    wrong = sum(1 for r in out.collect() if r["cuts"]["symbols"] is not None and 1 - r["cuts"]["symbols"] > 0.0601)
    assert wrong <= 0.05 * draws + 3 * (0.05 * 0.95 * draws) ** 0.5
