"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a document whose statistic is above a cutoff.  The evidence is
the distinct texts of labelled good documents.  In every stratum one half of
them, by a hash of the text, designs a sequence of cutoff vectors from loose to
strict: at each step every rule takes the lowest cutoff of a fixed grid that at
most a given share of these texts is above.  The other half tests the vectors in
that order: a vector is certified if an exact binomial bound proves that the
joint false rejection rate of all rules is within the limit, and the first that
is not ends the sequence.  Testing in a fixed order needs no correction within a
stratum; the chance of a mistake is divided by the number of strata.  So with
the stated confidence no stratum rejects more than the allowed share of good
texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_words, pick, stored

#: Largest false rejection rate of good texts in a stratum, and the chance that
#: it is exceeded in any.
ALLOWED, MISTAKE = 0.05, 0.05
#: Steps of the sequence: at step i every rule may reject i * STRIDE of the texts
#: that design it.
STEPS, STRIDE = 40, 0.00125
#: Rule -> (statistic from the base columns, grid of cutoffs).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "long_words": ("try_divide(word_chars, n_words)", tuple(4 + 0.5 * i for i in range(33))),
    "short_words": ("try_divide(n_words, word_chars)", tuple(0.125 + 0.025 * i for i in range(36))),
    "symbols": ("try_divide(n_symbols, n_words)", tuple(0.01 * i for i in range(1, 101))),
    "repeated_lines": ("try_divide(n_dup_lines, n_words)", tuple(0.002 * i for i in range(1, 101))),
    "repeated_words": ("try_divide(n_repeat_words, n_words)", tuple(0.01 * i for i in range(0, 51))),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    The windows of one text, each followed by its place, are sorted as strings;
    equal windows are then neighbours.  Work per text is that of the sort.
    """
    windows = let(words, lambda w: F.when(F.size(w) < 4, F.array().cast("array<string>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat(
            F.get(w, i - 1), F.lit(" "), F.get(w, i), F.lit(" "), F.get(w, i + 1),
            F.lit("\t"), i.cast("string"))))))
    # A word holds no white space, so neither window nor place holds a tab.
    return let(F.struct(windows.alias("s"), F.lit(0)), lambda b: let(
        F.transform(b.getField("s"), lambda x: F.substring_index(x, "\t", 1)), lambda p: let(
            F.filter(F.transform(b.getField("s"), lambda x, i: F.when(
                (F.get(p, i) == F.get(p, i + 1)) | ((i > 0) & (F.get(p, i) == F.get(p, F.greatest(i - 1, F.lit(0))))),
                F.substring_index(x, "\t", -1).cast("int"))), lambda v: v.isNotNull()),
            lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(
                F.transform(r, lambda v: F.array(v, v + 1, v + 2)))))))))


def dup_lines(text: Column) -> Column:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs; 0
    for a NULL text)."""
    t = F.coalesce(text, F.lit(""))
    spaced = F.translate(t, "\t\n\x0b\f\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return {
        "n_words": n_words(text),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": dup_lines(t).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def allowed_failures(n: Column, rate: Column, mistake: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= mistake, or -1: with at
    most k failures among n the exact one-sided upper bound of the failure rate
    is at most ``rate``.  The terms are summed in logarithms, each from the one
    before."""
    state = "struct<k:bigint,term:double,sum:double,stop:boolean>"

    def step(s, j):
        term = F.when(j == 0, n * F.log1p(-rate)).otherwise(
            s.getField("term") + F.log((n - j + 1) / j) + F.log(rate / (1 - rate)))
        low, high = F.least(s.getField("sum"), term), F.greatest(s.getField("sum"), term)
        total = F.when(j == 0, term).otherwise(high + F.log1p(F.exp(low - high)))
        return let(F.struct(term.alias("t"), total.alias("s")), lambda x: F.when(
            s.getField("stop") | (x.getField("s") > F.log(mistake)),
            F.struct(s.getField("k").alias("k"), s.getField("term").alias("term"),
                     s.getField("sum").alias("sum"), F.lit(True).alias("stop"))).otherwise(
            F.struct(j.cast("long").alias("k"), x.getField("t").alias("term"),
                     x.getField("s").alias("sum"), F.lit(False).alias("stop"))).cast(state))

    start = F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0.0).alias("term"),
                     F.lit(0.0).alias("sum"), F.lit(False).alias("stop")).cast(state)
    # Beyond the mean the sum exceeds one half, so no k above it can qualify.
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * rate).cast("long")),
                       start, step, lambda s: s.getField("k"))


def cutoff_sequence(design: DataFrame, rules, steps: int = STEPS, stride: float = STRIDE) -> DataFrame:
    """stratum and ``path``: an array of steps + 1 structs (a cutoff per rule, NULL if
    the grid has none that is loose enough), from loose to strict.  ``design``: one
    row per text, with the stratum and the base columns.  One pass counts the texts
    above every grid point."""
    counts = design.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[
        F.array(*[F.count_if(F.expr(stat) > F.lit(float(c))) for c in cuts]).alias(r)
        for r, (stat, cuts) in rules.items()])

    def vector(i: Column) -> Column:
        limit = F.floor(F.col("n") * i * F.lit(stride) + F.lit(1e-9))
        out = []
        for r, (_, cuts) in rules.items():
            grid = F.array(*[F.lit(float(c)) for c in cuts])
            at = F.array_position(F.transform(r, lambda c: c <= limit), True)
            out.append(F.when(at > 0, F.get(grid, (at - 1).cast("int"))).alias(r))
        return F.struct(*out)

    return counts.select("stratum", F.transform(F.sequence(F.lit(0), F.lit(steps)), vector).alias("path"))


def rejects(cuts: Column, rules) -> Column:
    """Whether any statistic is above its cutoff (no cutoff, or no statistic: no)."""
    return reduce(lambda a, b: a | b, [
        F.coalesce(F.expr(stat) > cuts.getField(r), F.lit(False)) for r, (stat, _) in rules.items()])


def certified_cutoffs(holdout: DataFrame, rules=None, allowed: float = ALLOWED, mistake: float = MISTAKE,
                      steps: int = STEPS, stride: float = STRIDE) -> DataFrame:
    """stratum, n (texts that test), step and ``cuts`` (struct of a cutoff per rule)
    of the strictest certified step; strata without one are left out.

    ``holdout`` has one row per good text: ``stratum``, ``design`` (whether the text
    belongs to the half that designs the sequence) and the base columns.
    """
    rules = rules or RULES
    paths = cutoff_sequence(holdout.where("design"), rules, steps, stride)
    # A stricter step rejects whatever a looser one does, so the number of steps that
    # reject a text tells which ones do.
    test = holdout.where(~F.col("design")).join(paths, "stratum").select(
        "stratum", F.size(F.filter("path", lambda c: rejects(c, rules))).alias("hits"))
    per = test.groupBy("stratum", "hits").agg(F.count(F.lit(1)).alias("c"))
    # Of each stratum: texts by hits, at most steps + 2 entries.
    per = per.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("hits", "c")).alias("by"))
    strata = max(holdout.select("stratum").distinct().count(), 1)
    limit = per.select("stratum", "n", "by", allowed_failures(
        F.col("n"), F.lit(float(allowed)), F.lit(mistake / strata)).alias("k"))
    failed = lambda i: F.aggregate("by", F.lit(0).cast("long"), lambda s, x: s + F.when(
        x.getField("hits") >= F.lit(steps + 1) - i, x.getField("c")).otherwise(0))
    passed = F.size(F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda i: failed(i) <= F.col("k")))
    return (limit.withColumn("step", passed - 1).where(F.col("step") >= 0).join(paths, "stratum")
            .select("stratum", "n", "k", "step", F.get("path", F.col("step")).alias("cuts")))


def apply_rules(docs: DataFrame, labels: DataFrame, rules=None, allowed: float = ALLOWED,
                mistake: float = MISTAKE) -> DataFrame:
    """doc_id, stratum, the base columns, base_failed and kept, for every row of
    ``docs`` (doc_id, text, lang); ``labels`` has doc_id and quality (1: good).

    The strata are the languages.  A document fails the base if it has under 50
    words or over half of them in repeated 3-word windows; it is kept if it
    passes the base and no statistic is above its stratum's certified cutoff.
    Where a stratum has no certified step (too few good texts: 86 that test are
    needed with four strata), the rules reject nothing there.  The evidence is
    the distinct texts of labelled good documents that pass the base: copies and
    repeated rows add none.  NULL lang is a stratum; NULL text has no words;
    repeated rows are repeated, and a doc_id labelled twice counts once if any
    label is good; empty tables give an empty result.
    """
    rules = rules or RULES
    d = pick(docs, "doc_id", "text", "lang")
    stats = stored(d.select(
        "doc_id", F.coalesce(F.concat(F.lit("a"), "lang"), F.lit("b")).alias("stratum"), F.md5("text").alias("_text"),
        *[c.alias(n) for n, c in base_columns(F.col("text")).items()])
        .withColumn("base_failed", base_failed()))
    good = (pick(labels, "doc_id", "quality").where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
            .select("doc_id").distinct())
    holdout = stored(stats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
                     .drop("doc_id").dropDuplicates(["stratum", "_text"])
                     .withColumn("design", F.substring("_text", 1, 1) < "8"))
    cuts = stored(certified_cutoffs(holdout, rules, allowed, mistake))
    # One row per language with labels; Spark broadcasts it while it is small.
    return (stats.join(cuts.select("stratum", "cuts"), "stratum", "left")
            .withColumn("kept", ~F.col("base_failed") & ~rejects(F.col("cuts"), rules))
            .select("doc_id", F.when(F.col("stratum") != "b", F.substring("stratum", 2, 1 << 20)).alias("lang"),
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept"))
