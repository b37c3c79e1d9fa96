"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, n_words, pick, position, stored, with_key
from .prefix import ranged, running, totals

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is read more often than this.
MAX_EPOCHS = 3
SEED = "mix-7"


def targets(per_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words per source.  ``per_source`` has one row per source: ``_g``
    (its key, in code-point order, NULL source last) and ``source_size``.

    All sizes together are shared out by weight; a source stops at
    ``max_epochs`` times its size and the excess is shared again by weight
    until no source is above.  In the order of cap / weight the capped sources
    are a prefix, so prefix sums over the sources give the final share at once.
    """
    everything = Window.partitionBy()
    ranked = Window.orderBy("_g")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    s = (per_source.withColumn("_w", w.cast("long"))
         .withColumn("_cap", F.col("source_size") * max_epochs)
         .withColumn("_all", F.sum("source_size").over(everything)))
    by_cap = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_g")
    s = (s.withColumn("_at", F.row_number().over(by_cap))
         .withColumn("_capped_before", F.coalesce(
             F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_w_from", F.sum("_w").over(
             by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("_share", (F.col("_all") - F.col("_capped_before")).cast("double")
                     / F.col("_w_from"))
         .withColumn("_over", F.col("_share") * F.col("_w") > F.col("_cap"))
         .withColumn("_final", F.min_by("_share", F.when(~F.col("_over"), F.col("_at")))
                     .over(everything)))
    return s.select("_g", "source_size", F.when(F.col("_over"), F.col("_cap").cast("double"))
                    .otherwise(F.col("_final") * F.col("_w")).alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """``rows`` (columns ``source`` string, ``size`` long, ``digest`` string, any
    others) plus ``source_size``, ``target``, ``times`` and ``taken``.

    Every row gets a random key: the md5 of seed and digest.  Within its source
    the rows are sorted by key; a source's target is whole epochs over all its
    rows plus a rest, and the rows whose middle word lies within the rest, by
    prefix sums in key order, are taken once more.  So a source's taken words
    are off its target by half a row at most, and reruns agree.  Rows equal in
    every column are interchangeable.  NULL is a source of its own, the last; a
    row of size 0 takes nothing; an empty table gives an empty result.
    """
    kept = [c for c in rows.columns if c not in ("source_size", "target", "times", "taken")]
    keyed = rows.select(
        *kept, F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")).alias("_g"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("digest"))), 1, 15), 16, 10)
        .cast("long").alias("_key"))
    order = ["_key", "digest", "size"]
    t = ranged(keyed, ["_g"], order)
    offsets = totals(t, ["_g"], ["size"])
    goal = targets(offsets.groupBy("_g").agg(F.sum("_t_size").alias("source_size")),
                   weights, max_epochs)
    goal = (goal.withColumn("_epochs", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")))
    # The targets ride on the small (source, partition) rows, so that the rows
    # themselves join on an even key and not on the source.
    out = running(t, offsets.join(goal, "_g"), ["_g"], order, ["size"])
    times = F.col("_epochs") + F.when(
        F.col("before_size") + F.col("size") / F.lit(2.0) <= F.col("_rest"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.least(times, F.lit(max_epochs))).otherwise(F.lit(0))
    return (out.withColumn("times", times.cast("int"))
            .withColumn("taken", (F.col("size") * F.col("times")).cast("long"))
            .select(*kept, "source_size", "target", "times", "taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, digest, size, source_size, target,
    times, taken."""
    d = pick(docs, "doc_id", "source", "text")
    return mix(d.select("doc_id", "source", digest(F.col("doc_id"), F.col("text")).alias("digest"),
                        n_words(F.col("text")).alias("size")), **options)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to 3 times), all
    columns as they are.  Rows equal in id, text and source are taken together."""
    rows = pick(docs, "doc_id", "text", "source")
    rows = rows.select(_row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("digest"), "source",
                       n_words(F.col("text")).alias("size"))
    units = rows.groupBy("digest", "source").agg(F.sum("size").alias("size"))
    times = stored(mix(units, **options).where(F.col("times") > 0)
                   .select(F.col("digest").alias("_key"), "times"))
    source = position(docs, "source")
    flat = with_key(docs, "_key", lambda i, t: _row_key(
        i, t, F.lit(None).cast("string") if source is None else F.col(f"_c{source}").cast("string")))
    columns = [c for c in flat.columns if c != "_key"]
    return (flat.join(times, "_key").select(*columns, F.explode(F.sequence(F.lit(1), "times")).alias("_copy"))
            .select(*columns).toDF(*docs.columns))


def _row_key(doc_id, text, source):
    return F.md5(F.concat_ws(":", digest(doc_id, text), F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))))
