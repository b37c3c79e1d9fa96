"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined by batches.

The index (:class:`LineRuns`) is a set of runs: tables of one row per line hash
with the number of documents that have it, bucketed by the hash and sorted, so
that a batch meets the runs by merge joins and no run is shuffled.  A batch of
documents is counted, anti-joined against the *settled* hashes of every run
(those that are common already, whose further copies no longer matter), and what
is left becomes a run of level 0.  ``FANOUT`` runs of one level are compacted
into one of the next, in which the counts add up and more hashes settle.  A row
is rewritten once per level, and there are as many levels as the logarithm of
the batches.

Lines whose key (white space at both ends off, A-Z lowered) is common are then
taken out of every document.  The few hashes that hold a large share of all
lines are matched by a broadcast join (their number has a proven bound), the
others by a shuffle on the hash, so no task gets all copies of a common line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideflow.session import bucketed, materialize, release

from .common import digest, pick, shuffle_parts, stored

#: Runs of one level that are merged into one of the next.
FANOUT = 3
#: Batches that a whole table is added in.
BATCHES = 6
#: A hash with at least one in so many lines is matched by broadcast: there are
#: at most so many such hashes.
HEAVY = 10_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["a", "b"]
#: Hashes do not compress, and codecs cost memory outside the heap for every file.
PLAIN = {"compression": "none"}


def lines_of(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """doc_id, rid, pos, a, b and batch of every line whose key has at least
    ``min_chars`` code points.  (doc_id, rid) is the document, which repeated rows
    share; (a, b) are 128 bits of hash of the key."""
    # the whole text is lowered at once; lines are then only cut and trimmed
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64(digest(F.col("doc_id"), F.col("text"))).alias("rid"),
        F.posexplode(F.split(lowered, "\n", -1)).alias("pos", "line"))
    return rows.withColumn("k", F.btrim("line", F.lit(WHITE))).where(F.char_length("k") >= max(min_chars, 1)).select(
        "doc_id", "rid", "pos", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(7), "k").alias("b"),
        F.pmod("rid", F.lit(batches)).cast("int").alias("batch"))


class LineRuns:
    """The index.  ``min_docs``: documents that make a line common."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = shuffle_parts(spark)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _settled(self, run: DataFrame) -> DataFrame:
        return run.where(F.col("docs") >= self.min_docs).select(*HASH)

    def add(self, batch: DataFrame) -> None:
        """Add the lines (doc_id, rid, a, b) of documents that no other batch has."""
        counts = (batch.groupBy(*HASH, "doc_id", "rid").agg(F.lit(1).alias("n"))
                  .groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs")))
        for run in self.runs():
            counts = counts.join(self._settled(run), HASH, "left_anti")
        self._put(0, bucketed(counts, HASH, self.buckets, **PLAIN))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = bucketed(_merged(runs), HASH, self.buckets, **PLAIN)
            release(*runs)
            self._put(level + 1, merged)

    def common(self) -> DataFrame:
        """(a, b) of the hashes of at least ``min_docs`` documents, by a last
        compaction of all runs.  Ends the index."""
        runs, self.levels = self.runs(), []
        if not runs:
            return self.spark.createDataFrame([], "a long, b long")
        out = stored(self._settled(_merged(runs)))
        release(*runs)
        return out


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One row per hash of the runs, by merge joins of their buckets."""
    def merge(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.withColumnRenamed("docs", "more"), HASH, "full_outer").select(
            *HASH, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
    return reduce(merge, runs)


def common_lines(lines: DataFrame, min_docs: int, batches: int) -> DataFrame:
    """(a, b): the hashes that at least ``min_docs`` documents have, found by
    adding ``lines`` (stored by batch) to an index batch by batch."""
    index = LineRuns(lines.sparkSession, min_docs)
    for i in range(batches):
        index.add(lines.where(F.col("batch") == i))
    return index.common()


def dropped_positions(lines: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, rid and ``gone`` (sorted places of the common lines)."""
    share = max(lines.count() // HEAVY, 1)
    sizes = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share)
    # at most HEAVY rows: each has one in HEAVY of all lines
    heavy = stored(common.join(sizes, HASH).select(*HASH).withColumn("heavy", F.lit(True)))
    marked = lines.join(F.broadcast(heavy), HASH, "left")
    light = common.join(F.broadcast(heavy), HASH, "left_anti")
    hits = (marked.where("heavy").select("doc_id", "rid", "pos").unionByName(
        marked.where(F.col("heavy").isNull()).join(light, HASH).select("doc_id", "rid", "pos")))
    return hits.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines that are not at the sorted places ``gone``, joined by \\n: the
    stretches between those places, so the work grows with the lines only."""
    def cut(s: Column) -> Column:
        stretch = F.transform(F.sequence(F.lit(0), F.size(s["at"]) - 2), lambda i: F.slice(
            s["lines"], s["at"][i] + 2, s["at"][i + 1] - s["at"][i] - 1))
        return F.array_join(F.flatten(stretch), "\n")

    at = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.transform(F.array(F.struct(lines.alias("lines"), at.alias("at"))), cut)[0]


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                      batches: int = BATCHES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every row of ``docs``: its text
    without the lines whose key at least ``min_docs`` documents have.

    Keys of under ``min_chars`` code points (blank lines) always stay.  Rows equal
    in id and text are one document and get equal results; a NULL doc_id is an
    id; a NULL or empty text is one empty line and comes back as ''.  Columns
    but doc_id and text are not read.  An empty table gives an empty result.
    """
    lines = materialize(lines_of(docs, batches, min_chars), partition_by=("batch",), **PLAIN)
    common = common_lines(lines, min_docs, batches)
    gone = dropped_positions(lines, common).select(
        F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "gone")
    rows = pick(docs, "doc_id", "text").withColumn("rid", F.xxhash64(digest(F.col("doc_id"), F.col("text"))))
    joined = rows.join(gone, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, "\n", -1)
    out = stored(joined.select(
        "doc_id", F.when(F.col("gone").isNull(), text).otherwise(without(split, F.col("gone"))).alias("text"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")))
    release(lines, common)
    return out
