"""Exact top-k Hamming search over binary codes, by incremental multi-index hashing.

A code is an array of 64-bit words, cut into m segments, about log2(rows) bits each and 16 at most, and
the index holds every distinct code under each of its segments.  Round s looks
up, for every query that is still open, all values at distance exactly s from
its own in every segment.  After round s every code within m * (s + 1) - 1 bits
of the query has been verified, so a query whose k-th verified distance is no
larger is complete; the others go on with radius s + 1.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideflow.session import release

from .common import stored

BITS, WIDEST = 64, 16                  # of a word, and of a segment at most


def sign_code(vector: Column, words: int = 1) -> Column:
    """``words`` words of 64 bits: bit i is 1 if component i is above 0 (missing ones
    are 0).  NULL for a NULL vector; components beyond the words raise an error."""
    def word(w: int) -> Column:
        bits = F.transform(F.slice(vector, w * BITS + 1, BITS), lambda x, i: F.when(
            x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    wide = F.raise_error(F.lit(f"a vector has more than {words * BITS} components")).cast("array<bigint>")
    return F.when(F.size(vector) > words * BITS, wide).when(
        vector.isNotNull(), F.array(*[word(w) for w in range(words)]))


def words_for(vectors: DataFrame, column: str) -> int:
    """Words that the longest vector needs."""
    most = vectors.agg(F.max(F.size(column))).first()[0] or 0
    return max(1, -(-most // BITS))


def segments(rows: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each segment; none crosses words."""
    m = max(BITS // WIDEST, min(BITS, round(BITS / max(1.0, log2(max(rows, 2))))))
    edge = [round(BITS * i / m) for i in range(m + 1)]
    return [(w, edge[i], edge[i + 1] - edge[i]) for w in range(words) for i in range(m)]


def _part(code: Column, word: int, at: int, width: int) -> Column:
    return F.shiftrightunsigned(F.get(code, word), at).bitwiseAND(F.lit((1 << width) - 1))


def _parts(code: Column, cut) -> Column:
    return F.array(*[_part(code, *c) for c in cut])


def masks(width: int, s: int) -> Column:
    """All values of ``width`` bits with s bits set, as one folded constant (at
    most 12,870 of them)."""
    values = [sum(1 << b for b in c) for c in combinations(range(width), s)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def search_codes(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``q``, ``code``, ``distance``: for every distinct query code ``q`` all
    index codes no farther than its k-th nearest row.  ``index`` has distinct
    codes (arrays of as many words) with ``n`` rows each, ``queries`` distinct codes
    ``q``."""
    size = index.agg(F.count(F.lit(1)), F.sum("n"), F.max(F.size("code"))).first()
    enough = min(k, size[1] or 0)
    if not enough:
        return queries.join(index.select("code"), F.lit(False)).select(
            "q", "code", F.lit(0).alias("distance"))
    words = size[2]
    cut = segments(size[0], words)
    m, widest = len(cut), max(w for *_, w in cut)
    at = stored(index.select("code", "n", F.posexplode(_parts(F.col("code"), cut)).alias("seg", "val")))
    open_queries, found = stored(queries), None
    for s in range(widest + 1):
        flips = F.coalesce(*[F.when(F.col("seg").isin([j for j, (*_, x) in enumerate(cut) if x == w]), masks(w, s))
                             for w in sorted({w for *_, w in cut})])
        probes = (open_queries.select("q", F.posexplode(_parts(F.col("q"), cut)).alias("seg", "own"))
                  .select("q", "seg", "own", F.explode(flips).alias("_m"))
                  .select("q", "seg", F.col("own").bitwiseXOR(F.col("_m")).alias("val")))
        by_segment = F.array(*[F.bit_count(_part(F.col("code"), *c).bitwiseXOR(_part(F.col("q"), *c))) for c in cut])
        distance = reduce(lambda a, b: a + b, [
            F.bit_count(F.get("code", w).bitwiseXOR(F.get("q", w))) for w in range(words)])
        # A code is met in every segment and round in which it is s apart: take
        # it in its nearest segment only, the first of equally near ones.
        first = (F.array_min(by_segment) == s) & (F.array_position(by_segment, s) == F.col("seg") + 1)
        # Spark takes the probes for as small as the queries they come from: no broadcast.
        new = stored(probes.hint("merge").join(at, ["seg", "val"]).where(first)
                     .select("q", "code", "n", distance.cast("int").alias("distance")))
        found = new if found is None else found.unionByName(new)
        covered = m * (s + 1) - 1
        so_far = Window.partitionBy("q").orderBy("distance")
        kth = (found.groupBy("q", "distance").agg(F.sum("n").alias("n"))
               .withColumn("_c", F.sum("n").over(so_far)).where(F.col("_c") >= enough)
               .groupBy("q").agg(F.min("distance").alias("kth")))
        done = kth.where(F.col("kth") <= covered)
        rest = stored(open_queries.join(done, "q", "left_anti"))
        if s == widest or rest.isEmpty():
            kth = stored(kth)
            out = stored(found.join(kth, "q").where(F.col("distance") <= F.col("kth"))
                         .select("q", "code", "distance"))
            release(at, rest, kth)
            return out
        open_queries = rest


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank`` (1 .. k), ``id``, ``distance``: the k rows of
    ``rows`` (``id``, ``code``) nearest to each of ``queries`` (``query_id``,
    ``code``), by Hamming distance, then id; exact.  Codes are arrays of as many
    64-bit words each, or single words.

    A row that is its own query is among its results.  Rows or queries with a
    NULL id or code are left out, rows that repeat count once.  With fewer than
    k rows all are returned; an empty index or no queries give no rows.  Of
    equal codes only the k smallest ids can be results, so a code's ids are
    limited to them before the shuffle.
    """
    rows, queries = (d.withColumn("code", F.when(F.col("code").isNotNull(), F.array("code")))
                     if d.schema["code"].dataType.simpleString() == "bigint" else d for d in (rows, queries))
    clean = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code")
    by_id = Window.partitionBy("code").orderBy("id")
    ids = stored(clean.distinct().withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k))
    index = stored(ids.groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    asked = stored(queries.where(F.col("query_id").isNotNull() & F.col("code").isNotNull())
                   .select("query_id", F.col("code").alias("q")).distinct())
    near = search_codes(index, asked.select("q").distinct(), k)
    best = Window.partitionBy("q").orderBy("distance", "id")
    ranked = stored(near.join(ids.select("id", "code"), "code")
                    .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    release(index, near)
    return asked.join(ranked, "q").select("query_id", "rank", "id", "distance")
