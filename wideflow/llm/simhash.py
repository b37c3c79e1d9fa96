"""SimHash near-dedup: fingerprints, and components at a maximum bit distance.

Candidates come from a segment-popcount embedding: the 64 bits are 32 segments
of two, and a fingerprint maps to its 32 bit counts (0, 1 or 2), packed two
bits each.  The Manhattan distance of two embeddings never exceeds the Hamming
distance.  The segments are dealt into groups with radii r such that
sum(r + 1) > max_bits, so fingerprints within max_bits agree within Manhattan
distance r in some group: the grid cells of a group are its bit counts, and a
range join looks into a cell and the cells within r of it, in one of the two
directions only.  Candidates are verified by their Hamming distance.
"""

from __future__ import annotations

from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideflow.session import release

from .common import digest, pick, slices, stored, with_key
from .components import connected_components

SEGMENTS, SEGMENT_BITS = 32, 2
LOW = 0x5555555555555555
#: Shingles hashed at once; bounds the memory that a text of any length needs.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash: XXH64 (seed 42) of the word shingles, A-Z lowered."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()        # bytes: ASCII case and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]) - 1
    stops = stops.tolist()
    line = b" ".join(words)
    ones, h64 = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        h = np.fromiter((h64(line[a:b], 42) for a, b in zip(starts[i:i + BLOCK], stops[i:i + BLOCK])),
                        dtype="<u8", count=min(BLOCK, n - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *keep: str) -> DataFrame:
    """doc_id, the string columns ``keep`` and ``fp`` (64 bits as a long) of
    every row, over whole texts, in one pass without a shuffle.  NULL, empty
    and blank texts have fp 0."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                fp = [fingerprint(x, shingle) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {c: part.column(c) for c in ("doc_id", *keep)} | {"fp": pa.array(fp, pa.int64())})

    return pick(docs, "doc_id", "text", *keep).mapInArrow(
        run, ", ".join(["doc_id long", *[f"{c} string" for c in keep], "fp long"]))


# --- the grid ------------------------------------------------------------------

def designs(max_bits: int) -> list[list[tuple[int, int, int]]]:
    """Ways to deal the segments: lists of (first segment, segments, radius)
    with sum(radius + 1) > max_bits, for radii up to 0, 1 and 2."""
    out = []
    for top in (0, 1, 2):
        radii, need = [], max_bits + 1
        while need > 0:
            radii.append(min(top, need - 1))
            need -= radii[-1] + 1
        weight = [(8, 12, 19)[r] for r in radii]
        edge = [round(SEGMENTS * sum(weight[:i]) / sum(weight)) for i in range(len(radii) + 1)]
        if len(radii) <= SEGMENTS:
            out.append([(edge[i], edge[i + 1] - edge[i], r) for i, r in enumerate(radii)])
    return out


def cost(design: list[tuple[int, int, int]], n: int) -> float:
    """Rows that the join reads plus a share for each candidate, for n random
    fingerprints.  A segment's counts are equal with probability 3/8, one apart
    with 1/2, two apart with 1/8."""
    rows = pairs = 0.0
    for _, k, r in design:
        same = (3 / 8) ** k
        near = [1.0, k * 4 / 3, comb(k, 2) * 16 / 9 + k / 3][:r + 1]
        pairs += same * sum(near)
        rows += 1 + sum([0.75 * k, comb(k, 2) * 0.9 + k / 4][:r])
    return n * rows + 0.05 * n * n / 2 * pairs


def moves(k: int, r: int) -> list[tuple[int, int, int, int]]:
    """One of each pair of opposite steps of Manhattan length 1 to r over k
    segments: (what to add to the cell, bits that must be 0, segments that must
    not be 0, segments that must be 0)."""
    one = [1 << (2 * d) for d in range(k)]
    out = []
    if r >= 1:
        out += [(x, x << 1, 0, 0) for x in one]
    if r >= 2:
        out += [(2 * x, 0, 0, x) for x in one]
        for i, x in enumerate(one):
            for y in one[i + 1:]:
                out += [(x + y, (x << 1) | (y << 1), 0, 0), (x - y, x << 1, y, 0)]
    return out


def embedding(fp: Column) -> Column:
    """The 32 bit counts, two bits each."""
    a, b = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cells(nodes: DataFrame, design) -> DataFrame:
    """A row (g, cell) for each fingerprint and group, beside the other columns."""
    e = embedding(F.col("fp"))
    return nodes.select("*", F.posexplode(F.array(*[
        F.shiftrightunsigned(e, 2 * at).bitwiseAND(F.lit((1 << (2 * k)) - 1 if k < SEGMENTS else -1))
        for at, k, _ in design])).alias("g", "cell"))


def neighbours(home: DataFrame, design) -> DataFrame:
    """The cells within a group's radius, in one of the two directions; the
    cell itself is left out.  The number of steps is fixed by the design."""
    out = None
    for g, (_, k, r) in enumerate(design):
        steps = moves(k, r)
        if not steps:
            continue
        own = home.where(F.col("g") == g)
        lists = [F.array(*[F.lit(s[i]).cast("long") for s in steps]) for i in range(4)]
        c, low = F.col("cell"), F.lit(sum(1 << (2 * d) for d in range(k)))
        some = c.bitwiseOR(F.shiftrightunsigned(c, 1)).bitwiseAND(low)      # 1 where not 0
        t = own.withColumn("_s", F.explode(F.arrays_zip(*[x.alias(f"m{i}") for i, x in enumerate(lists)])))
        t = (t.where((c.bitwiseAND(F.col("_s.m1")) == 0)
                     & (some.bitwiseAND(F.col("_s.m2")) == F.col("_s.m2"))
                     & (some.bitwiseAND(F.col("_s.m3")) == 0))
             .withColumn("cell", c + F.col("_s.m0")).drop("_s"))
        out = t if out is None else out.unionByName(t)
    return home.where(F.lit(False)) if out is None else out


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``, with
    ``n`` documents each) whose components are exactly those of all pairs
    within ``max_bits``.

    First every cell links its members to its most frequent fingerprint where
    they are within max_bits; the components of these links contract dense
    groups.  Then only pairs from different components are compared: single
    fingerprints with everything in reach, and members of contracted groups
    only where two different groups meet in reach of a cell.  So a large group
    of near copies costs one comparison a member and cell, not all its pairs,
    and no pair that could join two components is left out.
    """
    n = fps.count()
    design = min(designs(max_bits), key=lambda x: cost(x, n))
    home = cells(fps, design)
    hubs = stored(home.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "fp")).getField("fp").alias("hub"))
        .where(F.col("k") > 1).drop("k"))
    near = distance(F.col("fp"), F.col("hub")) <= max_bits
    star = stored(home.select("g", "cell", "fp").join(hubs, ["g", "cell"])
                  .where((F.col("fp") != F.col("hub")) & near)
                  .select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    groups = connected_components(star)
    members = stored(fps.select("fp").join(groups.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", F.coalesce("component", "fp").alias("c"),
                             F.col("component").isNotNull().alias("many")))
    left = cells(members, design)
    right = (left.withColumn("step", F.lit(0))
             .unionByName(neighbours(left, design).withColumn("step", F.lit(1))))
    right = right.select("g", "cell", "step", *[F.col(x).alias(f"{x}_2") for x in ("fp", "c", "many")])
    close = distance(F.col("fp"), F.col("fp_2")) <= max_bits
    other = F.col("c") != F.col("c_2")
    once = (F.col("step") == 1) | (F.col("fp") < F.col("fp_2"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, ["g", "cell"]).where(close & other & once)

    single = pairs(left.where(~F.col("many")), right)
    mixed = pairs(left.where("many"), right.where(~F.col("many_2")))
    lm, rm = left.where("many"), right.where("many_2")
    meet = (lm.select("g", "cell", "c").distinct()
            .join(rm.select("g", "cell", "c_2", "step").distinct(), ["g", "cell"])
            .where(other & ((F.col("step") == 1) | (F.col("c") < F.col("c_2")))))
    crowd = (meet.join(lm, ["g", "cell", "c"]).join(rm, ["g", "cell", "c_2", "step"]).where(close))
    found = [x.select(F.col("fp").alias("a"), F.col("fp_2").alias("b")) for x in (single, mixed, crowd)]
    return star.unionByName(found[0]).unionByName(found[1]).unionByName(found[2])


def _components(own: DataFrame, max_bits: int) -> DataFrame:
    """``fp`` and ``root`` (one fingerprint of its component) from stored rows
    with a column ``fp``."""
    fps = stored(own.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    comp = connected_components(links(fps, max_bits))
    out = stored(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", F.coalesce("component", "fp").alias("root")))
    release(fps, comp)
    return out


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, ``fp`` (long), fingerprint (16 hex digits) and component_id for
    every row of ``docs``.

    component_id is the smallest doc_id that is reached over fingerprints at
    most ``max_bits`` apart, the document's own included.  Documents without
    words share fingerprint zero and link like any others.  A NULL doc_id is
    never a component_id (NULL if the component has no other); repeated rows
    are repeated; an empty table gives an empty result.
    """
    own = stored(fingerprints(docs, shingle))
    roots = _components(own, max_bits)
    ids = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = stored(roots.join(ids, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(roots.join(least, "root").select("fp", "component_id"))
    release(roots, ids, least)
    return own.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest
    doc_id (NULL last), then the smallest digest.  Rows that repeat it in id
    and text stay once; all columns are kept as they are."""
    plain = pick(docs, "doc_id", "text")
    keyed = plain.withColumn("key", digest(F.col("doc_id"), F.col("text")))
    own = stored(fingerprints(keyed, shingle, "key"))
    roots = _components(own, max_bits)
    first = own.groupBy("fp").agg(F.min(F.struct(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), "key")).alias("first"))
    winners = stored(roots.join(stored(first), "fp").groupBy("root").agg(F.min("first").alias("first"))
                     .select(F.col("first.key").alias("_key")))
    release(own, roots)
    rows = with_key(docs, "_key", digest)
    columns = [c for c in rows.columns if c != "_key"]
    once = rows.groupBy("_key").agg(F.first(F.struct(*columns)).alias("_row"))
    return (once.join(winners, "_key", "left_semi")
            .select(*[F.col(f"_row.{c}") for c in columns]).toDF(*docs.columns))
