"""Substring dedup: paragraphs that repeat across documents, by MinHash bands.

A document falls into two kinds of units.  Paragraphs are its lines and its
blocks (the lines up to a blank one, joined) of at least one five-word shingle;
they have nine bands of four MinHashes each over the
five-word shingles, so two paragraphs of Jaccard similarity 0.8 collide with
probability 1 - (1 - 0.8 ** 4) ** 9 = 0.991, and two that share a third of
their shingles with 0.1.  Colliding paragraphs are verified by
the exact Jaccard similarity of their shingle sets, and removals are clustered
by the components of the verified links.  Passages that repeat inside longer
or different paragraphs are found word by word: every ``MIN_PASSAGE`` words in
a row are a window, and the window's seed is the least hash of the ``SEED``
words in a row that it holds.  Equal windows have equal seeds, so only windows
of seeds that two documents share are compared (by the hash of all their
words), and none that repeats is left out.

Every class of equal or linked units stays in the document with the smallest
doc_id; its copies in other documents are removals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideflow.session import release

from .common import (_P, _Q, _power_table, digest, mix, pick, position, shingle_hashes, slices,
                     stored, with_key, word_hashes, word_spans)
from .components import connected_components

SHINGLE, JACCARD, BANDS, ROWS = 5, 0.8, 9, 4
MIN_PASSAGE, SEED = 20, 8
#: Paragraphs of a bucket up to which all its pairs are compared; in a larger one
#: only those that share one of their rarest shingles.
FEW = 16

#: A unit: hash of its words, document, place (first word * 2**31 + words), bands.
#: A text has under 2**31 bytes, so both parts of a place always fit.
UNIT = "h long, doc_id long, rid long, at long, k array<long>"
PLACE_BITS = 31
AT = 1 << PLACE_BITS


def sequence_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words a .. b - 1 for each of the spans."""
    n = len(words)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, dtype=np.uint64),
                                 np.cumsum(words * _power_table(_Q, n), dtype=np.uint64)))
        inverse = _power_table(pow(_Q, -1, 2**64), n + 1)
        return mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(_P))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x


class Texts:
    """Words of a batch of texts in one array, three dead words after each."""

    def __init__(self, texts: list[str]):
        folded = [t.encode() for t in texts]
        gap = b" \x00 \x00 \x00 "
        raw = np.frombuffer(b"".join([x for t in folded for x in (t, gap)]), dtype=np.uint8)
        start, end = word_spans(raw)
        self.words = word_hashes(raw, start, end)
        size = np.array([len(t) for t in folded], dtype=np.int64)
        offset = np.cumsum(size + len(gap)) - size - len(gap)
        # words of text i: first[i] .. last[i] - 1
        self.first = np.searchsorted(start, offset)
        self.last = np.searchsorted(start, offset + size)
        self.dead = np.ones(len(self.words), dtype=bool)
        for a, b in zip(self.first.tolist(), self.last.tolist(), strict=True):
            self.dead[a:b] = False
        breaks = np.flatnonzero(raw == 10)
        self.line_word = np.searchsorted(start, breaks)  # first word after each line end
        # line ends without a word between them: a blank line
        self.block_word = self.line_word[1:][self.line_word[1:] == self.line_word[:-1]]

    def windows(self):
        """(first word in the batch, seed) of every ``MIN_PASSAGE`` words in a
        row of one text, and the hashes of all ``SEED`` words in a row."""
        n = len(self.words) - MIN_PASSAGE + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        at = np.arange(n + MIN_PASSAGE - SEED)
        grams = sequence_hashes(self.words, at, at + SEED)
        dead = np.concatenate(([0], np.cumsum(self.dead)))
        at = np.flatnonzero(dead[MIN_PASSAGE:] == dead[:n])
        return at, sliding_min(grams, MIN_PASSAGE - SEED + 1)[at], grams

    def pieces(self):
        """(text, first word, words, hash) of the pieces, as arrays: the words
        from one seed to the next.  The hash is that of the seed."""
        at, seed, grams = self.windows()
        cut = np.zeros(len(self.words), dtype=bool)
        for j in range(MIN_PASSAGE - SEED + 1):
            cut[at[grams[at + j] == seed] + j] = True
        cut[self.first[self.first < self.last]] = True
        ends = self.last[self.first < self.last]
        edge = cut.copy()
        edge[ends] = True                                # a dead word: always inside the array
        at = np.flatnonzero(edge)
        a, b = at[:-1], at[1:]
        live = ~self.dead[a]
        a, b = a[live], b[live]
        text = np.searchsorted(self.first, a, "right") - 1
        h = sequence_hashes(self.words, a, np.minimum(a + SEED, self.last[text]))
        return text, a - self.first[text], b - a, h

    def paragraphs(self):
        """(text, first word, words, hash, band keys) of the lines and blocks."""
        spans = []
        for ends in (self.line_word, self.block_word):
            bounds = np.unique(np.concatenate((self.first, self.last, ends)))
            spans.append(np.stack((bounds[:-1], bounds[1:]), axis=1))
        a, b = np.unique(np.concatenate(spans), axis=0).T   # a block of one line is that line
        text = np.searchsorted(self.first, a, "right") - 1
        ok = (text >= 0) & (b - a >= SHINGLE)
        a, b, text = a[ok], b[ok], text[ok]
        inside = b <= self.last[text]
        a, b, text = a[inside], b[inside], text[inside]
        if not len(a):
            return text, a, b, np.empty(0, np.uint64), np.empty((0, BANDS), np.int64)
        s = shingle_hashes(self.words, SHINGLE)
        pairs = np.stack((a, b - SHINGLE + 1), axis=1).ravel()
        keys = []
        with np.errstate(over="ignore"):
            for j in range(BANDS):
                band = np.full(len(a), j, dtype=np.uint64)
                for r in range(ROWS):
                    x = s * np.uint64((_P + 2 * 0x2545F4914F6CDD1D * (j * ROWS + r)) % 2**64 | 1)
                    band = mix(band * np.uint64(_Q) + np.minimum.reduceat(x ^ (x >> np.uint64(32)), pairs)[::2])
                keys.append(band.view(np.int64))
        # lines and pieces of the same words are units of their own
        h = mix(sequence_hashes(self.words, a, b) + np.uint64(1))
        return text, a - self.first[text], b - a, h, np.stack(keys, axis=1)


def units(rows: DataFrame) -> DataFrame:
    """The units of every row (doc_id, rid, text); place and band keys only of
    paragraphs, the others are seeds."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                t = Texts([x or "" for x in part.column("text").to_pylist()])
                if not len(t.words):
                    continue
                ids, rids = part.column("doc_id"), part.column("rid")
                text, _, _, h = t.pieces()
                ok = (t.last - t.first)[text] >= MIN_PASSAGE
                # a seed counts once in a text
                seeds = np.unique(np.rec.fromarrays((text[ok], h[ok]), names="text,h"))
                yield made(ids, rids, seeds.text, None, None, seeds.h, None)
                text, start, n, h, keys = t.paragraphs()
                if len(text):
                    yield made(ids, rids, text, start, n, h, keys)

    def made(ids, rids, text, start, n, h, keys):
        k = (pa.nulls(len(text), pa.list_(pa.int64())) if keys is None else
             pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * BANDS),
                                      pa.array(keys.ravel())))
        take = pa.array(text)
        return pa.RecordBatch.from_pydict({
            "h": pa.array(h.view(np.int64)), "doc_id": ids.take(take), "rid": rids.take(take),
            "at": pa.nulls(len(text), pa.int64()) if start is None else pa.array(
                start.astype(np.int64) * AT + n), "k": k})

    return rows.select("doc_id", "rid", "text").mapInArrow(run, UNIT)


def covered(n: int, spans) -> np.ndarray:
    """Which of n words the spans (start, words) cover; the work is that of both."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for a, k in spans:
        edge[min(a, n)] += 1
        edge[min(a + k, n)] -= 1
    return np.cumsum(edge[:n]) > 0


def cut_words(n: int, gone, kept) -> np.ndarray:
    """Which of n words go: those that a span of ``gone`` covers and none of ``kept``."""
    return covered(n, gone or []) & ~covered(n, kept or [])


def seeded_windows(rows: DataFrame) -> DataFrame:
    """``h``, doc_id, rid, ``start`` and ``dead`` of the windows whose seed is listed in
    ``seeds``, of every row (doc_id, rid, text, seeds, gone, kept).  ``dead``: a word
    of the window goes with a paragraph (``gone`` and ``kept``: places of units)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                t = Texts([x or "" for x in part.column("text").to_pylist()])
                at, seed, _ = t.windows()
                text = np.searchsorted(t.first, at, "right") - 1
                edge = np.searchsorted(text, np.arange(part.num_rows + 1))
                wanted = [np.isin(seed[a:b], np.array(own, dtype=np.int64).view(np.uint64))
                          for a, b, own in zip(edge[:-1], edge[1:], part.column("seeds").to_pylist(), strict=True)]
                ok = np.concatenate(wanted)
                at, text = at[ok], text[ok]
                cut = np.zeros(len(t.words) + 1, dtype=np.int64)
                for j, (gone, kept) in enumerate(zip(part.column("gone").to_pylist(), part.column("kept").to_pylist(),
                                                     strict=True)):
                    if gone:
                        a, b = int(t.first[j]), int(t.last[j])
                        cut[a + 1:b + 1] = cut_words(b - a, spans(gone), spans(kept))
                cut = np.cumsum(cut)
                for i in range(0, len(at), 100_000):
                    a, take = at[i:i + 100_000], text[i:i + 100_000]
                    h = sequence_hashes(t.words, a, a + MIN_PASSAGE)
                    yield pa.RecordBatch.from_pydict({
                        "h": pa.array(h.view(np.int64)), "doc_id": part.column("doc_id").take(pa.array(take)),
                        "rid": part.column("rid").take(pa.array(take)), "start": pa.array(a - t.first[take]),
                        "dead": pa.array(cut[a + MIN_PASSAGE] > cut[a])})

    def spans(places):
        return [(x["start"], x["n"]) for x in places or []]

    return rows.select("doc_id", "rid", "text", "seeds", "gone", "kept").mapInArrow(
        run, "h long, doc_id long, rid long, start long, dead boolean")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``node`` and ``sh`` (distinct shingle hashes) of the spans listed in
    ``spans`` (array of node, start, n) of every row (text, spans)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                t = Texts([x or "" for x in part.column("text").to_pylist()])
                node, sets = [], []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    own = t.words[t.first[i]:t.last[i]]
                    for s in spans:
                        node.append(s["node"])
                        sets.append(np.unique(shingle_hashes(
                            own[s["start"]:s["start"] + s["n"]], SHINGLE)).view(np.int64))
                if node:
                    size = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array(node, pa.int64()),
                        "sh": pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(sets)))})

    return rows.select("text", "spans").mapInArrow(run, "node long, sh array<long>")


def place(at):
    """First word and number of words of a unit."""
    return (F.shiftright(at, PLACE_BITS).alias("start"), at.bitwiseAND(F.lit(AT - 1)).alias("n"))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, rid (a hash of id and text: equal for repeated rows)."""
    return pick(docs, "doc_id", "text").withColumn(
        "rid", F.xxhash64(digest(F.col("doc_id"), F.col("text"))))


LAST = 2**63 - 1


def first_row():
    """The order in which documents keep a class: by doc_id, NULL last, then rid."""
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "rid")


def rare_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``score`` (in how many of ``nodes`` one of its shingles is, on average) and
    ``rare``: of its rarest shingles, as many as a set of Jaccard similarity ``JACCARD``
    must share one of, (``s``, ``left``: the shingles from this one on, itself included).
    Those that one node alone has count, but are left out."""
    own = (sets.join(nodes, "node", "left_semi")
           .select("node", F.size("sh").alias("z"), F.explode("sh").alias("s")))
    known = own.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    ordered = (own.join(known, "s").groupBy("node", "z")
               .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "s"))).alias("t")))
    # all shared ones are among the last size(t) of z, and at least JACCARD * z are
    some = F.size("t") - F.ceil(F.col("z") * F.lit(JACCARD) - F.lit(1e-6)).cast("int") + F.lit(1)
    rare = F.transform(F.slice("t", 1, F.greatest(some, F.lit(0))), lambda x, i: F.struct(
        x["s"].alias("s"), (F.size("t") - i).alias("left")))
    return ordered.select("node", (F.col("n") / F.col("z")).alias("score"), rare.alias("rare"))


def paragraph_links(members: DataFrame, sets: DataFrame, verified) -> DataFrame:
    """``a``, ``b``: verified links between paragraphs that share a bucket, whose
    components are those of all such links.

    ``members`` (``bucket``, ``node``, ``z``: shingles) and ``sets`` (``node``, ``sh``) are
    stored tables; ``verified`` keeps the true links of a frame of pairs (``a``, ``b``).
    First the paragraphs of a bucket that are about as long are compared with the
    one of them whose shingles the most others have: of near copies that is one with
    few edits, which most others are linked to.  Pairs whose components differ after
    that are compared if their sizes allow a link and, in a bucket of more than
    ``FEW``, if they share a shingle among their rarest and have enough shingles
    from there on.  Every pair that is linked passes both.
    """
    sized = stored(members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
                                .where(F.col("m") > 1), "bucket"))
    rare = stored(rare_shingles(sets, sized.where(F.col("m") > FEW).select("node").distinct()))
    ranked = sized.join(rare.select("node", "score"), "node", "left").withColumn(
        "length", F.floor(F.log("z") / F.lit(-math.log(JACCARD))))
    hubs = ranked.groupBy("bucket", "length").agg(F.max(F.struct("score", "node")).alias("hub"))
    star = stored(verified(ranked.join(hubs, ["bucket", "length"]).where(F.col("node") != F.col("hub.node"))
                           .select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()))
    groups = connected_components(star)
    rest = stored(sized.join(groups, "node", "left")
                  .select("bucket", "node", "z", "m", F.coalesce("component", "node").alias("c")))
    # In a pair of two components one is not the bucket's largest.
    mixed = (rest.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "c")).alias("most"))
             .where(F.col("parts") > 1))
    mixed = stored(rest.join(mixed, "bucket").select(
        "bucket", "node", "z", "m", "c", (F.col("c") == F.col("most.c")).alias("main")))

    def pairs(t: DataFrame, on: list[str], *conditions) -> DataFrame:
        other = t.select(*on, *[F.col(x).alias(f"{x}_2") for x in t.columns if x not in on])
        met = t.where(~F.col("main")).join(other, on).where(
            (F.col("c") != F.col("c_2")) & (F.col("main_2") | (F.col("node") < F.col("node_2")))
            & (F.least("z", "z_2") >= F.lit(JACCARD) * F.greatest("z", "z_2") - F.lit(1e-6)))
        for x in conditions:
            met = met.where(x)
        return met.select(F.col("node").alias("a"), F.col("node_2").alias("b"))

    few = mixed.where(F.col("m") <= FEW).drop("m")
    many = (mixed.where(F.col("m") > FEW).drop("m")
            .join(rare.select("node", F.inline("rare")), "node"))
    enough = F.least("left", "left_2") >= F.lit(JACCARD / (1 + JACCARD)) * (F.col("z") + F.col("z_2")) - F.lit(1e-6)
    met = pairs(few, ["bucket"]).union(pairs(many, ["bucket", "s"], enough)).distinct()
    out = stored(star.unionByName(verified(met)))
    release(sized, rare, star, groups, rest, mixed)
    return out


def paragraph_classes(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``node`` and ``component`` of paragraphs that go with others that differ.  A
    component is named by its paragraph in the earliest document, which stays, and
    holds the paragraphs of the linked ones that match this one directly; others
    are left to their own equals."""
    lines = own.where(F.col("k").isNotNull())
    distinct = stored(lines.groupBy(F.col("h").alias("node")).agg(
        F.min(F.struct("doc_id", "rid", "at", "k")).alias("one"), F.min(first_row()).alias("first")))
    members = distinct.select(F.explode("one.k").alias("bucket"), "node")
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
                    .where(F.col("m") > 1).select("bucket"))
    members = stored(members.join(shared, "bucket", "left_semi"))
    wanted = distinct.join(members.select("node").distinct(), "node", "left_semi")
    per_row = wanted.groupBy("one.rid", "one.doc_id").agg(
        F.collect_list(F.struct("node", *place(F.col("one.at")))).alias("spans"))
    # A document that is repeated as a row gives its sets as often: once is enough.
    sets = stored(shingle_sets(
        rows.join(per_row.select(F.col("rid").alias("_r"), F.col("doc_id").alias("_d"), "spans"),
                  (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))))
        .groupBy("node").agg(F.first("sh").alias("sh")))

    # A shingle that one paragraph alone has is missing in every other, so a
    # paragraph with over a fifth of such shingles links to nothing.  This takes
    # out paragraphs that only share a common passage, before any pair is made.
    alone = (sets.select("node", F.explode("sh").alias("s")).groupBy("s")
             .agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where(F.col("c") == 1)
             .groupBy("node").agg(F.count(F.lit(1)).alias("u")))
    possible = stored(sets.select("node", F.size("sh").alias("z")).join(alone, "node", "left")
                      .where(F.coalesce("u", F.lit(0)) <= F.col("z") * F.lit(1 - JACCARD) + F.lit(1e-9))
                      .select("node", "z"))
    met = stored(members.join(possible, "node"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("sh").alias("_a"))
        right = sets.select(F.col("node").alias("b"), F.col("sh").alias("_b"))
        both = F.size(F.array_intersect("_a", "_b"))
        return (pairs.join(left, "a").join(right, "b")
                .where(both >= F.lit(JACCARD) * (F.size("_a") + F.size("_b") - both)).select("a", "b"))

    links = paragraph_links(met, sets, verified)
    linked = connected_components(links)
    keepers = stored(linked.join(distinct.select("node", "first"), "node").groupBy("component")
                     .agg(F.min(F.struct("first", "node")).alias("keeper"))
                     .select("component", F.col("keeper.node").alias("keeper")))
    direct = verified(linked.join(keepers, "component").where(F.col("node") != F.col("keeper"))
                      .select(F.col("node").alias("a"), F.col("keeper").alias("b")))
    out = stored(direct.select(F.col("a").alias("node"), F.col("b").alias("component"))
                 .union(keepers.select("keeper", "keeper")))
    release(distinct, shared, members, met, sets, possible, links, linked, keepers)
    return out


def _extra(occurrences: DataFrame, *columns) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``rid``, ``columns`` and ``kept_doc_id`` of the occurrences (h, doc_id,
    rid) of units that an earlier document has, as often as rows repeat, and the
    stored table behind them."""
    first = stored(occurrences.groupBy("h").agg(
        F.min("rid").alias("lo"), F.max("rid").alias("hi"),
        F.min(first_row()).alias("first"))
        .where(F.col("lo") != F.col("hi")).select("h", "first"))
    return (occurrences.join(first, "h").where(F.col("rid") != F.col("first.rid"))
            .select("doc_id", "rid", *columns, F.nullif(F.col("first.id"), F.lit(LAST)).alias("kept_doc_id"))), first


def passage_windows(rows: DataFrame, own: DataFrame, units_of: DataFrame | None = None) -> DataFrame:
    """The windows (h, doc_id, rid, start, dead) whose seeds two documents share.
    ``units_of`` (doc_id, rid, gone, kept): the paragraphs that go, and those that
    others rely on; without it no window is dead."""
    seeds = own.where(F.col("k").isNull()).select("h", "doc_id", "rid")
    classes = stored(seeds.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
                     .where(F.col("lo") != F.col("hi")).select("h"))
    per_row = (seeds.join(classes, "h", "left_semi").groupBy("rid", "doc_id")
               .agg(F.collect_set("h").alias("seeds"))
               .select(F.col("rid").alias("_r"), F.col("doc_id").alias("_d"), "seeds"))
    asked = by_row(rows, per_row)
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    if units_of is None:
        asked = asked.withColumns({"gone": none, "kept": none})
    else:
        asked = by_row(asked, units_of.withColumnsRenamed({"rid": "_r", "doc_id": "_d"}), "left")
    out = stored(seeded_windows(asked))
    release(classes)
    return out


def by_row(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``more`` (one row per document: _r, _d, ...)."""
    return rows.join(more, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), how).drop("_r", "_d")


def paragraph_units(own: DataFrame, near: DataFrame) -> DataFrame:
    """h (class), doc_id, rid, at of every paragraph."""
    return (own.where(F.col("k").isNotNull()).join(near.withColumnRenamed("node", "h"), "h", "left")
            .select(F.coalesce("component", "h").alias("h"), "doc_id", "rid", "at"))


def decided(occurrences: DataFrame, live, *columns) -> tuple[DataFrame, DataFrame]:
    """doc_id, rid, ``columns`` and ``goes`` (and the stored table behind them) of the occurrences (h, doc_id, rid) of
    units that several documents have.  The earliest document with a ``live`` one
    keeps its own (goes: false), other live ones go; if none is live, all that is
    left of the unit went before, and it has no rows."""
    classes = stored(occurrences.groupBy("h").agg(
        F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.min(F.when(live, first_row())).alias("first"))
        .where((F.col("lo") != F.col("hi")) & F.col("first").isNotNull()).select("h", "first"))
    return occurrences.where(live).join(classes, "h").select(
        "doc_id", "rid", *columns, (F.col("rid") != F.col("first.rid")).alias("goes")), classes


def per_document(units: DataFrame, place, gone: str, kept: str) -> DataFrame:
    """doc_id, rid and arrays of the places that go and of those that stay (each
    once, however often a row repeats)."""
    return units.groupBy("rid", "doc_id").agg(F.collect_set(F.when(F.col("goes"), place)).alias(gone),
                                              F.collect_set(F.when(~F.col("goes"), place)).alias(kept))


def removals(rows: DataFrame) -> DataFrame:
    """rid, doc_id, gone, kept, w_gone, w_kept: what goes from each document.

    Paragraphs come first.  A word goes with a paragraph that goes, unless a
    paragraph that other documents rely on holds it too.  Then windows of
    ``MIN_PASSAGE`` words: those with a word that goes already are dead, the earliest
    document with a live one keeps it, and a word goes with a window that goes
    unless a window that the document keeps holds it too.  So every window that is
    taken out of a live place stands whole in the document that keeps it.
    """
    own = stored(units(rows))
    near = paragraph_classes(rows, own)
    lines = paragraph_units(own, near)
    paragraphs, classes = decided(lines, F.lit(True), "at")
    spans = stored(per_document(paragraphs, F.struct(*place(F.col("at"))), "gone", "kept"))
    windows = passage_windows(rows, own, spans)
    release(own, near, classes)
    passages, classes = decided(windows, ~F.col("dead"), "start")
    starts = per_document(passages, F.col("start"), "w_gone", "w_kept")
    out = stored(spans.withColumn("_s", F.coalesce("doc_id", F.lit(LAST)))
                 .join(starts.withColumn("_s", F.coalesce("doc_id", F.lit(LAST))).drop("doc_id"), ["rid", "_s"], "full_outer")
                 .withColumn("doc_id", F.nullif(F.col("_s"), F.lit(LAST))).drop("_s"))
    release(spans, windows, classes)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, rid, kind, start_word, n_words, kept_doc_id: the stretches of
    words (counted over the whole text, white space apart) of each document
    that repeat text of the document kept_doc_id, which keeps it.

    Kind 'paragraph': a line or a block of lines up to a blank one, of at least
    five words, equal to or of Jaccard similarity 0.8 with the one that is kept; kind 'passage': at least 20 words in a row, each of
    them within 20 words in a row that an earlier document has too.  Only repeats across documents count;
    rows equal in id and text are one document.  A class stays in its smallest
    doc_id (NULL last), ties by a hash of the text.  NULL and empty texts have
    no units; stretches of the two kinds may overlap.
    """
    rows = identified(docs)
    own = stored(units(rows))
    near = paragraph_classes(rows, own)
    windows = passage_windows(rows, own)
    copies, first_lines = _extra(paragraph_units(own, near), *place(F.col("at")))
    whole = stored(copies.distinct().select(
        "doc_id", "rid", F.lit("paragraph").alias("kind"), F.col("start").alias("start_word"),
        F.col("n").alias("n_words"), "kept_doc_id"))
    release(own, near, first_lines)
    extra, first_windows = _extra(windows.drop("dead"), "start")
    # Windows that overlap or follow each other without a gap are one run.  Repeated
    # rows, runs and their ends all need a document's windows together: one shuffle.
    extra = extra.repartition("rid", "doc_id").dropDuplicates(["rid", "doc_id", "start"])
    order = Window.partitionBy("rid", "doc_id").orderBy("start")
    apart = F.col("start") > F.lag("start", 1, -1 - MIN_PASSAGE).over(order) + F.lit(MIN_PASSAGE)
    runs = (extra.withColumn("_new", apart.cast("int"))
            .withColumn("_run", F.sum("_new").over(order))
            .groupBy("rid", "doc_id", "_run").agg(
                F.min("start").alias("start_word"),
                (F.max("start") + F.lit(MIN_PASSAGE) - F.min("start")).alias("n_words"),
                F.min("kept_doc_id").alias("kept_doc_id"))
            .select("doc_id", "rid", F.lit("passage").alias("kind"), "start_word", "n_words", "kept_doc_id"))
    out = stored(runs.unionByName(whole))
    release(windows, whole, first_windows)
    return out


def without(text: str, cut: np.ndarray) -> str:
    """The text without the words that go and the white space after each."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    start, _ = word_spans(raw)
    start = np.append(start, len(raw))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0]))))
    out, done = [], 0
    data = raw.tobytes()
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(data[done:start[a]])
        done = int(start[b])
    out.append(data[done:])
    return b"".join(out).decode()


def remove_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without their repeated passages (:func:`removals`).  All
    columns are kept; ``text`` is cut and ``n_chars``, where there is one, follows
    it.  A row of which no word is left goes; rows without repeats stay as they
    are.  NULL and empty texts stay; repeated rows are cut alike."""
    spans = removals(identified(docs)).withColumnsRenamed({"rid": "_r", "doc_id": "_d"})
    rows = with_key(docs, "_rid", lambda i, t: F.xxhash64(digest(i, t)))
    rows = rows.withColumn("_id", F.lit(None).cast("long") if position(docs, "doc_id") is None
                           else F.col(f"_c{position(docs, 'doc_id')}").cast("long"))
    joined = rows.join(spans, (F.col("_rid") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    text = f"_c{position(docs, 'text')}"

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series, kept: pd.Series, w_gone: pd.Series, w_kept: pd.Series) -> pd.Series:
        def one(t, *places):
            if t is None or all(y is None or not len(y) for y in places):
                return t
            n = len(word_spans(np.frombuffer(t.encode(), dtype=np.uint8))[0])
            p, q = ([(x["start"], x["n"]) for x in ([] if y is None else y)] for y in places[:2])
            a, b = ([(x, MIN_PASSAGE) for x in ([] if y is None else y)] for y in places[2:])
            return without(t, cut_words(n, p, q) | cut_words(n, a, b))

        return pd.Series([one(*x) for x in zip(texts, gone, kept, w_gone, w_kept, strict=True)], dtype=object)

    some = (F.size(F.coalesce("gone", F.array())) > 0) | (F.size(F.coalesce("w_gone", F.array())) > 0)
    new = F.when(F.col("_cut"), cut(F.col(text), "gone", "kept", "w_gone", "w_kept")).otherwise(F.col(text))
    done = joined.withColumn("_cut", some).withColumn("_new", new)
    done = done.where(~F.col("_cut") | F.rlike("_new", F.lit(r"[^\x20\x09-\x0D]")))
    out = []
    for i, c in enumerate(docs.columns):
        if i == position(docs, "text"):
            out.append(F.col("_new").alias(f"_c{i}"))
        elif i == position(docs, "n_chars"):
            out.append(F.when(~F.col("_cut"), F.col(f"_c{i}")).otherwise(
                F.length("_new").cast(docs.schema[i].dataType)).alias(f"_c{i}"))
        else:
            out.append(F.col(f"_c{i}"))
    return done.select(*out).toDF(*docs.columns)
