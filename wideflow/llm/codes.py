"""Vector code compression: a codebook per part, trained with anchors-hierarchy trees.

Vectors become integers floor(1024 * x) and are cut into equal parts.  Tasks
group their vectors into chunks and build one metric tree per chunk and part
(:mod:`anchors`), once; the trees are stored.  A round of training visits the
trees with the current codebooks (a parameter-sized table: parts x entries x
width) and adds up the sums and numbers of the balls and points that every
entry owns; no vector is moved, and what a task returns does not grow with its
vectors.  A last visit writes every vector's codes and its exact error.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideflow.session import release

from . import anchors
from .common import position, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one chunk, whose trees are built and visited together.
CHUNK = 4096
#: Integer components beyond this could overflow squared distances.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (string if there is none) and v (array of double) of the
    rows whose vector is there and finite, columns found by position."""
    flat = vectors.toDF(*[f"_c{i}" for i in range(len(vectors.columns))])
    at = {n: position(vectors, n) for n in ("vec_id", "label", "embedding")}
    label = F.lit(None).cast("string") if at["label"] is None else F.col(f"_c{at['label']}")
    return flat.select(F.col(f"_c{at['vec_id']}").cast("long").alias("vec_id"), label.alias("label"),
                       F.col(f"_c{at['embedding']}").cast("array<double>").alias("v")).where(finite(F.col("v")))


def whole(values: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Integer parts (rows x parts x width) of the vectors, zeros behind the last."""
    x = np.floor(values * SCALE)
    if np.abs(x).max(initial=0.0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE} in magnitude")
    out = np.zeros((len(x), parts * width), dtype=np.int64)
    out[:, :x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def chunked(rows: DataFrame, dims: int, width: int, parts: int) -> DataFrame:
    """ids, labels and trees (points, copies and trees of all parts, packed) of
    chunks of vectors."""
    kind = rows.schema["label"].dataType.simpleString()

    def chunk(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = whole(flat.reshape(table.num_rows, dims), width, parts)
        arrays = {}
        for p in range(parts):
            points, back, weight = np.unique(x[:, p], axis=0, return_inverse=True, return_counts=True)
            tree = anchors.build(points, weight)
            arrays |= {f"{k}{p}": v for k, v in tree.arrays().items()}
            arrays |= {f"points{p}": points, f"weight{p}": weight, f"back{p}": back.reshape(-1).astype(np.int32)}
        np.savez_compressed(sink := io.BytesIO(), **arrays)
        one = pa.array([0, table.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, table.column("vec_id").combine_chunks()),
             pa.ListArray.from_arrays(one, table.column("label").combine_chunks()),
             pa.array([sink.getvalue()], pa.binary())], names=["ids", "labels", "trees"])

    def run(batches):
        have, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK - size)
                have.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == CHUNK:
                    yield chunk(have)
                    have, size = [], 0
        if size:
            yield chunk(have)

    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"ids array<long>, labels array<{kind}>, trees binary")


def _trees(blob: bytes, parts: int):
    """(tree, points, weight, back) of every part of a chunk."""
    with np.load(io.BytesIO(blob)) as a:
        return [(anchors.Tree(**{k: a[f"{k}{p}"] for k in anchors.Tree.FIELDS}),
                 a[f"points{p}"], a[f"weight{p}"], a[f"back{p}"]) for p in range(parts)]


def trained(chunks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts x entries x width) after some rounds of assigning
    every part to its nearest entry and moving the entries to the floor of their
    parts' means; unused entries stay."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        def run(batches, now=books):
            got = np.zeros((parts, entries, width + 1), dtype=np.int64)
            for batch in batches:
                for blob in batch.column("trees"):
                    for p, (tree, points, weight, _) in enumerate(_trees(blob.as_py(), parts)):
                        sums, counts = anchors.owners(tree, points, weight, now[p])
                        got[p, :, :width] += sums
                        got[p, :, width] += counts
            flat = got.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

        got = np.zeros(parts * entries * (width + 1), dtype=np.int64)
        for r in (chunks.select("trees").mapInArrow(run, "at long, n long")
                  .groupBy("at").agg(F.sum("n").alias("n")).collect()):      # at most a codebook's size
            got[r["at"]] = r["n"]
        got = got.reshape(parts, entries, width + 1)
        number = got[:, :, width:]
        books = np.where(number > 0, got[:, :, :width] // np.maximum(number, 1), books)
    return books


def coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector of the chunks."""
    parts = len(books)
    kind = chunks.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i, blob in enumerate(batch.column("trees")):
                codes, error = [], 0
                for p, (tree, points, weight, back) in enumerate(_trees(blob.as_py(), parts)):
                    place = np.zeros(len(points), dtype=np.int64)
                    anchors.owners(tree, points, weight, books[p], place)
                    gap = points - books[p][place]
                    error = error + (gap * gap).sum(axis=1)[back]
                    codes.append(place[back])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values,
                     pa.array(["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]),
                     pa.array(error)], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray, dims: int) -> str:
    """sha256 of the entries' integers by part, entry and position."""
    parts, entries, width = books.shape
    real = [books[p, e, : max(0, min(width, dims - p * width))] for p in range(parts) for e in range(entries)]
    return hashlib.sha256(",".join(str(int(x)) for r in real for x in r).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int]:
    """(codes, codebooks, dims) of the vectors (columns vec_id, label, embedding).

    ``codes``: vec_id, label, code and error of every row whose vector is there
    and finite.  The codebooks start as the parts of the ``entries`` smallest
    vec_ids (NULL last, ties by the vector; fewer rows: fewer entries).
    ``dims`` is the length of the first of those vectors; rows of another length
    are dropped as malformed.  If ``dims`` is no multiple of ``parts``, the last
    parts are shorter.  Repeated rows are rows of their own; other columns are
    not read; an empty table gives an empty result.  Components beyond 65,536 in
    magnitude raise an error.
    """
    rows = usable(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    dims = len(first[0]["v"]) if first else 0
    width = max(-(-dims // parts), 1)
    rows = rows.where(F.size("v") == dims)
    seed = [r["v"] for r in rows.orderBy(*order).limit(entries).collect()]     # a codebook's size
    books = whole(np.array(seed, dtype=float).reshape(len(seed), dims), width, parts).transpose(1, 0, 2)
    if not seed:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, 0
    chunks = stored(chunked(rows, dims, width, parts))
    books = trained(chunks, books, rounds)
    out = stored(coded(chunks, books))
    release(chunks)
    return out, books, dims


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels (NULLs
    together)."""
    sums = codes.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
