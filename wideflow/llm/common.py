"""Helpers shared by the operators: column picking, scratch tables, word hashes."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideflow.session import materialize

#: A word is a run of characters that are neither space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def position(df: DataFrame, name: str) -> int | None:
    """Index of the column called ``name``: the exact spelling first, then any case."""
    for i, c in enumerate(df.columns):
        if c == name:
            return i
    for i, c in enumerate(df.columns):
        if c.lower() == name.lower():
            return i
    return None


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names``, found by position, so extra columns whose
    names differ only in case, or repeat, never make a reference ambiguous.
    ``doc_id`` is read as long, ``text``/``lang``/``source`` as string; a
    missing column is NULL."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    out = []
    for n in names:
        i = position(df, n)
        c = F.lit(None) if i is None else F.col(f"_c{i}")
        if n in kinds:
            c = c.cast(kinds[n])
        out.append(c.alias(n))
    return flat.select(*out)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless it is installed
    for them (on PYTHONPATH) already."""
    import wideflow

    root = os.path.dirname(os.path.dirname(os.path.abspath(wideflow.__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_wideflow_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="wideflow-py-"), "wideflow"),
                                  "zip", root, "wideflow")
    sc.addPyFile(archive)
    sc._wideflow_shipped = True


def documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    ship(spark)
    return pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared checkpoint folder and read back."""
    return materialize(df)


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(
        F.regexp_count(text, F.lit(WORD))).cast("long")


def digest(doc_id: Column, text: Column) -> Column:
    """Text by which a row is keyed: its id, and the md5 of its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")),
                       F.coalesce(F.md5(text), F.lit("null")))


def with_key(df: DataFrame, name: str, key) -> DataFrame:
    """``df`` as it is, with one more column ``name`` = key(doc_id, text), even
    where its other names repeat or differ only in case: the frame's own
    columns are renamed to _c0, _c1, ... by position."""
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    at = {n: position(df, n) for n in ("doc_id", "text")}
    cols = [F.lit(None).cast(k) if at[n] is None else F.col(f"_c{at[n]}").cast(k)
            for n, k in (("doc_id", "long"), ("text", "string"))]
    return flat.withColumn(name, key(*cols))


# --- numpy helpers used inside Arrow tasks -----------------------------------

_P = 0x9E3779B97F4A7C15 | 1            # odd, so it has an inverse modulo 2**64
_Q = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done, step = 1, np.uint64(base & (2**64 - 1))
        with np.errstate(over="ignore"):
            while done < size:
                have[done:2 * done] = have[:done] * step
                step = step * step
                done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words in UTF-8 bytes."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([1], white.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from prefix sums of a polynomial hash (no
    Python loop over words; hashes of equal words are equal anywhere)."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    n = len(raw)
    with np.errstate(over="ignore"):
        terms = (raw.astype(np.uint64) + np.uint64(1)) * _power_table(_P, n)
        prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        inverse = _power_table(pow(_P, -1, 2**64), n)
        h = (prefix[end] - prefix[start]) * inverse[start]
        return mix(h + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, repeats included; a shorter non-empty
    sequence is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, dtype=np.uint64)
        q = 1
        for j in range(k):
            out += words[j:n - k + 1 + j] * np.uint64(q)
            q = (q * _Q) % 2**64
        return mix(out + np.uint64(k))


def slices(batch, rows: int) -> Iterator:
    """Parts of an Arrow batch of at most ``rows`` rows, so one Python list of
    texts stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
