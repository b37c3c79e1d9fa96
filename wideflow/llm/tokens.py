"""SentencePiece encoding and decoding of whole documents, and exact length histograms."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, position, slices


def model_path(model_file: str | None = None) -> str:
    """The vocabulary file; by default the public 32k merge-type model.  It
    must be readable under this path on every executor."""
    if model_file:
        return model_file
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None,
                     ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, unless ``ids`` is false), n_tokens, ids_sha256,
    decoded, decoded_sha256 for every row, in one pass without a shuffle.

    NULL text counts as empty (no ids).  Repeated rows are repeated; a text of
    any length is encoded whole.  Batches reach Python a few hundred rows at a
    time.
    """
    path = model_path(model_file)

    def run(batches):
        from .piece_bpe import load

        bpe = load(path)
        for batch in batches:
            for part in slices(batch, 256):
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                if ids:
                    out |= {"ids": [], "decoded": []}
                for text in part.column("text").to_pylist():
                    got, joined = bpe.encode_joined(text or "")
                    decoded = bpe.decode(got)
                    out["n_tokens"].append(len(got))
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        out["ids"].append(got)
                        out["decoded"].append(decoded)
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(out["n_tokens"], pa.int64())}
                if ids:
                    cols["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array(out["decoded"], pa.string())
                for c in ("ids_sha256", "decoded_sha256"):
                    cols[c] = pa.array(out[c], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded string, " if ids else "") \
        + "ids_sha256 string, decoded_sha256 string"
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def with_ids(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """The rows of ``docs`` with two more columns: n_tokens, and ids, from which
    the decoder must give back the text that the model's normaliser keeps (a
    mismatch raises).  Columns of these names in ``docs`` are replaced."""
    path = model_path(model_file)
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids")]
    at = [i for i, c in enumerate(docs.columns) if c in keep]
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]).select(*[f"_c{i}" for i in at])
    text = f"_c{position(docs, 'text')}"
    fields = [T.StructField(f.name, f.dataType) for f in flat.schema]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def run(batches):
        from .piece_bpe import MARK, load

        bpe = load(path)
        for batch in batches:
            for part in slices(batch, 256):
                ids = []
                for x in part.column(text).to_pylist():
                    ids.append(bpe.encode(x or ""))
                    if bpe.decode(ids[-1]) != (x or "").replace(MARK, " "):
                        raise ValueError("decoding the ids does not give the text")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(x) for x in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32()))], names=[f.name for f in fields])

    return flat.mapInArrow(run, T.StructType(fields)).toDF(*keep, "n_tokens", "ids")


def decode_ids(rows: DataFrame, model_file: str | None = None) -> DataFrame:
    """``text`` decoded from the column ``ids`` (array<int>) beside ``doc_id``;
    NULL ids give an empty text."""
    path = model_path(model_file)

    def run(batches):
        from .piece_bpe import load

        bpe = load(path)
        for batch in batches:
            for part in slices(batch, 256):
                text = [bpe.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "text": pa.array(text, pa.string())})

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def length_counts(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """source, n_tokens, n_docs: each task counts its documents by encoded
    length before the shuffle.  NULL text has length 0; NULL is a source."""
    path = model_path(model_file)

    def run(batches):
        from .piece_bpe import load

        bpe, seen = load(path), Counter()
        for batch in batches:
            for part in slices(batch, 256):
                for source, text in zip(part.column("source").to_pylist(),
                                        part.column("text").to_pylist(), strict=True):
                    seen[source, bpe.length(text or "")] += 1
            if len(seen) > 200_000:
                yield counted(seen)
                seen.clear()
        if seen:
            yield counted(seen)

    def counted(seen):
        return pa.RecordBatch.from_pydict({
            "source": pa.array([k[0] for k in seen], pa.string()),
            "n_tokens": pa.array([k[1] for k in seen], pa.int64()),
            "n_docs": pa.array(list(seen.values()), pa.int64())})

    return (pick(docs, "source", "text").mapInArrow(run, "source string, n_tokens long, n_docs long")
            .groupBy("source", "n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(counts: DataFrame, group: list[str]) -> DataFrame:
    """Per group and length: n_docs, and over the documents at least as long
    docs_at_least and tokens_at_least; of the whole group total_docs and
    total_tokens; docs_at_most (a quantile is the first length at which it
    reaches its share) and truncated_tokens (the total if every document is cut
    at this length).  The windows run over lengths, not documents."""
    longer = (Window.partitionBy(*group).orderBy(F.desc("n_tokens"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(*group)
    tokens = F.col("n_docs") * F.col("n_tokens")
    t = counts.select(
        *group, "n_tokens", "n_docs",
        F.sum("n_docs").over(longer).alias("docs_at_least"),
        F.sum(tokens).over(longer).alias("tokens_at_least"),
        F.sum("n_docs").over(whole).alias("total_docs"),
        F.sum(tokens).over(whole).alias("total_tokens"))
    return (t.withColumn("docs_at_most", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
            .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least")
                        + F.col("docs_at_least") * F.col("n_tokens")))


def length_histogram(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """The suffix sums of each source (scope 'source') and of all documents
    (scope 'all', source NULL).  An empty table gives no rows."""
    counts = length_counts(docs, model_file)
    both = (counts.select(F.lit("source").alias("scope"), "source", "n_tokens", "n_docs")
            .unionByName(counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
                         .select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("source"),
                                 "n_tokens", "n_docs")))
    return suffix_sums(both, ["scope", "source"])


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: limit, docs_cut (longer than the limit),
    kept_tokens (each document cut at the limit), per scope and source, from
    the histogram alone."""
    t = histogram.select("scope", "source", "n_tokens", "n_docs",
                         F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    return t.groupBy("scope", "source", "limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("kept_tokens"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Per scope and source, the smallest length that at least each share of
    the documents do not exceed."""
    t = histogram.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return (t.where(F.col("docs_at_most") >= F.col("share") * F.col("total_docs"))
            .groupBy("scope", "source", "share").agg(F.min("n_tokens").alias("n_tokens")))
