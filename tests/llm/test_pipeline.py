from pyspark.sql import functions as F

from wideflow.llm import queries


def test_pipeline_on_a_small_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size, columns = docs.count(), docs.columns
    from wideflow.llm.common import stored

    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf))
        assert docs.columns[:5] == columns and (i == 4 or docs.columns == columns)
        counts.append(docs.count())
    assert counts[0] < size and counts[1] <= counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, sf))
        assert empty.count() == 0


def test_edge_rows_through_all_stages(spark, make_docs, edge_rows, tmp_path):
    """NULL and empty texts, NULL ids, ties, repeated rows, a very long text, and
    columns with the names that stages use themselves."""
    import corpus_pipeline
    from wideflow.llm.common import stored

    clash = {n: F.lit(n) for n in ("size", "shard", "_key", "key", "rid", "_rid", "_c0", "_c1", "_r", "_d", "_new",
                                   "gone", "kept", "node", "times", "_g", "n_words")}
    docs = make_docs(edge_rows, extra=False).withColumns(clash)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(1, 1, 0), (None, 1, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, ids = docs.columns, {r[0] for r in edge_rows}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns[:len(columns)] == columns and (i == 4 or len(docs.columns) == len(columns))
        rows = docs.collect()
        assert rows and {r["doc_id"] for r in rows} <= ids
        assert all(r[n] == n for r in rows for n in clash)
        assert not any(r["text"] in (None, "") for r in rows)       # the classifier accepts no document without text


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
