import os
import tempfile
from datetime import date

from pyspark.sql import types as T

from wideflow.sources import io

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()),
                       T.StructField("d", T.DateType()), T.StructField("s", T.StringType())])


def read(spark, text):
    folder = tempfile.mkdtemp(prefix="csv-")
    with open(os.path.join(folder, "t.csv"), "w") as f:
        f.write(text)
    return io.read_typed(spark, folder, SCHEMA)


def test_cells_by_type(spark):
    got = read(spark, "a,b,d,s\n1,2.5,2024-02-29,x\n2.5,abc,2024-02-30,NA\n,NaN,,\n 7 ,inf,2024-01-01,\"q,\"\"r\"\n")
    rows = [tuple(r)[:4] for r in got.orderBy("a").collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [
        (1, 2.5, date(2024, 2, 29), "x"), (None, None, None, None), (None, None, None, None),
        (7, None, date(2024, 1, 1), 'q,"r')]))
    bad = {(r["column"], r["value"]): r["n"] for r in io.bad_cells(got).collect()}
    # an infinite number is not a usable one
    assert bad == {("a", "2.5"): 1, ("b", "abc"): 1, ("d", "2024-02-30"): 1, ("b", "inf"): 1}


def test_lines_with_too_few_or_too_many_cells(spark):
    got = read(spark, "a,b,d,s\n1,2\n2,1.5,2024-01-01,x,extra\n3,1.0,2024-01-01,ok\n")
    assert got.count() == 3 and {r["a"] for r in got.collect()} == {1, 2, 3}
    assert {r["value"] for r in io.bad_cells(got).where("column = '_line'").collect()} == {
        "1,2", "2,1.5,2024-01-01,x,extra"}


def test_empty_file_and_other_missing_marks(spark):
    assert read(spark, "a,b,d,s\n").count() == 0
    folder = tempfile.mkdtemp(prefix="csv-")
    with open(os.path.join(folder, "t.csv"), "w") as f:
        f.write("a,b,d,s\n-99,1,,-99\n")
    row = io.read_typed(spark, folder, SCHEMA, missing=["-99"]).first()
    assert row["a"] is None and row["s"] is None and row["_bad"] == []


def test_a_rerun_replaces_its_own_slices(spark):
    path = tempfile.mkdtemp(prefix="sinks-") + "/t"
    make = lambda rows: spark.createDataFrame(rows, "x double, variant string, seed int, split_ratio double")
    io.write_slices(make([(1.0, "none", 1, 0.1), (2.0, "none", 1, 0.2), (3.0, "mode", 1, 0.1)]), path)
    io.write_slices(make([(20.0, "none", 1, 0.2), (21.0, "none", 1, 0.2), (4.0, "mean", 7, 0.125)]), path)
    io.write_slices(make([(20.0, "none", 1, 0.2), (21.0, "none", 1, 0.2)]), path)
    back = io.read_slices(spark, path, make([]).schema)
    assert sorted(tuple(r) for r in back.collect()) == [
        (1.0, "none", 1, 0.1), (3.0, "mode", 1, 0.1), (4.0, "mean", 7, 0.125), (20.0, "none", 1, 0.2),
        (21.0, "none", 1, 0.2)]
    io.write_slices(make([]), path)                        # an empty run replaces nothing
    assert back.count() == 5
