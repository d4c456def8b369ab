"""Golden cases of places in documents."""

from pyspark.sql import functions as F

from quern.operators import locations as L


def test_merge_contents(spark):
    rows = [(1, "a", 1, "one two", 0, 7, 0.2), (1, "b", 2, "two three", 4, 13, 0.9), (1, "c", 3, "three", 8, 13, 0.9), (1, "d", 4, "four\n", 20, 25, 0.1), (1, "e", 5, "five", 30, 34, None), (2, "f", 1, "", 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "g int, chunk_id string, ordinal int, content string, offset_start long, offset_end long, score double")
    got = {r.g: (r.content, r.offset_start, r.offset_end, r.chunk_id, r.n) for r in L.merge_contents(df, "g").collect()}
    assert got == {1: ("one two three\n\nfour\nfive", 0, 34, "b", 5), 2: ("", 0, 0, "f", 1)}
    assert L.merge_contents(df.limit(0), "g").count() == 0


def test_same_location_of_missing_fields(spark):
    place = "struct<type:string,heading:string,page:int,slide:int,sheet:string,row_start:int,row_end:int,range:string>"
    rows = [(("page", None, 1, None, None, None, None, None), ("page", "x", 1, 2, None, None, None, None)), (("sheet", None, None, None, "s", 1, None, None), ("sheet", None, None, None, "s", None, 1, None)), (("section",) + (None,) * 7, ("section",) + (None,) * 7), (("other",) + (None,) * 7, ("other",) + (None,) * 7), (None, None)]
    df = spark.createDataFrame(rows, f"a {place}, b {place}")
    assert [r[0] for r in df.select(L.same_location(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_settled(spark):
    df = spark.createDataFrame([(100, 50, 20.9), (10, 50, 0.0), (10, 5, -3.0)], "used long, reserved long, actual double")
    assert [r[0] for r in df.select(L.settled(F.col("used"), F.col("reserved"), F.col("actual"))).collect()] == [70, 0, 5]
