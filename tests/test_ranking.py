from pyspark.sql import functions as F

from pixelframe.operators import ranking


def test_rows_of_a_null_key_are_numbered(spark):
    rows = [(None, 5), (None, 3), (1, 2), (1, 9), (2, 4)]
    df = spark.createDataFrame(rows, "k int, v int")
    want = {(None, 3): 1, (None, 5): 2, (1, 2): 1, (1, 9): 2, (2, 4): 1}
    for got in (ranking.ordinal(df, ["k"], ["v"], "n"), ranking.chunked_ordinal(df, ["k"], "v", "n", 4)):
        assert got.columns == ["k", "v", "n"] and {(r.k, r.v): r.n for r in got.collect()} == want
    counted = ranking.running_count(df, ["k"], "v", F.lit(True), "n", 4)
    assert {(r.k, r.v): r.n for r in counted.collect()} == want
