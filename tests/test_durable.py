from pixelframe import durable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_written_tables_are_not_broadcast(spark):
    ids = spark.range(durable.SPREAD_ROWS + 1)
    small, large = durable.durable(ids.limit(10)), durable.durable(ids)
    assert "BroadcastHashJoin" in plan(small.join(small.select("id"), "id"))
    assert "BroadcastHashJoin" not in plan(large.join(large.select("id"), "id"))
    counted, odd = durable.durable_counted(ids, durable.F.col("id") % 2 == 1)
    assert odd == durable.SPREAD_ROWS // 2
    both = counted.union(counted).groupBy("id").count()
    assert "BroadcastHashJoin" not in plan(spark.range(5).join(durable.spread(both, odd * 4), "id"))
