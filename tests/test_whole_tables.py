import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_every_row_is_in_a_part(spark):
    found = __spark_entry__.queries()
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    parts = found["combine_measurements"](spark, SF)
    assert parts.count() == items.count()
    assert parts.where("t_index IS NULL").count() == items.where("l_returnflag = 'R'").count()


def test_every_order_is_an_image(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    merged = __spark_entry__.queries()["merge_image_tables"](spark, SF)
    assert {r.Image_Number for r in merged.where("FileName IS NOT NULL").collect()} == {r.o_orderkey for r in orders.collect()}
