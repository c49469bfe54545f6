from pyspark.sql import functions as F

from lamina.operators import layers, rows


def test_row_operators_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "A | B; C"), (2, "Unknown"), (3, "D")], "row_id int, F string").write.parquet(source)
    stream = spark.readStream.schema("row_id int, F string").parquet(source)
    long = layers.expand_long(rows.normalise_nulls(stream), ["F"]).filter(F.col("value").isNotNull())
    query = long.writeStream.format("memory").queryName("decoded").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(r["value"] for r in spark.table("decoded").collect())
    assert got == ["A", "B", "C", "D"]
