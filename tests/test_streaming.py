"""The stream of changes, driven from files."""

from codequarry.streaming.changes import gate, once_per_content


def test_each_content_once(spark, tmp_path):
    rows = [("a", "1", "java"), ("b", "1", "java"), ("c", "1", "rust"), ("d", "2", "java")]
    made = spark.createDataFrame(rows, "path string, oid string, language string").selectExpr("*", "timestamp'2024-01-01 00:00:00' as ts")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    seen = []
    gate(once_per_content(stream), lambda df, _: seen.extend((r.oid, r.language) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("1", "java"), ("1", "rust"), ("2", "java")]
