"""The operators over streams, run to the end of what is there."""

from pyspark.sql import functions as F

from docloom.streaming import stateless


def run(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for name, fn in (("scored", stateless.scored), ("checked", stateless.checked)):
        got = run(fn(stream), name, spark).collect()
        assert sorted(map(str, got)) == sorted(map(str, fn(docs).collect()))
    kept = run(stateless.distinct(stream, "seen", "10 days"), "kept", spark)
    from docloom.operators import hashing

    assert kept.count() == hashing.content_hash(docs).select("content_hash").distinct().count()
