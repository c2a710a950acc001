from pyspark.sql import functions as F

from vertebra.sources.session import GraphSession
from vertebra.streaming import feed


def test_edges_arrive(spark, tmp_path):
    s = GraphSession(spark, str(tmp_path / "g"))
    g = s.ddl("create_graph", "g")
    s.insert_vertices(g, 1, spark.range(5).select(F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("properties")))
    ddl = "start_label int, start_id long, end_label int, end_id long, properties string"
    spark.createDataFrame([(1, 1, 1, 2, "{}"), (1, 2, 1, 3, "{}")], ddl).write.parquet(str(tmp_path / "in/a"))
    source = spark.readStream.schema(ddl).parquet(str(tmp_path / "in/*"))
    for _ in range(2):
        feed.ingest_edges(source, s, g, 1, str(tmp_path / "cp")).awaitTermination()
    assert s.table("edges", g).count() == 2 and s.adjacency(g, 1).count() == 4


def test_windows(spark, sf_dir):
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = feed.windowed_counts(source, "ts", "event_type", "1 hour", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count()
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0] and spark.table("w").count() == batch.count()
