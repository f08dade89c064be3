"""Daily traffic as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schemas import EVENTS
from vellum.sources import tables


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events.parquet as they appear; time as a zoned timestamp, as watermarks need it."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def traffic_daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Traffic by tumbling days; events later than late are dropped in append and update mode."""
    return (
        tables.traffic(events)
        .withWatermark("time", late)
        .groupBy(F.window("time", "1 day").alias("w"))
        .agg(F.count("*").alias("n"), F.sum("incoming").alias("incoming_mb"), F.sum("outgoing").alias("outgoing_mb"))
        .select(F.col("w.start").cast("date").alias("day"), "n", "incoming_mb", "outgoing_mb")
    )


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """What is there now, in complete mode, written under path (a folder that all executors share)."""
    query = (
        stream.writeStream.outputMode("complete")
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/state")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/days"))
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/days")
