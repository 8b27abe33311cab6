"""Extension: the stateless policy over a stream of metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.policy import violations

METRIC_SCHEMA = "entity_id string, code string, value double, ts timestamp"


def violations_stream(stream: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Failing metrics of a stream: a stream-static join, no state."""
    return violations(stream, thresholds).filter("not passed")


def failure_counts(stream: DataFrame, thresholds: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failures by code and event-time window; rows later than the watermark are left out."""
    low, high = F.col("min"), F.col("max")
    failing = stream.withWatermark("ts", late).join(thresholds, "code").filter(F.coalesce(F.col("value") < low, F.lit(False)) | F.coalesce(F.col("value") > high, F.lit(False)))
    return failing.groupBy(F.window("ts", window), "code").agg(F.count("*").alias("failures"))


def start(spark: SparkSession, folder: str, thresholds: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that arrive in ``folder`` to violations in ``out``, as much as is there."""
    stream = spark.readStream.schema(METRIC_SCHEMA).parquet(folder)
    return violations_stream(stream, thresholds).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
