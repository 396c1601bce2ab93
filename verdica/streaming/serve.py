"""Streaming service over JSON request files: validation, answers, dead letters, and monitoring by event-time windows.

An extension: the scoring core is batch. Each micro-batch runs the same plan as a batch, so results agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.calibrate import Calibrator
from ..operators.scoring import Backend, lexical_backend
from ..plans import engine

REQUEST = "request_id string, ts timestamp, body string"


def request_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Requests from a folder of JSON files; an id seen within the watermark is answered once."""
    return spark.readStream.schema(REQUEST).json(folder).withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def serve(requests: DataFrame, answers: str, errors: str, checkpoint: str, backend: Backend = lexical_backend, cal: Calibrator | None = None) -> StreamingQuery:
    """Writes answers and dead letters. A batch repeated after a failure overwrites its own part, so rows don't repeat."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = engine.answer(batch.select("request_id", "body"), backend, cal)
        good.write.mode("overwrite").parquet(f"{answers}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        batch.unpersist()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_measures(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts", value: str = "value", by: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and maximum of a latency by tumbling or sliding windows. Time columns without zone are taken as UTC."""
    stream = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stream = stream.withWatermark(ts, late) if stream.isStreaming else stream
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(w.alias("w"), *(by or [])).agg(*_stats(value)).select(F.col("w.start").alias("start"), *(by or []), "n", "mean", "most")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """The same by sessions of a key."""
    stream = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stream = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(*_stats(value)).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean", "most")


def _stats(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")]
