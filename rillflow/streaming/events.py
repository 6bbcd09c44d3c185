"""Event time: tumbling, sliding and session windows with watermarks, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams forget windows older than ``late`` behind the latest event; tables are as they are."""
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    g = watermarked(df, ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggregates)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    g = watermarked(df, ts, late).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*aggregates)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key end after ``gap`` without an event; at least one key is needed."""
    if not keys:
        raise ValueError("sessions need a key")
    g = watermarked(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, so many per micro-batch: the source's back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Everything there is now, micro-batch by micro-batch, through ``sink(frame, batch)``; the checkpoint makes a restart go on."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
