"""Incremental ingestion as Structured Streaming: new records once, snapshots per run, windows on event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: str | StructType, form: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder; what was read is in the checkpoint, so a restart resumes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def unseen(stream: DataFrame, key: list[str], time_col: str, late: str = "7 days") -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(key)


def snapshots(stream: DataFrame) -> DataFrame:
    """Best rank and score of each post in each run."""
    return stream.groupBy("post_id", "run_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.min("observed").alias("observed"))


def sliding(stream: DataFrame, time_col: str, by: list[str], value: str, width: str = "30 days", step: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts and means per sliding window. Windows are aligned to the epoch, unlike the batch operator's."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width, step), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Process what is there, then stop; files are committed exactly once."""
    return df.writeStream.outputMode(mode).format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch into a folder of its number, so that a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key among the batches written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Call ``write(batch, number)``; a batch that is repeated has the same number, so that writing can be idempotent."""
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
