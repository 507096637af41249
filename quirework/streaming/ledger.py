"""The ledger as a stream: attempts and windows with a watermark, newest row of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.sections import first_rows
from quirework.session import shared_dir


def upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What upsert_stream has written to path: the newest row of each key over all batches, the later batch of equal times."""
    return first_rows(spark.read.parquet(path), [key], [F.desc("at"), F.desc("batch")]).drop("batch")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file, or the files that arrive in a folder, as a stream."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(hadoop).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent()))
    return spark.readStream.schema(schema).parquet(path)


def attempts_by_window(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, strategy, attempts, confidence) by time window; rows later than the watermark are dropped, null times never count."""
    timed = events.filter("at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "strategy").agg(F.count("*").alias("attempts"), F.sum("confidence").alias("confidence")).select(F.col("w.start").alias("start"), "strategy", "attempts", F.round("confidence", 4).alias("confidence"))


def run_once(out: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything there is, processed and put into the in-memory table name."""
    spark = out.sparkSession
    state = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("memory").option("checkpointLocation", state).queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: str):
    """Writes the newest row of each key in each batch of a stream under path (foreachBatch), a folder a batch, so that a batch written twice counts once. upserted() reads one row a key."""

    def write(batch: DataFrame, number: int) -> None:
        first_rows(batch, [key], [F.desc("at")]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
