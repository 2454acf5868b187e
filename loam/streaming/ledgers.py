"""Event-driven parts: the latest status of each source, and ledgers that take every receipt once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The files of an event table, one file or a folder of them, with event time in ``at``."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet").withColumn("at", F.col("ts").cast("timestamp"))


def latest_status(events: DataFrame, key: str, status: Column, order: Column) -> DataFrame:
    """The newest status of each key; state holds one struct a key."""
    return events.groupBy(key).agg(F.max_by(F.struct(status.alias("status"), F.col("at")), order).alias("s"), F.count("*").alias("n")).select(key, "s.status", "s.at", "n")


def receipts(events: DataFrame, keys: list[str], lateness: str = "2 hours") -> DataFrame:
    """The first event of each set of keys; the keys must hold the event time so that state can be dropped behind it."""
    return events.withWatermark("at", lateness).dropDuplicates([*keys, "at"])


def windowed(events: DataFrame, key: str, width: str, lateness: str = "2 hours") -> DataFrame:
    """Events of each key per tumbling window, late ones up to ``lateness`` counted."""
    counted = events.withWatermark("at", lateness).groupBy(F.window("at", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def run_once(frame: DataFrame, path: str, mode: str) -> StreamingQuery:
    """Take what there is, write each batch's rows to a folder of its own under ``path``, and stop.

    The checkpoint is beside them, so a later run goes on from there; a batch that is run again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def newest_rows(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Of what run_once() wrote in update mode, the last batch's row of each key."""
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/*")
    whole = F.struct(*[F.col(f.name) for f in schema.fields])
    numbered = rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))
    return numbered.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, "_batch").alias("_row")).select("_row.*")
