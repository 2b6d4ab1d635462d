"""Stored tables as streams, run to their end, with results in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; on a cluster without that setting an error, as executors share no other folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-work-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, name: str) -> DataFrame:
    """All that is there, appended to Parquet, as a table."""
    spark = stream.sparkSession
    path = folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last state of each key of a stream in update mode, windows that are still open included.

    Every batch is written to a folder of its own, which a repeated batch overwrites; the last one that has a key counts.
    """
    spark = stream.sparkSession
    path = folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    found = spark.read.schema(schema).parquet(path)
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return found.groupBy(*keys).agg(F.max_by(values, "batch").alias("_last")).select(*keys, "_last.*").select(stream.columns)
