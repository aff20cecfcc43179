"""Streams from and to tables: a folder of Parquet read file by file, and a sink that can be read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sonoplan-')}"
    return found.rstrip("/")


def _literal(path: str) -> str:
    """A pattern (a single file can be read as a stream only through one) that matches the path alone."""
    head, last = path[:-1], path[-1]
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", head) + f"[{last}]"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """path: a table's file or folder; of a file, the letters that a pattern would read as wild cards are taken as they are."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_literal(path))


def run(stream: DataFrame) -> DataFrame:
    """Everything that is there now, written by an exactly-once sink and read back."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
