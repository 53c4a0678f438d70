"""Watching a folder for files: each new file is parsed once, also over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from argentum.sources import tagfiles

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*", at_once: int = 64) -> DataFrame:
    """A stream of files; at_once bounds what a micro-batch reads."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Writes the tags of all files that are there and not yet ingested to a Parquet table, then ends."""
    found = tagfiles.tags(watch(spark, folder, pattern))
    return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
