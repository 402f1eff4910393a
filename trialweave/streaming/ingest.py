"""Archives as a stream: every file once, in micro-batches, whatever fails in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialweave.sources import archives


def stream_files(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files: int = 64) -> DataFrame:
    """New files of a folder; `files` bounds a micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").load(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, kind: str = "json") -> None:
    """All files that have come since the last call, filtered and partitioned. The checkpoint makes each count once:
    a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        out = archives.filtered(archives.typed(batch)).withColumn("batch", F.lit(number))
        archives.write_partitions(out, target, ("batch", "content_type", "bucket"))

    stream = stream_files(spark, source, archives.RAW, kind)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records by window and key, late ones up to a bound."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"))


def unseen(stream: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """The first record of each key."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
