"""Streaming upsert of bars: each micro-batch replaces the folders of its keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.ingest import upsert
from barloom.sources.bars import exists

#: Folders of a table; a batch reads and writes those that its first key falls into.
FOLDERS = 64


def stream_upserts(stream: DataFrame, root: str, checkpoint: str, keys: tuple[str, ...] = ("symbol", "timestamp"), after: Callable[[DataFrame, int], None] | None = None, once: bool = True, folders: int = FOLDERS) -> StreamingQuery:
    """Merge a stream of bars into the table at ``root``.

    The table is laid out by a hash of the first key.  A batch merges with the rows of its
    own folders and replaces these, so its cost follows the batch and not the table; a
    batch that is repeated after a failure merges into the same rows again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = batch.withColumn("folder", F.pmod(F.xxhash64(keys[0]), F.lit(folders)).cast("int")).persist()
        touched = [r.folder for r in new.select("folder").distinct().collect()]
        old = spark.read.parquet(root).where(F.col("folder").isin(touched)).select(new.columns) if exists(spark, root) else new.limit(0)
        merged = upsert(old, new, (keys[0], *keys[1:]))
        if touched:
            merged.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(root)
        new.unpersist()
        if after:
            after(spark.read.parquet(root).drop("folder"), number)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
