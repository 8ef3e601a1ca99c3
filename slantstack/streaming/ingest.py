"""New pairs only: a file stream or an anti-join to what is there, written once each.

A run takes what has arrived (availableNow) and stops; its checkpoint remembers the files. Each batch replaces the
partitions of its pairs, so a batch that is run again leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(wanted: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``wanted`` that aren't in ``done``."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Parquet files that arrived in ``source`` since the last run to ``target``, partitioned by pair (column name). Returns rows written."""
    written = []

    def put(batch: DataFrame, _: int) -> None:
        out = clean(batch)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(target)
        written.append(out.count())

    query = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(written)


def without_zero(df: DataFrame) -> DataFrame:
    """Phases of 0 are no data."""
    return df.withColumn("v", F.nullif(F.nanvl("v", F.lit(0.0)), F.lit(0.0)))
