"""Papers as they arrive: a file stream whose micro-batches go through the batch functions, exactly once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.sources import tables


def stream(spark: SparkSession, folder: str, kind: StructType) -> DataFrame:
    return spark.readStream.schema(kind).parquet(folder)


def ingest(arrivals: DataFrame, transform: Callable[[DataFrame], DataFrame], root: str, table: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends transform(batch) to a keyed table. A batch that is repeated after a failure adds no row twice."""

    def each(batch: DataFrame, _: int) -> None:
        tables.append(transform(batch), root, table)

    return arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
