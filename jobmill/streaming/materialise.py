"""Incremental load of finished runs as a Structured Streaming job."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobmill.sources.raw import classify, stream_objects

def materialise(spark: SparkSession, root: str, checkpoint: str, files_per_trigger: int, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feeds new raw objects in order of arrival, ``files_per_trigger`` at a time, to ``load`` until none is left.

    The checkpoint remembers what was read; ``load`` gets classified objects of
    one micro-batch and its number and must be idempotent by run.
    """
    stream = classify(stream_objects(spark, root, files_per_trigger))
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_objects(path: str) -> Callable[[DataFrame, int], None]:
    """A ``load`` that lands whole objects by batch and name, so that ``plans.backfill`` reads each kind from its own files."""

    def load(objects: DataFrame, batch: int) -> None:
        objects.filter("kind is not null").write.mode("overwrite").partitionBy("name").parquet(f"{path}/batch={batch}")

    return load
