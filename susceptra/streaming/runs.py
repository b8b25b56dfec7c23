"""What the stateful streams share: state in RocksDB, and runs over what has arrived."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Timers on processing time always ask for one more micro-batch, so a run that is to end takes none without data.
_ENDING = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def state_in_rocksdb(spark: SparkSession, **more: str) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, off the heap; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB | more}
    try:
        for k, v in (_ROCKSDB | more).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files below path, the oldest first, so many a micro-batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(path)


def take_available(stream: DataFrame, checkpoint: str, path: str | None = None, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run over all that has arrived since the checkpoint, into Parquet at path or through `each`, then end.

    A later call with the same checkpoint goes on where this one, or one that was killed, stopped.
    """
    with state_in_rocksdb(stream.sparkSession, **_ENDING):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer = writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", path)
        started = writer.start()
    started.awaitTermination()
