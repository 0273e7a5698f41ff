"""Incremental processing: each new item is processed once and its result appended.

Which keys have been seen is keyed state of the stream, kept in a state store beside the checkpoint and partitioned by key. A
batch looks up and adds its own keys alone, so its cost doesn't grow with what was processed before, and what was
appended is never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A store whose state lies on disk, so that it isn't held in memory whole; changes alone are saved for each batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def process_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str = "id", within: tuple[str, str] | None = None) -> None:
    """Process Parquet files that came into ``source`` since the last call, and append to ``target``.

    The checkpoint remembers files and keys, so late files are found and items whose key came before, in any batch or twice in
    one, are left out. Without ``within`` keys are kept for ever; with it, a time column and a span such as ``7 days``, a
    key is forgotten once items are so much newer than its own, which bounds the state, and an item that is older than the
    newest one by more than the span may be left out. Each micro-batch writes to a folder of its own number, so one that is
    run again after a failure, from the state before it, replaces what it wrote.
    """

    def append(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    fresh = stream.dropDuplicates([key]) if within is None else stream.withWatermark(*within).dropDuplicatesWithinWatermark([key])
    with _settings(spark, STORE):
        query = fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def written(spark: SparkSession, target: str) -> DataFrame | None:
    """What has been appended so far, none if nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*")
