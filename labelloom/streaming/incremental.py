"""Incremental twins of cleaning, topic terms and labelling.

A batch of arriving files is one micro-batch. Which keys have been seen is state of the stream, kept by key in a
RocksDB store: a batch looks up its own keys and never reads the target, however large that has become. New rows are
processed and written to a folder of their own. A repeated micro-batch starts from the same state and overwrites its
folder, and the checkpoint is the restart point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream over the parquet files of a folder, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_target(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The accumulated table of an incremental job."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType(list(schema) + [T.StructField("batch", T.LongType())])).parquet(target)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_unseen(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The first row, by ``order``, of every key in the micro-batch that brings the key for the first time.

    Null orders come last and null is a key of its own. The rows of a key are looked at in chunks, so a key with very
    many rows in a batch needs no more memory than its first row.
    """
    names = stream.columns

    def first(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if not state.exists and len(frame):
                top = frame.sort_values(order, kind="stable", na_position="last").head(1)
                best = top if best is None else pd.concat([best, top]).sort_values(order, kind="stable", na_position="last").head(1)
        if best is not None:
            state.update((True,))
            yield best[names]

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def run_incremental(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    order: str,
    process: Callable[[DataFrame], DataFrame],
    out_schema: T.StructType,
) -> None:
    """Process all files that have arrived, then stop; a later call resumes.

    ``process`` maps new rows to result rows. Within a micro-batch the first row per key counts, and a key of an
    earlier batch wins. The number of shuffle partitions at the first call is the number of state partitions for good.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, batch_id: int) -> None:
        process(rows).select(*out_schema.names).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        new = first_unseen(stream, key, order)
        query = new.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def run_scoring(stream: DataFrame, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame]) -> None:
    """Append the scored rows of a stateless job to a parquet table, exactly once."""
    query = (
        score(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
