"""Incremental ingest: file source, first-wins dedupe by keys kept in the stream's state, resume by checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: Column, order: list[str], files_per_batch: int = 100) -> None:
    """Reads all new Parquet files of `source` and adds the rows whose key came in no earlier batch to `target`.

    Of a batch's rows of one new key the first by `order` counts. The keys are the stream's state, one flag each, so no
    batch reads what others have written; with very many keys the session should keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass). A batch is written to a folder of its own, `batch=<id>`, which a
    repeated run of it overwrites: a run that was stopped goes on where its checkpoint says and adds nothing twice.
    Rows with a null key are one key.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    columns = stream.columns

    def fresh(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            if not state.exists:
                best = (part if best is None else pd.concat([best, part])).sort_values(order, kind="stable").head(1)
        if best is not None:
            state.update((True,))
            yield best[columns]

    kept = stream.withColumn("ingest_key", key.cast("string")).groupBy("ingest_key").applyInPandasWithState(fresh, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> Any:
        batch.withColumn("ingest_key", F.xxhash64(key)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    kept.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by event-time window and keys, with a watermark for late rows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n"))
