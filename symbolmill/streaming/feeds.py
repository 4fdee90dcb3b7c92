"""Structured Streaming forms: change feeds, fresh references, late orphans (S16, problem 2 as a stream).

Change feeds keep one row per key for good, deleted keys included (a tombstone that was dropped would let a
late, older change bring its row back); windowed counts and de-duplication are bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, folder: str, table: str, schema: str, max_files: int = 64) -> DataFrame:
    """A stream over the Parquet files of a table as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files)).parquet(f"{folder}/{table}.parquet")


def unique_deliveries(rows: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """Each id once, deliveries arriving within ``delay`` of each other; the watermark bounds the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def references_per_window(references: DataFrame, delay: str = "30 days", window: str = "7 days") -> DataFrame:
    """Counts of references per kind and window of their recording, late rows included up to ``delay``."""
    rows = references.withWatermark("recorded_at", delay)
    return rows.groupBy(F.window("recorded_at", window).alias("w"), "reference_kind").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "reference_kind", "n"
    )


def latest_changes(changes: DataFrame) -> DataFrame:
    """The fold of ``latest_state`` as a stream over (key string, seq long, op string, payload string).

    Emits a row whenever the state of a key changes; a change older than the one in
    state has no effect, and a delete stays in state as a tombstone.
    """

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = before = state.get if state.exists else None
        for pdf in frames:
            for row in zip(pdf.seq, pdf.op, pdf.payload, strict=True):
                new = (int(row[0]), row[1], row[2])
                if best is None or (new[0], new[1], new[2] or "") > (best[0], best[1], best[2] or ""):
                    best = new
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "payload": [best[2]]})

    schema = "key string, seq long, op string, payload string"
    return changes.groupBy("key").applyInPandasWithState(fold, schema, "seq long, op string, payload string", "update", GroupStateTimeout.NoTimeout)


def merge_into(folder: str, keys: list[str], order: str):  # noqa: ANN201
    """A ``foreachBatch`` sink that merges each batch into a Parquet table by key, the greatest ``order`` winning.

    The table is versioned by batch (``folder/<batch>``), so a batch that is run again
    after a failure writes the same version anew and readers never see half of one.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number > 0:
            batch = spark.read.parquet(f"{folder}/{number - 1}").unionByName(batch)
        others = [c for c in batch.columns if c not in keys and c != order]
        last = batch.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("r"))
        last.select(*keys, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/{number}")

    return sink
