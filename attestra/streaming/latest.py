"""Streams of deliveries: latest row per key, deduplication within a watermark, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def deliveries(df: DataFrame, time: str, late: str, on: list[str]) -> DataFrame:
    """Each key once while its deliveries are within ``late`` of the watermark; state older than that is dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(on)


def windowed_counts(df: DataFrame, time: str, late: str, length: str, by: list[str]) -> DataFrame:
    """Rows per window and key; a window is final when the watermark has passed it."""
    return df.withWatermark(time, late).groupBy(F.window(time, length), *by).count()


def latest_rows(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``key, time, value, deliveries`` after every batch in which a key had a later delivery than before (update mode)."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"{key} {kind[key]}, {time} timestamp, {value} {kind[value]}, deliveries bigint"

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held, n = state.get if state.exists else (None, None, 0)
        before = at
        for pdf in batches:
            n += len(pdf)
            row = pdf.sort_values([time, value]).iloc[-1]
            if at is None or row[time].value > at:
                at, held = row[time].value, row[value]
        state.update((at, held, n))
        if at != before:
            yield pd.DataFrame({key: [k[0]], time: [pd.Timestamp(at)], value: [held], "deliveries": [n]})

    return df.select(key, time, value).groupBy(key).applyInPandasWithState(step, schema, f"at bigint, held {kind[value]}, n bigint", "update", "NoTimeout")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now into Parquet, once each however often it is restarted from its checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
