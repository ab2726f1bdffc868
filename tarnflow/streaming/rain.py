"""Structured Streaming: rates in windows, storms as sessions, soil state by cell."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_depths(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Depth by gauge and tumbling window of a stream (ts, gauge_id, depth_mm); later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("gauge_id", F.window("ts", length).alias("w")).agg(F.sum("depth_mm").alias("depth_mm")).select("gauge_id", F.col("w.start").alias("start"), "depth_mm")


def storms(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Storms by gauge: sessions that a dry spell of ``gap`` ends."""
    return events.withWatermark("ts", late).groupBy("gauge_id", F.session_window("ts", gap).alias("w")).agg(F.sum("depth_mm").alias("depth_mm"), F.count(F.lit(1)).alias("n")).select("gauge_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "depth_mm", "n")


def infiltration(events: DataFrame, ksat: float, psi: float, dtheta: float) -> DataFrame:
    """Cumulative infiltration of each cell over a stream (id, t, rate, dt): Green-Ampt with the cell's state kept between batches."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        out = []
        for rows in batches:
            for t, rate, dt in rows.sort_values("t")[["t", "rate", "dt"]].itertuples(index=False):
                total += min(rate, ksat * (1 + psi * dtheta / max(total, 1e-9))) * dt
                out.append((key[0], t, total))
        state.update((total,))
        yield pd.DataFrame(out, columns=["id", "t", "infiltrated"])

    return events.groupBy("id").applyInPandasWithState(advance, "id bigint, t double, infiltrated double", "total double", "append", GroupStateTimeout.NoTimeout)
