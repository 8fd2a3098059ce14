"""The ledger's status and event counts kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str = "at", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and summed value per type and tumbling window; events later than the watermark are dropped by definition of the window's end."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "value")


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each identity, for update or complete mode; works on streams and on tables."""
    return events.groupBy("identity").agg(F.max(F.struct("event_index", "event_type", "at")).alias("l"), F.count(F.lit(1)).alias("n_events")).select("identity", F.col("l.event_index").alias("event_index"), F.col("l.event_type").alias("event_type"), F.col("l.at").alias("at"), "n_events")


def chain_gaps(events: DataFrame) -> DataFrame:
    """(identity, event_index, expected): events that don't follow the last one seen of their identity, found as they arrive.

    State is one number per identity. Events of a batch are put in order first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        at = np.sort(np.concatenate([b["event_index"].to_numpy(np.int64) for b in batches]))
        expected = np.concatenate([[last], at[:-1]]) + 1
        state.update((int(at[-1]),))
        off = at != expected
        yield pd.DataFrame({"identity": np.repeat(key[0], off.sum()), "event_index": at[off], "expected": expected[off]})

    return events.groupBy("identity").applyInPandasWithState(step, "identity string, event_index long, expected long", "last long", "append", GroupStateTimeout.NoTimeout)
