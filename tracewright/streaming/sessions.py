"""Structured Streaming forms of the ordered operators.

The batch operators see whole sessions; these keep the little state that a session needs
between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts", item: str = "event_type") -> DataFrame:
    """Session windows by key: events and distinct items; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct(item).alias("n_items"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_items")


def error_fixes(events: DataFrame, session: str = "session") -> DataFrame:
    """(session, err, fix, ord) as calls arrive; columns session, ord, kind ('use' or 'err'), item.

    State is the tool of the last unanswered error, for sessions that have one; a call removes it.
    """

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = state.get[0] if state.exists else None
        rows = []
        for frame in frames:
            for place, kind, item in frame.sort_values("ord")[["ord", "kind", "item"]].itertuples(index=False):
                if kind == "err":
                    failed = item
                elif failed is not None:
                    rows.append((key[0], failed, item, place))
                    failed = None
        if failed is None:
            if state.exists:
                state.remove()
        else:
            state.update((failed,))
        yield pd.DataFrame(rows, columns=["session", "err", "fix", "ord"])

    kind = events.schema[session].dataType.simpleString()
    return events.groupBy(session).applyInPandasWithState(pair, f"session {kind}, err string, fix string, ord bigint", "failed string", "append", GroupStateTimeout.NoTimeout)
