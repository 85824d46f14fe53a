"""A stream of edges that run time and source do not agree on, with state and a timer for each observed edge.

An observed edge keeps its count, and when it was first and last seen. It is told when it is first seen, and when it has been
silent for so long in event time that its timer goes off; its state then goes, so the state holds the edges of the last
`silence` alone, whatever the stream has seen. Observations later than the watermark are not counted. Each told edge is joined with
the edges that the source declares: one that is seen but not declared is observed only, and one that is declared and has fallen
silent is unobserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latticework.sources.folders import workers_find_us
from latticework.streaming import counters

EDGE = ["service_id", "from_symbol", "to_symbol", "kind"]
_EDGE = "service_id long, from_symbol string, to_symbol string, kind string"


def seconds(interval: str) -> int:
    """An interval such as `90 minutes` in seconds."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def told(observations: DataFrame, silence: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(edge, event, observed_count, first_seen, last_seen): `appeared` and `silent` of every edge, as a stream in append mode.

    observations: (service_id, from_symbol, to_symbol, kind, count, ts), as `counters.parsed` makes them. An edge that is seen
    again after its silence appears anew, with a new count.
    """
    workers_find_us(observations.sparkSession)
    pause = seconds(silence) * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(event: str, count: int, first: int, last: int) -> pd.DataFrame:
            times = [pd.Timestamp(t, unit="us") for t in (first, last)]
            return pd.DataFrame({**{k: [v] for k, v in zip(EDGE, key, strict=True)}, "event": [event], "observed_count": [count], "first_seen": [times[0]], "last_seen": [times[1]]})

        watermark = state.getCurrentWatermarkMs()
        count, first, last = state.get if state.exists else (0, None, None)
        # A timer waits while its edge has rows, be they too late to count.
        if state.exists and (state.hasTimedOut or last // 1000 + pause <= watermark):
            state.remove()
            yield row("silent", count, first, last)
            count, first, last = 0, None, None
        new = first is None
        for batch in () if state.hasTimedOut else batches:
            batch = batch[batch["ts"] >= pd.Timestamp(max(watermark, 0), unit="ms")]
            if len(batch):
                count += int(batch["count"].sum())
                low, high = (int(pd.Timestamp(t).value // 1000) for t in (batch["ts"].min(), batch["ts"].max()))
                first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
        if first is None:
            return
        state.update((count, first, last))
        state.setTimeoutTimestamp(max(last // 1000 + pause, watermark + 1))
        if new:
            yield row("appeared", count, first, last)

    output = f"{_EDGE}, event string, observed_count long, first_seen timestamp, last_seen timestamp"
    stream = observations.filter("ts IS NOT NULL").withWatermark("ts", late).groupBy(*EDGE)
    found = stream.applyInPandasWithState(run, output, "count long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    # Its rows are views into Arrow batches, which an exchange cannot take: the filter makes rows of their own of them.
    return found.filter("event IS NOT NULL")


def diverging(events: DataFrame, declared: DataFrame) -> DataFrame:
    """Events of edges on which both sides differ: `observed_only` if they appear undeclared, `static_unobserved` if declared ones fall silent."""
    known = declared.select(*EDGE).distinct().withColumn("_declared", F.lit(True))
    state = F.when((F.col("event") == "appeared") & F.col("_declared").isNull(), "observed_only").when((F.col("event") == "silent") & F.col("_declared"), "static_unobserved")
    return events.join(known, EDGE, "left").withColumn("state", state).filter("state IS NOT NULL").drop("_declared")


def live(stream: DataFrame, declared: DataFrame, folder: str, checkpoint: str, silence: str = "1 day", late: str = "10 minutes"):
    """Writes what diverges of a stream of raw observations to a folder; a restart from the checkpoint goes on where it ended."""
    found = diverging(told(counters.parsed(stream), silence, late), declared)
    return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
