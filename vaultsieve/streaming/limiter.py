"""A sliding-window rate limiter with exact keyed state: refused requests are not recorded, so each decision depends on those before."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "client long, event_id long, at double, allowed boolean, remaining int, retry_after int"


def decide(times: list[float], at: float, seconds: float, most: int) -> tuple[bool, int, int]:
    """allowed, remaining, retry_after for a request at `at`; times are those of allowed requests and are brought up to date."""
    times[:] = [t for t in times if t > at - seconds]
    if len(times) >= most:
        return False, 0, max(1, int(times[0] + seconds - at) + 1)
    times.append(at)
    return True, most - len(times), 0


def _decided(rows: pd.DataFrame, held: dict[int, list[float]], seconds: float, most: int) -> pd.DataFrame:
    """Decisions on rows in their order; held has each client's allowed times."""
    made = [(int(c), int(e), float(t), *decide(held.setdefault(int(c), []), float(t), seconds, most)) for c, e, t in zip(rows["client"], rows["event_id"], rows["at"], strict=True)]
    return pd.DataFrame(made, columns=[x.split()[0] for x in OUTPUT.split(", ")])


def limit_stream(events: DataFrame, seconds: float = 60, most: int = 100, late: float = 3600) -> DataFrame:
    """events (client, event_id, at: seconds) of a stream, with the decision on each.

    State is the at most `most` allowed times of a client, and goes when the stream's time is `seconds` past the
    client's last event. That time is the latest event's, less `late` seconds; events before it get no decision.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {int(key[0]): list(state.get[0]) if state.exists else []}
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        yield _decided(rows, held, seconds, most)
        state.update((held[int(key[0])],))
        state.setTimeoutTimestamp(max(int((rows["at"].max() + late + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    # Shifted by what the watermark holds back, so that times near zero are not taken for late ones.
    timed = events.withColumn("event_time", F.timestamp_seconds(F.col("at") + late)).withWatermark("event_time", f"{late} seconds")
    return timed.groupBy("client").applyInPandasWithState(step, OUTPUT, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def limit(events: DataFrame, seconds: float = 60, most: int = 100) -> DataFrame:
    """The same decisions on a table. Each depends on the one before, so a client's events are one sequence in one task;
    they are sorted there by Spark and pass batch by batch, and only the client's allowed times are kept."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[float]] = {}
        for rows in frames:
            if len(rows):
                yield _decided(rows, held, seconds, most)
                last = int(rows["client"].iat[-1])
                held = {last: held[last]}

    ordered = events.select("client", "event_id", "at").repartition("client").sortWithinPartitions("client", "at", "event_id")
    return ordered.mapInPandas(whole, OUTPUT)
