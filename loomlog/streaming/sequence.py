"""Deterministic sequence numbers of a stream's events by session, with state that stays small: a key and a number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTPUT = "session_uid string, position long, event_uid string, seq long, late boolean"
STATE = "position long, event_uid string, seq long"


def _number(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Rows after the last one numbered continue its count. A row that sorts before it is late: it gets no number and is
    flagged, and its session is to be numbered anew from the table (renumbered)."""
    position, event, seq = state.get if state.exists else (-1, "", 0)
    rows = pd.concat(list(frames)).sort_values(["position", "event_uid"], kind="stable")
    late = [(p, e) <= (position, event) for p, e in zip(rows["position"], rows["event_uid"], strict=True)]
    rows = rows.assign(late=late, seq=None)
    fresh = ~rows["late"]
    rows.loc[fresh, "seq"] = range(seq + 1, seq + 1 + int(fresh.sum()))
    if fresh.any():
        last = rows[fresh].iloc[-1]
        state.update((int(last["position"]), str(last["event_uid"]), seq + int(fresh.sum())))
    rows["seq"] = rows["seq"].astype("Int64")
    yield rows.assign(session_uid=key[0])[["session_uid", "position", "event_uid", "seq", "late"]]


def sequenced(stream: DataFrame) -> DataFrame:
    """stream (session_uid, position, event_uid) with seq and late, as it comes."""
    given = stream.select("session_uid", "position", "event_uid")
    return given.groupBy("session_uid").applyInPandasWithState(_number, OUTPUT, STATE, "append", "NoTimeout")


def renumbered(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """seq of all events of the given sessions, from their physical order."""
    own = events.join(sessions.select("session_uid").distinct(), "session_uid", "left_semi")
    return own.withColumn("seq", F.row_number().over(Window.partitionBy("session_uid").orderBy("position", "event_uid")).cast("long"))
