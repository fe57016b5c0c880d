"""The study state machine over a stream of study events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TARGET = 7


def step(count: int, status: str, action: str) -> tuple[int, str]:
    """One event of one word; the same rules as the batch fold."""
    if action == "known":
        return TARGET, "known"
    if action == "none":
        return 0, "none"
    if action == "learning":
        return (0, "learning") if status == "known" else (count, "learning")
    count = min(TARGET, count + 1)
    return count, "known" if count >= TARGET else "learning"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    from shiori.streaming.study import step as move

    count, status = state.get if state.exists else (0, "none")
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one word of one learner
    for action in rows["action"]:
        count, status = move(int(count), status, action)
    state.update((int(count), status))
    yield pd.DataFrame({"learner": [key[0]], "word_id": [key[1]], "status": [status], "study_count": [int(count)]})


def study_stream(events: DataFrame) -> DataFrame:
    """events (event_id, ts, learner, word_id, action) to the state of each word that changed."""
    return events.groupBy("learner", "word_id").applyInPandasWithState(
        _update, "learner long, word_id int, status string, study_count int", "study_count int, status string", "update", GroupStateTimeout.NoTimeout
    )
