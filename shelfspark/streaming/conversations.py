"""Conversations as a stream: what each session has said so far, kept as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dialogue import parse
from ..session import staged_dir

_OUT = "session_id string, turn int, n_spans int, last_turn int"
_STATE = "turns array<int>, spans array<string>, last_turn int"


def fold(state: tuple, rows: list[tuple]) -> tuple:
    """The state after some turns: turns seen, distinct spans in order, and the latest turn.

    A turn that has been seen already changes nothing, so repeated and replayed messages are safe; spans of late turns
    are added when they come.
    """
    turns, spans, last = list(state[0]), list(state[1]), state[2]
    for turn, said in sorted(rows, key=lambda r: (r[0], r[1])):
        if turn in turns:
            continue
        turns.append(turn)
        spans.extend(x.lower() for x in said if x.lower() not in spans)
        last = max(last, turn)
    return turns, spans, last


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = [(int(t), list(s)) for pdf in batches for t, s in zip(pdf["turn"], pdf["spans"])]
    old = state.get if state.exists else ([], [], 0)
    new = fold(tuple(old), rows)
    state.update((new[0], new[1], new[2]))
    yield pd.DataFrame({"session_id": [key[0]], "turn": [max(t for t, _ in rows)], "n_spans": [len(new[1])], "last_turn": [new[2]]})


def session_stream(messages: DataFrame) -> DataFrame:
    """A row per session and micro-batch from a stream (session_id, turn, user_message); null keys are left out.

    State holds a session's few turns; it is kept in the state store, not in the worker.
    """
    parsed = parse(messages.where("session_id is not null and turn is not null").selectExpr("session_id", "turn", "trim(coalesce(user_message, '')) AS text"))
    grouped = parsed.select("session_id", "turn", "spans").groupBy("session_id")
    return grouped.applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(messages: DataFrame, name: str = "sessions") -> DataFrame:
    """Run the stream over all messages there are, and the rows it gave, read back from the shared folder.

    Progress and state are kept in the shared folder, too, so a restarted run goes on where it stopped.
    """
    spark = messages.sparkSession
    base = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = session_stream(messages)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{base}/rows")

    append(spark.createDataFrame([], rows.schema), -1)  # no messages give no rows, but a table
    query = rows.writeStream.outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")
