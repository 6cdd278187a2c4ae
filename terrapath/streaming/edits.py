"""Streaming replay of an edit log with a bounded undo stack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrapath import config as C

REPLAYED = "resort_id bigint, op_seq bigint, undoes bigint, is_error boolean"


def replay_stream(log: DataFrame, depth: int = C.UNDO_DEPTH) -> DataFrame:
    """Per edit the operation it undoes; the state of a resort is its stack of at most 50 numbers.

    ``log``: resort_id, op_seq, op; edits of a resort arrive in order across micro-batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        out = []
        for e in pd.concat(list(frames)).sort_values("op_seq").itertuples(index=False):
            undoes = None
            if e.op == "UNDO":
                undoes = stack.pop() if stack else None
            else:
                stack = [*stack, int(e.op_seq)][-depth:]
            out.append((key[0], e.op_seq, undoes, e.op == "UNDO" and undoes is None))
        state.update((stack,))
        frame = pd.DataFrame(out, columns=["resort_id", "op_seq", "undoes", "is_error"])
        yield frame.astype({"undoes": "Int64"})

    return log.groupBy("resort_id").applyInPandasWithState(
        step, REPLAYED, "stack array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
