"""Sessions of conversations, on a stream with state and timers, and on a table.

A session is the turns of an id without a pause of more than ``seconds``; a row whose role is ``reset`` ends it, too.  It is named by the time of its first turn.
The state of an id is three numbers, whatever the length of its sessions, and goes with the session: the timer runs on event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESET = "reset"
COLUMNS = "begun timestamp, turn long, role string, text string, event string"


def _rows(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of no session are ignored: those without an id or a time."""
    return df.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & F.col(at).isNotNull()).select(key, at, "role", "text")


def session_stream(stream: DataFrame, seconds: int, late: int = 0, key: str = "conv_id", at: str = "at") -> DataFrame:
    """key, begun, turn, role, text, event of a stream: each turn with its place (from 0), ``reset`` where a session was ended, ``expired`` where its time ran out.

    Rows later than ``late`` seconds are left out; within a micro-batch rows are taken in order of time, over micro-batches as they come.
    """
    if not stream.isStreaming:
        raise ValueError("not a streaming table")
    kind = stream.schema[key].dataType.simpleString()
    gap = seconds * 1000

    def told(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, turn, last = state.get if state.exists else (0, 0, 0)
        out = []

        def row(event: str, place: int | None, role: str | None = None, text: str | None = None) -> None:
            out.append((own[0], pd.Timestamp(begun, unit="ms"), place, role, text, event))

        if state.hasTimedOut:
            row("expired", turn)
            state.remove()
        else:
            rows = [r for frame in frames for r in zip((frame[at].astype("datetime64[ms]").astype("int64")).tolist(), frame["role"], frame["text"], strict=True)]
            rows.sort(key=lambda r: (r[0], str(r[1]), str(r[2])))
            for now, role, text in rows:
                if turn and now - last > gap:
                    row("expired", turn)
                    turn = 0
                if role == RESET:
                    if turn:
                        row("reset", turn)
                    turn = 0
                    continue
                begun, last = (begun if turn else now), now
                row("turn", turn, role, text)
                turn += 1
            if turn:
                state.update((begun, turn, last))
                state.setTimeoutTimestamp(max(last + gap + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame({c: [r[k] for r in out] for k, c in enumerate((key, "begun", "turn", "role", "text", "event"))})

    rows = _rows(stream, key, at).withWatermark(at, f"{late} seconds")
    return rows.groupBy(key).applyInPandasWithState(told, f"{key} {kind}, {COLUMNS}", "begun long, turn long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_table(df: DataFrame, seconds: int, key: str = "conv_id", at: str = "at") -> DataFrame:
    """key, begun, turn, role, text of a table's turns: what the stream tells of rows that come in order of time."""
    order = Window.partitionBy(key).orderBy(at, "role", "text")
    rows = _rows(df, key, at)
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    reset = F.coalesce(F.col("role") == RESET, F.lit(False))
    before = F.lag(F.when(~reset, ms)).over(order)
    new = (reset | F.coalesce(F.lag(reset).over(order), F.lit(True)) | F.coalesce(ms - before > seconds * 1000, F.lit(False))).cast("int")
    numbered = rows.withColumn("__new", new).withColumn("__session", F.sum("__new").over(order)).where(~reset)
    own = Window.partitionBy(key, "__session").orderBy(at, "role", "text")
    return numbered.select(key, F.first(at).over(own).alias("begun"), (F.row_number().over(own) - 1).cast("long").alias("turn"), "role", "text")
