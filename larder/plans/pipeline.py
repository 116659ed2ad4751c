"""Ordered, named stages from table to table, with sessions and events."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]
EVENTS = ("query_received", "stage_started", "stage_finished", "stage_failed", "query_answered", "dataset_loaded", "dataset_built", "tenant_switched", "session_reset")


class Events:
    """Listeners by event name; an error in a listener is counted and goes no further."""

    def __init__(self) -> None:
        self._held: dict[str, list[Callable]] = defaultdict(list)
        self.counts: dict[str, int] = defaultdict(int)
        self.errors = 0

    def on(self, name: str, listener: Callable) -> None:
        if name not in EVENTS:
            raise ValueError(f"unknown event {name!r}")
        self._held[name].append(listener)

    def emit(self, name: str, **facts) -> None:
        self.counts[name] += 1
        for listener in self._held[name]:
            try:
                listener(**facts)
            except Exception:  # noqa: BLE001
                self.errors += 1


class Pipeline:
    """Stages in order. A stage that fails to plan is recorded and the next one gets the last good table."""

    def __init__(self, events: Events | None = None):
        self._stages: list[tuple[str, Stage]] = []
        self.events = events or Events()
        self.failures: dict[str, str] = {}

    def register(self, name: str, stage: Stage, position: int | None = None) -> None:
        if name in self.names():
            raise ValueError(f"stage {name!r} is there already")
        self._stages.insert(len(self._stages) if position is None else position, (name, stage))

    def remove(self, name: str) -> None:
        self._stages = [s for s in self._stages if s[0] != name]

    def replace(self, name: str, stage: Stage) -> None:
        if name not in self.names():
            raise ValueError(f"no stage {name!r}")
        self._stages = [(n, stage if n == name else s) for n, s in self._stages]

    def names(self) -> list[str]:
        return [n for n, _ in self._stages]

    def run(self, df: DataFrame) -> DataFrame:
        self.failures = {}
        for name, stage in self._stages:
            self.events.emit("stage_started", stage=name)
            try:
                df = df.transform(stage)
                df.schema  # a plan that can't be resolved fails here
                self.events.emit("stage_finished", stage=name)
            except Exception as e:  # noqa: BLE001
                self.failures[name] = str(e)
                self.events.emit("stage_failed", stage=name, error=str(e))
        return df


class Sessions:
    """Turns by session; an empty id is ignored. What must outlast the driver is a table: see operators.prompts.history."""

    def __init__(self) -> None:
        self._held: dict[str, list[tuple[str, str]]] = defaultdict(list)

    def append(self, session: str, role: str, text: str) -> None:
        if session:
            self._held[session].append((role, text))

    def turns(self, session: str) -> list[tuple[str, str]]:
        return list(self._held.get(session, ()))

    def reset(self, session: str) -> None:
        self._held.pop(session, None)

    def as_table(self, spark) -> DataFrame:
        rows = [(s, i, r, t) for s, turns in self._held.items() for i, (r, t) in enumerate(turns)]
        return spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
