"""What a conversation remembers, kept as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that state with timers and lifetimes needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Memory(StatefulProcessor):
    """Folds the turns of a conversation in their order, whatever order they come in.

    A turn waits until all before it are there, counted from ``first``; after ``patience_ms`` without a
    turn those that wait are folded anyway, and a turn that comes later still is folded as the last one
    and marked late. What is remembered is forgotten ``lifetime_ms`` after it was last written.
    """

    def __init__(self, remembered: list[str], first: int, patience_ms: int | None, lifetime_ms: int | None) -> None:
        self.remembered, self.first, self.patience_ms, self.lifetime_ms = remembered, first, patience_ms, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = T.StructType([T.StructField(c, T.StringType()) for c in self.remembered])
        self.handle = handle
        self.next = handle.getValueState("next", T.StructType([T.StructField("turn", T.LongType())]))
        self.known = handle.getValueState("known", values, ttlDurationMs=self.lifetime_ms)
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("turn", T.LongType())]), values)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        upcoming = self.next.get()[0] if self.next.exists() else self.first
        for row in sorted(rows, key=lambda r: r["turn"]):
            values = tuple(row[c] for c in self.remembered)
            if row["turn"] < upcoming:
                yield self._folded(key, row["turn"], values, True)
            else:
                self.waiting.updateValue((row["turn"],), values)
        while self.waiting.containsKey((upcoming,)):
            values = tuple(self.waiting.getValue((upcoming,)))
            self.waiting.removeKey((upcoming,))
            yield self._folded(key, upcoming, values, False)
            upcoming += 1
        self.next.update((upcoming,))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        turns = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118
        for turn in turns:
            values = tuple(self.waiting.getValue((turn,)))
            self.waiting.removeKey((turn,))
            yield self._folded(key, turn, values, False)
        if turns:
            self.next.update((turns[-1] + 1,))

    def _folded(self, key, turn: int, values: tuple, late: bool) -> Row:
        known = tuple(self.known.get()) if self.known.exists() else (None,) * len(self.remembered)
        known = tuple(k if v is None else v for v, k in zip(values, known, strict=True))
        if any(v is not None for v in values):
            self.known.update(known)
        return Row(conversation=key[0], turn=turn, late=late, **dict(zip(self.remembered, values, strict=True)), **{f"known_{c}": v for c, v in zip(self.remembered, known, strict=True)})

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, conversation: str, turn: str, columns: list[str], first: int = 0, patience_ms: int | None = None, lifetime_ms: int | None = None) -> DataFrame:
    """(conversation, turn, late, columns, known_ columns): for each turn the last filled value so far of each column, as text.

    Over a stream of turns in any order; what ``answer.fold_memory`` gives over a whole table. A repeated
    turn comes back as late, or, while it waits, in place of the one before it. Needs ``STORE``. With a
    patience or a lifetime it goes on as long as it runs, so its trigger can't be ``availableNow``.
    """
    kind = turns.schema[conversation].dataType
    schema = T.StructType([T.StructField("conversation", kind), T.StructField("turn", T.LongType()), T.StructField("late", T.BooleanType())])
    for c in [*columns, *[f"known_{c}" for c in columns]]:
        schema = schema.add(c, T.StringType())
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), *[F.col(c).cast("string").alias(c) for c in columns])
    timed = "ProcessingTime" if patience_ms is not None or lifetime_ms is not None else "None"
    return rows.groupBy("conversation").transformWithState(statefulProcessor=Memory(columns, first, patience_ms, lifetime_ms), outputStructType=schema, outputMode="Append", timeMode=timed)
