"""The deck life cycle as a stateful stream: one small state per deck, updated as its events arrive.

The batch formula (``operators.lifecycle``) goes over a log; this one never reads a log again. It suits many small
batches: work and output follow the decks that a batch names. Events of a deck count in the order of the batches,
within a batch by ``seq``. Stamps may come late or be older than the one before: a discovery always takes over, and starts
a new epoch only if its stamp advanced, so there is no watermark and nothing is dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from deckspark.functions.formats import LEASE_MINUTES
from deckspark.sources.keyed import KeyedTable

#: What is kept of a deck; times in microseconds. ``stale`` says that its lease has run out.
STATE = (
    "status string, updated_at double, created_at double, cards_fetched_us bigint, claimed_us bigint, "
    "claimed_by string, epoch int, stale boolean"
)
_FIELDS = [part.split()[0] for part in STATE.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def advance(state: dict | None, kind: str, stamp, created, at, holder) -> dict | None:
    """The state after one event; events before the first discovery change nothing."""
    if kind == "discover":
        if state is None:
            return dict.fromkeys(_FIELDS) | {"status": "discovered", "updated_at": stamp, "created_at": created, "epoch": 1, "stale": False}
        newer = stamp is not None and (state["updated_at"] is None or stamp > state["updated_at"])
        state = state | {"updated_at": stamp}
        if newer:
            state |= {"status": "discovered", "epoch": state["epoch"] + 1, "claimed_us": None, "claimed_by": None, "stale": False}
        return state
    if state is None:
        return None
    status = state["status"]
    if kind == "ok" and status != "done":
        return state | {"status": "done", "cards_fetched_us": at, "stale": False}
    if kind == "err" and status != "done":
        return state | {"status": "error", "stale": False}
    if kind == "claim":
        held = state | {"claimed_us": at, "claimed_by": holder}
        return held | {"status": "claimed", "stale": False} if status in ("discovered", "claimed") else held
    return state


class DeckStates(StatefulProcessor):
    """Emits a deck's state after each batch that names it, and once more when its lease runs out (with timers)."""

    def __init__(self, key: list[str], timers: bool):
        self.key, self.timers = key, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("deck", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        state = None if held is None else dict(zip(_FIELDS, held))
        for event in sorted(rows, key=lambda r: r["seq"]):
            state = advance(state, event["kind"], event["updated_at"], event["created_at"], event["at_us"], event["holder"])
        if state is not None:
            self.state.update(tuple(state[f] for f in _FIELDS))
            if self.timers and state["status"] == "claimed" and state["claimed_us"] is not None:
                self.handle.registerTimer(state["claimed_us"] // 1000 + LEASE_MINUTES * 60_000)
            yield Row(**dict(zip(self.key, key)), **state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        state = None if held is None else dict(zip(_FIELDS, held))
        due = expiredTimerInfo.getExpiryTimeInMs()
        # A lease taken anew has a timer of its own.
        if state and state["status"] == "claimed" and (state["claimed_us"] or 0) // 1000 + LEASE_MINUTES * 60_000 <= due:
            state["stale"] = True
            self.state.update(tuple(state[f] for f in _FIELDS))
            yield Row(**dict(zip(self.key, key)), **state)

    def close(self) -> None:
        pass


def keep_states(events: DataFrame, key: list[str], timers: bool = False) -> DataFrame:
    """A stream of (key, state) from a stream of events (key, seq, kind, updated_at, created_at, at_us, holder).

    ``timers`` announces leases that have run out by the clock; without it they are found when decks are handed out.
    """
    use_rocksdb(events.sparkSession)
    kinds = dict(events.dtypes)
    wanted = events.filter(F.col("kind").isin("discover", "claim", "ok", "err"))
    out = ", ".join([f"{c} {kinds[c]}" for c in key]) + f", {STATE}"
    return wanted.groupBy(*key).transformWithState(
        DeckStates(key, timers), out, "Update", "processingTime" if timers else "none"
    )


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that holds many small states outside the heap; the only one this operator works with."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start_states(states: DataFrame, table: KeyedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge the states into their table, batch by batch: only the buckets of the decks named."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        news = batch.persist()
        try:
            version = batch_id + 1
            touched = table.touched(news, below=version)
            stored = table.read(below=version, buckets=touched)
            # A deck may be announced twice in a batch: by its events, and by its lease running out.
            last = news.groupBy(*table.key).agg(F.max_by(F.struct(*stored.columns), F.struct("epoch", "stale")).alias("s")).select("s.*")
            table.write(stored.join(last, list(table.key), "left_anti").unionByName(last), version, buckets=touched)
        finally:
            news.unpersist()

    writer = states.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
