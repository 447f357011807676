"""Chat messages as a stream: sessions by idle time and length, and the learning loop over them as commits of a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memloom.operators.learning import learned
from memloom.sources.versions import Versions

#: Messages after which a session is split, and the idle time (milliseconds of event time) that ends one.
SPLIT, IDLE_MS = 20, 30 * 60 * 1000
SESSION = "conversation long, session long, closed_by string, messages array<struct<id:long,role:string,text:string,at:timestamp>>"
MESSAGE = "id long, role string, text string, at timestamp"
STORE = "id long, content string, confidence double, confirmation_count long, is_superseded boolean"


class Sessions(StatefulProcessor):
    """Keeps the messages of each conversation's open session. A session is emitted when it has `split` messages, when a message
    comes after an idle time, or when the watermark passes the idle time after its last message."""

    def __init__(self, split: int = SPLIT, idle_ms: int = IDLE_MS) -> None:
        self.split, self.idle_ms = split, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", MESSAGE)
        self.number = handle.getValueState("number", "n long, due long")

    def _emit(self, key, rows: list[tuple], why: str) -> pd.DataFrame:
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + 1, 0))
        self.open.clear()
        messages = [{"id": i, "role": r, "text": t, "at": a} for i, r, t, a in rows]
        return pd.DataFrame({"conversation": [key[0]], "session": [n], "closed_by": [why], "messages": [messages]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((tuple(r) for pdf in rows for r in pdf[["id", "role", "text", "at"]].itertuples(index=False)), key=lambda r: (r[3], r[0]))
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for row in new:
            if held and (pd.Timestamp(row[3]) - pd.Timestamp(held[-1][3])).total_seconds() * 1000 > self.idle_ms:
                yield self._emit(key, held, "idle")
                held = []
            held.append(row)
            if len(held) >= self.split:
                yield self._emit(key, held, "length")
                held = []
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if held:
            self.open.put([(int(i), r, t, pd.Timestamp(a).to_pydatetime()) for i, r, t, a in held])
            self.handle.registerTimer(int(pd.Timestamp(held[-1][3]).tz_localize("UTC").timestamp() * 1000) + self.idle_ms)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and (held := [tuple(r) for r in self.open.get()]):
            yield self._emit(key, held, "idle")

    def close(self) -> None:
        pass


def sessions(messages: DataFrame, late: str = "10 minutes", split: int = SPLIT, idle_ms: int = IDLE_MS) -> DataFrame:
    """Closed sessions of a stream of messages (conversation, id, role, text, at). Needs the RocksDB state store; open sessions
    are all that is kept, and each is bounded by `split` messages."""
    stamped = messages.withWatermark("at", late)
    return stamped.groupBy("conversation").transformWithStateInPandas(Sessions(split, idle_ms), SESSION, "Append", "EventTime")


def step_of(spark: SparkSession, versions: Versions) -> Callable[[DataFrame, int], None]:
    """What the loop does with a batch of closed sessions: one commit that names the batch's number."""

    def step(batch: DataFrame, number: int) -> None:
        if versions.entry()["meta"].get("batch", -1) >= number or batch.isEmpty():
            return
        learn_batch(spark, versions, batch.select(F.explode("messages").alias("m")).select("m.id", "m.role", "m.text"), number)

    return step


def learn_sessions(spark: SparkSession, closed: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Learn from each batch of closed sessions into a versioned store. A batch that is repeated after a failure changes
    nothing: facts, pending statements and links come from a batch as a whole or not at all."""
    step = step_of(spark, Versions(spark, store))
    return closed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_batch(spark: SparkSession, versions: Versions, messages: DataFrame, number: int) -> int:
    """One step of the loop: what changes in the store becomes a commit of changed rows, with the ids that these replace."""
    facts = versions.live("facts")
    got = learned(spark.createDataFrame([], STORE) if facts is None else facts.select(*(c.split()[0] for c in STORE.split(", "))), messages)
    changed = versions.write("facts", got.changed)
    replaced = versions.write("gone", spark.read.parquet(f"{versions.path}/{changed[1]}").select("id"))
    return versions.commit([changed, replaced, versions.write("pending", got.pending), versions.write("links", got.links)], note=f"batch {number}", meta={"batch": number})
