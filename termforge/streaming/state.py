"""Structured Streaming forms of the stateful behaviours, and their batch forms.

The stateful operators need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` must be :data:`STATE_STORE`.
A batch form walks rows dealt by key and sorted in their partition, one after
the other, so no key's rows are held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_arms(events: DataFrame) -> DataFrame:
    """Bandit arms of a stream: pulls and total reward by route and action (update mode)."""
    return events.groupBy(F.col("user_id").alias("route"), F.col("event_type").alias("action")).agg(F.count("*").alias("pulls"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Resumable ingestion: each id once within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_feedback(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


# --- cache with a time to live


def ttl_hits(events: DataFrame, seconds: int) -> DataFrame:
    """(event_id, hit) of a cache keyed by user and type: a hit finds a write at most ``seconds`` old and does not renew it.

    The answer depends on the key's earlier hits, so a key's events come in order of time and id, one at a time.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_type", us.alias("us"), "event_id")
    dealt = rows.repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", "us", "event_id")

    def walk(batches):
        key, written = None, 0
        for b in batches:
            hits = []
            for user, kind, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                hit = key == (user, kind) and t - written <= seconds * 1_000_000
                if not hit:
                    key, written = (user, kind), t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(hits, pa.bool_())], names=["event_id", "hit"])

    return dealt.mapInArrow(walk, "event_id long, hit boolean")


class _Cache(StatefulProcessor):
    """One key's time of writing; a timer clears it when the watermark has passed its end."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        written = self.written.get()[0] if self.written.exists() else None
        before, hits = written, []
        for t in events["us"].tolist():
            hit = written is not None and t - written <= self.seconds * 1_000_000
            if not hit:
                written = t
            hits.append(hit)
        if written != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.written.update((written,))
            self.handle.registerTimer(written // 1000 + self.seconds * 1000 + 1)
        yield pd.DataFrame({"event_id": events["event_id"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.written.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_stream(events: DataFrame, seconds: int, *, delay: str = "10 minutes") -> DataFrame:
    """As :func:`ttl_hits`, of a stream (append mode): the same hits if no event comes later than ``delay``, in any order
    within a batch.  A key's state goes when the watermark passes the end of its entry."""
    rows = events.withWatermark("ts", delay).select("user_id", "event_type", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(statefulProcessor=_Cache(seconds), outputStructType="event_id long, hit boolean", outputMode="append", timeMode="eventTime")


# --- choice of an arm, then the update with its reward


def draw(seed: int, event_id) -> tuple[float, int]:
    """A number from 0 to 1 and a whole number, the same for a seed and an event wherever it is handled."""
    h = hashlib.sha256(f"{seed}:{event_id}".encode()).digest()
    return int.from_bytes(h[:8], "big") / 2**64, int.from_bytes(h[8:16], "big")


def choose(arms: dict[str, tuple[int, float]], actions: list[str], epsilon: float, seed: int, event_id) -> tuple[str, bool]:
    """(action, explored): with probability ``epsilon`` any action, else that of the best mean reward; ties to the first."""
    u, k = draw(seed, event_id)
    if u < epsilon:
        return actions[k % len(actions)], True
    mean = lambda a: arms[a][1] / arms[a][0] if a in arms and arms[a][0] else 0.0
    return max(actions, key=mean), False


def _step(arms: dict, actions: list[str], epsilon: float, seed: int, event_id, rewards) -> tuple[str, bool, float]:
    action, explored = choose(arms, actions, epsilon, seed, event_id)
    reward = float(dict(rewards or {}).get(action) or 0.0)
    pulls, total = arms.get(action, (0, 0.0))
    arms[action] = (pulls + 1, total + reward)
    return action, explored, reward


_CHOICES = "route string, event_id long, action string, explored boolean, reward double"


def bandit_choices(requests: DataFrame, actions: list[str], *, epsilon: float = 0.2, seed: int = 42) -> DataFrame:
    """(route, event_id, action, explored, reward) of requests (route, ts, event_id, rewards): each choice, by what the
    route's earlier choices earned, in order of time and id.  ``rewards`` maps each action to what it would earn."""
    rows = requests.select(F.col("route").cast("string").alias("route"), "event_id", "rewards", "ts")
    dealt = rows.repartition("route").sortWithinPartitions("route", "ts", "event_id")

    def walk(batches):
        last, arms = None, {}
        for b in batches:
            out = []
            for route, event, rewards in zip(*(b.column(i).to_pylist() for i in range(3))):
                if route != last:
                    last, arms = route, {}
                out.append((route, event, *_step(arms, actions, epsilon, seed, event, rewards)))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["route", "event_id", "action", "explored", "reward"])

    return dealt.mapInArrow(walk, _CHOICES)


class _Bandit(StatefulProcessor):
    """One route's arms, a map of action to pulls and total reward."""

    def __init__(self, actions: list[str], epsilon: float, seed: int):
        self.actions, self.epsilon, self.seed = actions, epsilon, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arms = handle.getMapState("arms", "action string", "pulls long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arms = {k[0]: (v[0], v[1]) for k, v in self.arms.iterator()}
        requests = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = [(key[0], event, *_step(arms, self.actions, self.epsilon, self.seed, event, rewards)) for event, rewards in zip(requests["event_id"].tolist(), requests["rewards"])]
        for action, arm in arms.items():
            self.arms.updateValue((action,), arm)
        yield pd.DataFrame(out, columns=["route", "event_id", "action", "explored", "reward"])

    def close(self) -> None:
        pass


def bandit_stream(requests: DataFrame, actions: list[str], *, epsilon: float = 0.2, seed: int = 42) -> DataFrame:
    """As :func:`bandit_choices`, of a stream (update mode); a restarted query goes on with the arms that it had."""
    rows = requests.select(F.col("route").cast("string").alias("route"), "event_id", "rewards", "ts")
    return rows.groupBy("route").transformWithStateInPandas(statefulProcessor=_Bandit(actions, epsilon, seed), outputStructType=_CHOICES, outputMode="update", timeMode="none")
