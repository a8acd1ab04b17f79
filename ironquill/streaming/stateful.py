"""State that streams keep per key: who holds a subscription, what is stored of a user, open rate windows.

State lies in RocksDB, so that only the keys of the rows at hand are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests of one key that a task holds before it puts them aside, by minute.
HELD_REQUESTS = 100_000


def use_rocksdb(spark: SparkSession) -> None:
    """State operators of this kind need it; a stream that was started keeps the store of its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Moves(StatefulProcessor):
    """Per user: the subscription held.  Activations in, joins and leaves of subscriptions out.

    A row brings what is stored of its user (``stored``): that holds until the state knows better.
    """

    SCHEMA = "subscription_id string, seq bigint, user_id string, joins boolean"

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "subscription_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: r["seq"])
        before = now = self.held.get()[0] if self.held.exists() else next((r["stored"] for r in rows), None)
        for r in rows:
            if r["subscription_id"] == now:
                continue
            if now is not None:
                yield Row(subscription_id=now, seq=r["seq"], user_id=key[0], joins=False)
            now = r["subscription_id"]
            yield Row(subscription_id=now, seq=r["seq"], user_id=key[0], joins=True)
        if now != before:
            self.held.update((now,))


class Answers(StatefulProcessor):
    """Per subscription: its holders.  Moves and events in; events with the user who answers out (the smallest id)."""

    FACTS = ("seq", "ts", "event_type", "subscription_id", "order_id", "amount", "billing")
    SCHEMA = ("user_id string, seq bigint, ts timestamp, event_type string, subscription_id string, order_id string, "
              "amount string, billing string")

    def init(self, handle) -> None:
        self.holders = handle.getMapState("holders", "user_id string", "since bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.holders.updateValue((initialState["user_id"],), (-1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {k[0] for k in self.holders.keys()}
        holders, since, first = set(before), {}, min(before, default=None)
        for r in sorted(rows, key=lambda r: r["seq"]):
            user = r["user_id"]
            if r["joins"] is None:
                if first is not None:
                    yield Row(user_id=first, **{c: r[c] for c in self.FACTS})
            elif r["joins"]:
                holders.add(user)
                since[user] = r["seq"]
                first = user if first is None else min(first, user)
            elif user in holders:
                holders.remove(user)
                if user == first:
                    first = min(holders, default=None)
        # The store is told once what the trigger has changed, not of each move.
        for user in before - holders:
            self.holders.removeKey((user,))
        for user in holders & since.keys():
            self.holders.updateValue((user,), (since[user],))


class LastWrites(StatefulProcessor):
    """Per user: each column's last write and its place.  Writes in any order in; all that was written so far out."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns = columns

    @property
    def schema(self) -> str:
        return "id string, last_seq bigint, " + ", ".join(f"{c} string" for c in self.columns)

    def init(self, handle) -> None:
        self.stored = handle.getValueState("stored", "vals array<string>, seqs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = len(self.columns)
        vals, seqs = map(list, self.stored.get()) if self.stored.exists() else ([None] * n, [-1] * n)
        last = max(seqs, default=-1)
        for r in rows:
            last = max(last, r["seq"])
            for i, c in enumerate(self.columns):
                if r[c] is not None and r["seq"] > seqs[i]:
                    vals[i], seqs[i] = r[c], r["seq"]
        self.stored.update((vals, seqs))
        yield Row(id=key[0], last_seq=last, **dict(zip(self.columns, vals, strict=True)))


class RateWindows(StatefulProcessor):
    """Per (ip, bucket): start of the open window and its requests so far.

    Requests of a trigger are folded minute by minute in time order.  Past
    ``held`` of them the rest are put aside in the state by minute, so that a
    key's backlog needs the memory of its busiest minute.  A timer at the
    window's end clears the key: the next request would open a new window.
    """

    SCHEMA = "req_id bigint, ip string, bucket string, t bigint, window_start bigint, n bigint, max_requests int"
    _MINUTE = 60_000_000

    def __init__(self, window_us: int, held: int = HELD_REQUESTS):
        self.window_us, self.held = window_us, held

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, count bigint")
        self.aside = handle.getMapState("aside", "minute bigint, part bigint", "t array<bigint>, req_id array<bigint>, most array<int>")

    def _by_minute(self, rows) -> Iterator[list[tuple]]:
        here, parts, n = {}, {}, 0
        for r in rows:
            here.setdefault(r["t"] // self._MINUTE, []).append((r["t"], r["req_id"], r["max_requests"]))
            n += 1
            if n >= self.held:
                for minute, some in here.items():
                    parts[minute] = parts.get(minute, 0) + 1
                    self.aside.updateValue((minute, parts[minute]), tuple(map(list, zip(*some, strict=True))))
                here, n = {}, 0
        for minute in sorted({*here, *parts}):
            some = here.pop(minute, [])
            for part in range(1, parts.get(minute, 0) + 1):
                some += zip(*self.aside.getValue((minute, part)), strict=True)
                self.aside.removeKey((minute, part))
            yield sorted(some)

    def _end_ms(self, start: int) -> int:
        return (start + self.window_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.window.exists()
        start, count = self.window.get() if known else (None, 0)
        for minute in self._by_minute(rows):
            for t, req_id, most in minute:
                if start is None or t - start > self.window_us:
                    start, count = t, 1
                else:
                    count += 1
                yield Row(req_id=req_id, ip=key[0], bucket=key[1], t=t, window_start=start, n=count, max_requests=most)
        if start is not None:
            self.window.update((start, count))
            if not known:
                self.handle.registerTimer(self._end_ms(start))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = self._end_ms(self.window.get()[0]) if self.window.exists() else 0
        if end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)  # a later window is open
        else:
            self.window.clear()
        return iter(())
