"""State machines over the events of a key in event order, in bounded memory: rows wait in the state store, timers call them.

Keys are dealt to ``BUCKETS`` buckets by a hash, since a call of Spark's costs some milliseconds whatever it brings. The waiting rows
of a bucket are leaves in a map state: stretches of time of ``LEAF`` rows at most (more only within one time), held as columns and split
at a time when they grow beyond. A bucket has one timer, at its first waiting time; when the watermark has passed it, the leaves are
taken in order up to the watermark, and their rows by time and tie, each to its key's machine. So a task holds a leaf or ``GATHERED``
rows that came (and a batch's more), whatever a micro-batch brings of a hot key; the rest lies in RocksDB, which spills. The states of
a bucket's machines are one value, read when its timer calls: a 4096th of all keys. The store is asked a few times a bucket and
micro-batch and a few times a leaf, not a few times a row or key.

Rows later than the watermark are dropped by it (one of the watermark's own millisecond still counts, after those before it); rows that it hasn't passed wait for the next run of the same checkpoint.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.session import prepare

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a machine does with a row: (state, row) -> (state, values of the output columns).
Step = Callable[[object, dict], tuple[object, tuple]]


def stores(spark: SparkSession) -> SparkSession:
    """Lets this session's streams keep maps and timers (the store is a session setting, read when a stream starts)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return prepare(spark)


#: Waiting rows that are read and written at once; rows that came and are put among them at once.
LEAF, GATHERED = 1024, 16 * 1024
#: Groups that the keys are dealt to.
BUCKETS = 4096
#: Columns beside those of the rows: the bucket, whether the key is null, and the time in milliseconds.
BUCKET, NONE, AT = "quern_bucket", "quern_none", "quern_at"
#: Rows as columns of one length.
Rows = dict[str, np.ndarray]


def taken(rows: Rows, which: slice | np.ndarray) -> Rows:
    return {c: x[which] for c, x in rows.items()}


def joined(parts: list[Rows]) -> Rows:
    """Rows of several parts; kinds that differ (a part with nulls) keep their own values."""
    if len(parts) == 1:
        return parts[0]
    each = {c: [p[c] for p in parts] for c in parts[0]}
    return {c: np.concatenate(x if len({y.dtype for y in x}) == 1 else [y.astype(object) for y in x]) for c, x in each.items()}


class Machine(StatefulProcessor):
    """Rows of a bucket's keys in the order of (time, tie), each handed to ``step`` with its key's state.

    Rows without the column ``key`` are those of the one key that they are grouped by.
    """

    def __init__(self, key: str, time: str, tie: str, step: Step, start: object, columns: list[str]):
        self.key, self.time, self.tie, self.step, self.start, self.columns = key, time, tie, step, start, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows binary")
        self.places = handle.getValueState("places", "leaves binary")
        self.own = handle.getValueState("own", "states binary")

    def held(self) -> tuple[list[int], int | None]:
        """The first times of the leaves in order, and the timer's time."""
        return pickle.loads(self.places.get()[0]) if self.places.exists() else ([], None)

    def keep(self, leaves: list[int], old: int | None) -> None:
        """Writes what ``held`` reads, with the timer at the first waiting time."""
        now = leaves[0] if leaves else None
        if now != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if now is not None:
                self.handle.registerTimer(now)
        self.places.update((pickle.dumps((leaves, now)),))

    def leaf(self, at: int) -> Rows:
        return pickle.loads(self.waiting.getValue((at,))[0])

    def split(self, rows: Rows) -> list[int]:
        """Writes rows in order of their times as leaves, none of which begins within a time; their first times."""
        out, at, times = [], 0, rows[AT]
        while at < len(times):
            end = at + LEAF // 2 if len(times) - at > LEAF else len(times)
            end = int(np.searchsorted(times, times[end - 1], "right"))
            self.waiting.updateValue((int(times[at]),), (pickle.dumps(taken(rows, slice(at, end))),))
            out.append(int(times[at]))
            at = end
        return out

    def put(self, came: Rows, leaves: list[int]) -> list[int]:
        """Writes rows that came among the waiting ones; the first times of all leaves."""
        came = taken(came, np.argsort(came[AT], kind="stable"))
        done: list[int] = []
        while len(came[AT]):
            # the leaf of the first row, and the rows before the next leaf
            k = bisect_right(leaves, int(came[AT][0])) - 1
            upto = int(np.searchsorted(came[AT], leaves[k + 1])) if k + 1 < len(leaves) else len(came[AT])
            some, came = taken(came, slice(0, upto)), taken(came, slice(upto, None))
            if k >= 0:
                some = joined([self.leaf(leaves[k]), some])
                some = taken(some, np.argsort(some[AT], kind="stable"))
            done += leaves[: max(k, 0)] + self.split(some)
            leaves = leaves[k + 1 :]
        return done + leaves

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        leaves, timer = self.held()
        parts: list[Rows] = []
        for frame in rows:
            part = {c: frame[c].to_numpy() for c in frame.columns if c != BUCKET}
            part[self.time] = part[self.time].astype("datetime64[ns]")
            # timers count milliseconds, as the watermark does
            part[AT] = part[self.time].view(np.int64) // 1_000_000
            parts.append(part)
            if sum(len(p[AT]) for p in parts) >= GATHERED:
                leaves, parts = self.put(joined(parts), leaves), []
        if parts:
            leaves = self.put(joined(parts), leaves)
        self.keep(leaves, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        leaves, timer = self.held()
        states = pickle.loads(self.own.get()[0]) if self.own.exists() else {}
        while leaves and leaves[0] <= passed:
            at, *leaves = leaves
            rows = self.leaf(at)
            self.waiting.removeKey((at,))
            upto = int(np.searchsorted(rows[AT], passed, "right"))
            leaves = self.split(taken(rows, slice(upto, None))) + leaves
            rows = taken(rows, slice(0, upto))
            rows = taken(rows, np.lexsort((pd.Series(rows[self.tie]).rank(method="first").to_numpy(), rows[self.time])))
            lists = {c: pd.Series(x).tolist() for c, x in rows.items() if c not in (AT, NONE)}
            if self.key in lists:
                lists[self.key] = owners = [None if gone else k for k, gone in zip(lists[self.key], rows[NONE].tolist(), strict=True)]
            else:
                owners = [key[0]] * upto
            out = []
            for owner, tie, values in zip(owners, lists[self.tie], zip(*lists.values(), strict=True), strict=True):
                states[owner], made = self.step(states.get(owner, self.start), dict(zip(lists, values, strict=True)))
                out.append((tie, owner, *made))
            yield pd.DataFrame(out, columns=self.columns, dtype=object)
        self.own.update((pickle.dumps(states),))
        self.keep(leaves, timer)

    def close(self) -> None:
        pass


def in_order(
    events: DataFrame, step: Step, start: object, output: str, key: str = "user_id", time: str = "ts", tie: str = "event_id", late: str = "10 minutes", reads: tuple[str, ...] | None = None
) -> DataFrame:
    """(tie, key, ``output`` columns): each row of a stream through its key's machine, in event order.

    ``reads`` names the columns that ``step`` reads beside key, time and tie (None: all); others don't wait with the rows.
    """
    stores(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{tie} {kinds[tie]}, {key} {kinds[key]}, {output}"
    columns = [tie, key, *(c.split()[0] for c in output.split(", "))]
    others = [c for c in (events.columns if reads is None else reads) if c not in (key, time, tie)]
    # a null among them would make pandas' numbers floats
    known = F.coalesce(F.col(key), F.lit("0").cast(kinds[key])).alias(key)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias(BUCKET)
    dealt = events.withWatermark(time, late).select(bucket, time, tie, known, F.col(key).isNull().alias(NONE), *others)
    return dealt.groupBy(BUCKET).transformWithStateInPandas(Machine(key, time, tie, step, start, columns), schema, "Append", "EventTime")


def habits(ttl: int = 3600, alpha: float = 0.3, base: int = 30, most: int = 3600, ring: int = 10) -> tuple[Step, object, str]:
    """A machine of four small states a key, for ``in_order``: cached, average, wait and oldest.

    ``cached``: the key was seen within ``ttl`` seconds before; ``average``: exponential, of the values; ``wait``: seconds of
    backoff after errors in a row; ``oldest``: the first event of the ring of the last ``ring`` ones.
    """

    def step(state, row):
        seen, average, errors, last = state
        now = row["ts"].value
        cached = seen is not None and now - seen < ttl * 1_000_000_000
        value = row["value"]
        if value is not None and value == value:
            average = value if average is None else alpha * value + (1 - alpha) * average
        errors = errors + 1 if row["event_type"] == "error" else 0
        wait = float(min(base * 2 ** (errors - 1), most)) if errors else 0.0
        last = (*last, row["event_id"])[-ring:]
        return (now, average, errors, last), (cached, average, wait, last[0])

    return step, (None, None, 0, ()), "cached boolean, average double, wait double, oldest long"
