"""Streams that remember: deliveries of a message, the newest version of an object, the state of an alarm.

All three keep a few values a key in the RocksDB state store (``STATE_STORE`` set to
``ROCKS_DB`` in ``jobs``), fold their rows frame by frame as they come, and survive a
restart through the stream's checkpoint: a batch that runs again starts from the state
before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import limits
from ..functions import keys, paths
from ..operators.alarms import PERIOD
from ..operators.catalog import PK
from ..operators.upkeep import originals
from ..plans.ingest import Store, ingest_documents, save
from ..schemas import ENTRIES
from ..sources.normalizers import Gate, Normalizer

DAY_MS = 24 * 60 * 60 * 1000

# --- deliveries ------------------------------------------------------------------


class _Deliveries(StatefulProcessor):
    """Counts the deliveries of a message until none has come for ``keep_ms`` of event time."""

    COLUMNS = ["message_id", "kind", "n", "at_ms", "body"]

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def _expired(self, key, n: int, last: int) -> list[tuple]:
        return [(key[0], "expired", n, last, None)] if n > self.most else []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.held.get() if self.held.exists() else (0, 0)
        for frame in rows:
            frame = frame.sort_values("at_ms")
            out = []
            for at, body in zip(frame["at_ms"].tolist(), frame["body"].tolist()):
                if n and at > last + self.keep_ms:
                    out += self._expired(key, n, last)
                    n = 0
                n, last = n + 1, max(last, at)
                out.append((key[0], "dead" if n > self.most else "delivery", n, at, body))
            yield pd.DataFrame(out, columns=self.COLUMNS)
        self.held.update((n, last))
        self.handle.registerTimer(last + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.held.get() if self.held.exists() else (0, None)
        if last is None or last + self.keep_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # heard of since; a later timer stands
        self.held.clear()
        if n > self.most:
            yield pd.DataFrame(self._expired(key, n, last), columns=self.COLUMNS)

    def close(self) -> None:
        pass


def count_deliveries(
    messages: DataFrame, at: str, most: int = limits.MAX_DELIVERIES,
    keep_days: float = limits.DEAD_LETTER_DAYS, late: str = "10 minutes",
) -> DataFrame:
    """(message_id, kind, n, at, body) of a stream of (message_id, body, ``at``), a row a delivery.

    ``n`` counts how often the id has come, in this trigger or an earlier one. The first ``most``
    are of the kind ``delivery``, later ones are ``dead`` and belong into the dead letters. A
    message that nobody delivered for ``keep_days`` is forgotten: if it was dead, an ``expired``
    row with its last time says that its letters can go, and it counts from 1 when it comes again.
    Rows without a time are left out; those without an id share one count. A pause is seen inside
    a trigger too, unless its message has more rows there than an Arrow batch.
    """
    counted = _timed(messages, at, late, "message_id", "body").groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=_Deliveries(most, int(keep_days * DAY_MS)),
        outputStructType="message_id string, kind string, n long, at_ms long, body string",
        outputMode="Append",
        timeMode="EventTime",
    )
    return counted.select("message_id", "kind", "n", F.timestamp_millis("at_ms").alias("at"), "body")


def _timed(rows: DataFrame, at: str, late: str, *columns: str | Column) -> DataFrame:
    """``columns`` and ``at_ms`` of the rows that have a time, under a watermark.

    The watermark stands on a column of its own that ends here: on a column that reached the
    stateful operator, Spark would drop late rows before anything can be said about them.
    """
    time = F.col(at).cast("timestamp")
    marked = rows.where(time.isNotNull()).select(*columns, F.unix_millis(time).alias("at_ms"), time.alias("_mark"))
    return marked.withWatermark("_mark", late).drop("_mark")


# --- newest versions -------------------------------------------------------------


def _place(row: pd.DataFrame) -> tuple[int, str]:
    return int(row["at_ms"].iloc[0]), row["etag"].iloc[0]


class _Newest(StatefulProcessor):
    """Keeps (last, etag, first) of an object and reports it when its etag becomes another one."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, etag string, first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        top, first = None, held[2] if held else None
        for frame in rows:
            newest = frame.sort_values(["at_ms", "etag"]).iloc[-1:]
            if top is None or _place(newest) > _place(top):
                top = newest
            if held is None:
                first = int(min(frame["at_ms"].min(), *([] if first is None else [first]), 2**62))
        if held is not None and _place(top) <= (held[0], held[1]):
            return
        self.held.update((*_place(top), first))
        self.handle.registerTimer(_place(top)[0] + self.keep_ms)
        if held is None or _place(top)[1] != held[1]:
            yield top.assign(known=held is not None, first_ms=first)[
                ["key", "etag", "at_ms", "size", "content_type", "known", "first_ms"]
            ]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def changed_objects(events: DataFrame, at: str, keep_days: float = 90, late: str = "10 minutes") -> DataFrame:
    """(key, etag, at, size, content_type, known, first) of objects whose content is new to the stream.

    ``events`` has (key, etag, size, content_type) and the time ``at``. An event that is older
    than what is held, or names the etag that is held, is silent; of several in a trigger the
    newest counts, of several at one time that of the greatest etag. ``known`` says that the
    object was met before, ``first`` when. An object unheard of for ``keep_days`` of event time is
    forgotten and counts as new. Rows without a key or a time are left out.
    """
    columns = ("key", paths.norm_etag(F.col("etag")).alias("etag"), F.col("size").cast("long").alias("size"), "content_type")
    newest = _timed(events.where(F.col("key").isNotNull()), at, late, *columns).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Newest(int(keep_days * DAY_MS)),
        outputStructType="key string, etag string, at_ms long, size long, content_type string, known boolean, first_ms long",
        outputMode="Append",
        timeMode="EventTime",
    )
    moments = [F.timestamp_millis(f"{c}_ms").alias(c) for c in ("at", "first")]
    return newest.select("key", "etag", moments[0], "size", "content_type", "known", moments[1])


def ingest_changed(
    events: DataFrame,
    at: str,
    contents: Callable[[DataFrame], DataFrame],
    store: Store,
    checkpoint: str,
    now: Callable[[], datetime],
    quarantine: str | None = None,
    rungs: list[Normalizer] | None = None,
    gate: Gate | None = None,
):
    """Extract what ``changed_objects`` reports, trigger by trigger, into ``store``.

    Neither the catalog nor a listing is read: what a trigger must know of an object (its etag,
    when it was first seen) is in the stream's state, and its id follows from its key.
    ``contents(keys)`` returns (key, content) of the given keys alone. An entry is created when its
    object was first seen. Keys that are no originals' are left out.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        named = batch.where(keys.is_indexable(F.col("key")))
        wanted = originals(named).select(*PK, "key", "content_type", F.nullif("etag", F.lit("")).alias("etag"))
        facts = named.select("key", F.col("first").alias("created_at"))
        held = wanted.join(facts, "key").withColumn("entry_id", paths.entry_id(*(F.col(c) for c in PK)))
        have = {*PK, "entry_id", "created_at"}
        entries = held.select(
            *(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRIES.fields)
        )
        documents = wanted.join(contents(named.select("key")), "key")
        save(ingest_documents(documents, entries, now(), rungs, gate), store, batch_id + 1, quarantine)

    return (
        changed_objects(events, at)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- alarms ----------------------------------------------------------------------


class _Alarm(StatefulProcessor):
    """Sums open periods of a metric and judges each when the watermark has passed its end."""

    def __init__(self, threshold: float, periods: int, period_ms: int):
        self.threshold, self.periods, self.period_ms = threshold, periods, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "n long", "stat double")
        self.turn = handle.getValueState("turn", "last long, run int, alarm boolean")

    def _row(self, key, kind: str, ms: int, value: float | None) -> pd.DataFrame:
        return pd.DataFrame({"metric": [key[0]], "kind": [kind], "at_ms": [ms], "value": [value]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = self.turn.get()[0] if self.turn.exists() else None
        for frame in rows:
            number = frame["at_ms"] // self.period_ms
            late = (number + 1) * self.period_ms <= passed
            if last is not None:
                late |= number <= last
            if late.any():
                gone = frame[late]
                yield pd.DataFrame({"metric": key[0], "kind": "LATE", "at_ms": gone["at_ms"], "value": gone["value"]})
            for n, stat in frame[~late].groupby(number[~late])["value"].sum().items():
                n = int(n)
                if self.open.containsKey((n,)):
                    stat += self.open.getValue((n,))[0]
                else:
                    self.handle.registerTimer((n + 1) * self.period_ms)
                self.open.updateValue((n,), (float(stat),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = expiredTimerInfo.getExpiryTimeInMs() // self.period_ms - 1
        last, run, alarm = self.turn.get() if self.turn.exists() else (n - 1, 0, False)
        if n <= last:
            return  # an empty period that was passed with a later one
        if n > last + 1:  # nothing came in between, and an empty period does not breach
            run = 0
            if alarm:
                alarm = False
                yield self._row(key, "OK", (last + 1) * self.period_ms, None)
        stat = None
        if self.open.containsKey((n,)):
            stat = self.open.getValue((n,))[0]
            self.open.removeKey((n,))
        run = min(run + 1, self.periods) if stat is not None and stat > self.threshold else 0
        if alarm != (run >= self.periods):
            alarm = not alarm
            yield self._row(key, "ALARM" if alarm else "OK", n * self.period_ms, stat)
        self.turn.update((n, run, alarm))
        if alarm and not self.open.containsKey((n + 1,)):
            self.handle.registerTimer((n + 2) * self.period_ms)  # clears it, should the next period stay empty

    def close(self) -> None:
        pass


def alarm_timers(
    metrics: DataFrame, metric: str, ts: str, value: Column, threshold: float,
    periods: int = 1, period: int = PERIOD, late: str = "10 minutes",
) -> DataFrame:
    """(metric, kind, at, value): when alarms fire (ALARM) and clear (OK), and rows that came too late (LATE).

    A period breaches if the sum of its values is over ``threshold``; the ``periods``-th breaching
    one in a row fires, the next that does not breach clears, be it empty. A period is judged by a
    timer once the watermark is past its end; ``at`` is its start. A row of a period judged
    already changes nothing and comes out as LATE, with its own time and value. Rows without a
    time are left out; null values count as nothing.
    """
    named = F.col(metric).cast("string").alias("metric")
    rows = _timed(metrics, ts, late, named, F.coalesce(value, F.lit(0)).cast("double").alias("value"))
    turns = rows.groupBy("metric").transformWithStateInPandas(
        statefulProcessor=_Alarm(threshold, periods, int(period) * 1000),
        outputStructType="metric string, kind string, at_ms long, value double",
        outputMode="Append",
        timeMode="EventTime",
    )
    return turns.select("metric", "kind", F.timestamp_millis("at_ms").alias("at"), "value")
