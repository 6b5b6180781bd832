"""Streams drained with ``availableNow`` give what the batch jobs give."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import alarms, ledger
from shelfmark.plans.ingest import Store
from shelfmark.schemas import CHANGES, ENTRIES, MESSAGES, OBJECTS
from shelfmark.sinks import history
from shelfmark.sources.connector import (
    BatchFolders,
    Item,
    follow_connector,
    register_changes,
    register_source,
    scan_connector,
)
from shelfmark.streaming import jobs, state

NOW = datetime(2026, 6, 14, tzinfo=timezone.utc)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def message(n, key, attempt=1):
    return {"message_id": str(n), "body": json.dumps({"detail": {"object": {"key": key}}}), "attempt": attempt}


def test_ingest_stream(spark, tmp_path):
    bodies = {"tenants/dev/ns/a b.md": b"alpha", "tenants/dev/ns/c.md": b"gamma", "scratch/dev/bot/x.md": b"no"}
    stored = spark.createDataFrame([(k, len(b), "t", None, NOW) for k, b in bodies.items()], OBJECTS)
    contents = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "key string, content binary")
    inbox, store = tmp_path / "in", Store(str(tmp_path / "e"), str(tmp_path / "p"))
    quarantine = str(tmp_path / "q")

    def drain():
        jobs.ingest_stream(
            jobs.message_stream(spark, str(inbox)), lambda: stored, lambda: contents, store,
            str(tmp_path / "cp"), quarantine, lambda: NOW,
        ).awaitTermination()

    put(inbox, "1.json", [
        message(1, "tenants/dev/ns/a%20b.md"), message(2, "tenants/dev/ns/a+b.md"), message(3, "scratch/dev/bot/x.md"),
        {"message_id": "4", "body": "not-json", "attempt": 1}, message(5, "tenants/dev/ns/c.md", attempt=6), message(6, "garbage"),
    ])
    drain()
    assert values(store.current(spark), "path", "extraction.status") == [("a b.md", "extracted")]
    put(inbox, "2.json", [message(7, "tenants/dev/ns/a%20b.md"), message(8, "tenants/dev/ns/c.md")])
    drain()
    assert values(store.current(spark), "path") == [("a b.md",), ("c.md",)]
    # The redelivered key was done already and wrote no second row.
    assert history.read_history(spark, store.entries, ENTRIES).where("path = 'a b.md'").count() == 1
    dead = history.read_history(spark, quarantine, T.StructType([*MESSAGES.fields, T.StructField("error", T.StringType())]))
    assert values(dead, "message_id", "error") == [
        ("3", "not_an_original"), ("4", "malformed"), ("5", "too_many_deliveries"), ("6", "not_an_original"),
    ]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The commit of a finished batch is lost, so the stream runs the batch again."""
    bodies = {f"tenants/dev/ns/{n}": n.encode() for n in ("a.md", "b.md", "c.bin", "d.bin")}
    stored = spark.createDataFrame([(k, len(b), "t", None, NOW) for k, b in bodies.items()], OBJECTS)
    contents = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "key string, content binary")
    inbox, store = tmp_path / "in", Store(str(tmp_path / "e"), str(tmp_path / "p"))
    put(inbox, "1.json", [message(n, key) for n, key in enumerate(bodies)])
    seen, runs = [], []
    for _ in range(2):
        jobs.ingest_stream(
            jobs.message_stream(spark, str(inbox)), lambda: stored, lambda: contents, store,
            str(tmp_path / "cp"), str(tmp_path / "q"), lambda: runs.append(1) or NOW,
        ).awaitTermination()
        seen.append(values(history.read_history(spark, store.entries, ENTRIES), "path", "extraction.status", "batch_id"))
        for mark in (tmp_path / "cp" / "commits").iterdir():
            mark.unlink()
    assert len(runs) == 2
    assert seen[0] == seen[1] == [
        ("a.md", "extracted", 1), ("b.md", "extracted", 1), ("c.bin", "catalog_only", 1), ("d.bin", "catalog_only", 1),
    ]


def test_quota_stream_keeps_its_state(spark, tmp_path):
    rng = random.Random(4)
    rows = [("dev", f"p{rng.randint(0, 3)}", n, rng.randint(-30, 60)) for n in range(200)]
    schema = "tenant_id string, principal_id string, seq long, delta_bytes long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drain():
        stream = jobs.quota_stream(spark.readStream.schema(schema).parquet(source), 90)
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    for part in (rows[:90], rows[90:]):  # the second run starts from the first one's checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        drain()
    batch = ledger.quota_replay(spark.createDataFrame(rows, schema), 90)
    assert values(spark.read.parquet(out), *batch.columns) == values(batch)


def test_alarm_stream(spark, tmp_path):
    rows = [("m", datetime(2026, 1, 1, 0, n % 50, 7), n) for n in range(120)]
    df = spark.createDataFrame(rows, "m string, ts timestamp, v int")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.alarm_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "m", "ts", F.col("v"))
    query = stream.writeStream.format("memory").queryName("alarms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("alarms")) == values(alarms.alarm_windows(df, "m", "ts", F.col("v")))


def test_delta_sync_stops_at_failures(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "upsert", "a", "l", 1, None, "1"), (2, "delete", "b", None, None, None, None)]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(source)
    seen, failures = [], [1]

    def apply(batch, batch_id):
        seen.append(sorted(r.path for r in batch.collect()))
        return failures.pop() if failures else 0

    with pytest.raises(Exception, match="cursor stays"):
        jobs.delta_sync(jobs.change_stream(spark, source), apply, str(tmp_path / "cp")).awaitTermination()
    jobs.delta_sync(jobs.change_stream(spark, source), apply, str(tmp_path / "cp")).awaitTermination()
    jobs.delta_sync(jobs.change_stream(spark, source), apply, str(tmp_path / "cp")).awaitTermination()
    assert seen == [["a", "b"], ["a", "b"]]


class Shelf:
    def __init__(self, prefix=""):
        self.prefix = prefix

    def parts(self):
        return ["one", "two"]

    def discover(self, part):
        for n in range(2):
            yield Item(f"{self.prefix}{part}/{n}.md", f"{part}:{n}", size=n, version="v")


def test_connector_source(spark):
    register_source(spark, "shelf", Shelf)
    got = values(scan_connector(spark, "shelf", prefix="x/"), "path", "size", "content_type")
    assert got == [("x/one/0.md", 0, None), ("x/one/1.md", 1, None), ("x/two/0.md", 0, None), ("x/two/1.md", 1, None)]


def test_changes_of_a_connector(spark, tmp_path):
    """A batch is seen once it is complete, once only, and again after it failed."""
    feed, seen, fail = tmp_path / "feed", [], []
    register_changes(spark, "feed_folders", BatchFolders)

    def put_batch(n, *paths):
        rows = [(i, "upsert", p, None, i, None, "v") for i, p in enumerate(paths)]
        spark.createDataFrame(rows, CHANGES).write.parquet(str(feed / f"{n:03d}"))

    def take(batch, _):
        if fail:
            return 1
        seen.append(sorted(r.path for r in batch.collect()))
        return 0

    def drain():
        stream = follow_connector(spark, "feed_folders", root=str(feed))
        jobs.delta_sync(stream, take, str(tmp_path / "cp")).awaitTermination()

    drain()
    put_batch(1, "a", "b")
    put_batch(2, "c")
    (feed / "002" / "_SUCCESS").rename(tmp_path / "mark")
    drain()
    drain()
    (tmp_path / "mark").rename(feed / "002" / "_SUCCESS")
    put_batch(3, "d")
    fail.append(True)
    with pytest.raises(Exception, match="cursor stays"):
        drain()
    fail.clear()
    drain()
    assert [s for s in seen if s] == [["a", "b"], ["c", "d"]]


def at(minutes):
    return (NOW + timedelta(minutes=minutes)).isoformat()


class Turns:
    """A stream over JSON files that is stopped and started anew after every file."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.path, self.schema, self.build, self.n = spark, tmp_path, schema, build, 0

    def __call__(self, *rows):
        put(self.path / "in", f"{self.n}.json", [dict(zip(self.schema.names, r)) for r in rows])
        stream = self.build(self.spark.readStream.schema(self.schema).json(str(self.path / "in")))
        seen = []
        writer = stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
        writer.option("checkpointLocation", str(self.path / "cp")).trigger(availableNow=True).start().awaitTermination()
        self.n += 1
        return sorted(seen, key=str)


def moment(minutes):
    return (NOW + timedelta(minutes=minutes)).replace(tzinfo=None)


def test_alarm_timers_fire_clear_and_report_late_rows(spark, tmp_path):
    schema = T._parse_datatype_string("m string, ts timestamp, v double")
    turn = Turns(spark, tmp_path, schema, lambda s: state.alarm_timers(s, "m", "ts", F.col("v"), 10, 2, 300, "1 minute"))
    assert turn(("a", at(0), 20.0), ("a", at(6), 6.0), ("a", at(7), 6.0), ("b", at(1), 50.0), ("b", None, 1.0)) == []
    # The watermark passes 5 and 10; what came for 5 in two rows breaches, and b's second period is empty.
    assert turn(("b", at(12), 50.0), ("c", at(12), None)) == [("a", "ALARM", moment(5), 12.0)]
    got = turn(("a", at(3), 99.0), ("b", at(16), 1.0), ("b", at(17), 10.0), ("c", at(31), 1.0))
    assert ("a", "LATE", moment(3), 99.0) in got
    # a stays empty from 10 on and clears there, though nothing of it comes; b breaches at 10 and 15.
    assert ("a", "OK", moment(10), None) in got and ("b", "ALARM", moment(15), 11.0) in got
    # Its clearing timer is set while timers fire, so it may ring in this trigger or the next, but once.
    cleared = [r for r in got + turn(("c", at(60), 1.0)) if r[0] == "b" and r[1] == "OK"]
    assert cleared == [("b", "OK", moment(20), None)]


def test_deliveries_are_counted_and_forgotten(spark, tmp_path):
    schema = T._parse_datatype_string("message_id string, body string, ts timestamp")
    turn = Turns(spark, tmp_path, schema, lambda s: state.count_deliveries(s, "ts", 2, keep_days=1 / 24, late="0 seconds"))
    got = turn(("x", "1", at(0)), ("x", "2", at(1)), ("y", "1", at(1)), (None, "n", at(2)), ("z", "z", None))
    assert [r[:3] for r in got] == [("x", "delivery", 1), ("x", "delivery", 2), ("y", "delivery", 1), (None, "delivery", 1)]
    got = turn(("x", "3", at(2)), ("x", "4", at(3)))
    assert [(r[1], r[2], r[4]) for r in got] == [("dead", 3, "3"), ("dead", 4, "4")]
    got = turn(("y", "2", at(62)), ("x", "5", at(70)))
    assert sorted((r[0], r[1], r[2]) for r in got) == [("x", "delivery", 1), ("x", "expired", 4), ("y", "delivery", 1)]


def test_ingest_of_changed_objects_reads_no_catalog(spark, tmp_path):
    schema = T._parse_datatype_string("key string, etag string, size long, content_type string, ts timestamp")
    files, asked = {"tenants/dev/ns/a.md": b"alpha", "tenants/dev/ns/b.md": b"beta", "scratch/dev/bot/x.md": b"no"}, []
    store = Store(str(tmp_path / "e"), str(tmp_path / "p"))
    event = lambda k, tag, m: dict(zip(schema.names, (k, tag, 5, None, at(m))))

    def contents(named):
        wanted = [r.key for r in named.collect()]
        asked.append(sorted(wanted))
        return spark.createDataFrame([(k, bytearray(files[k])) for k in wanted], "key string, content binary")

    def drain(name, *rows):
        put(tmp_path / "in", name, rows)
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        state.ingest_changed(events, "ts", contents, store, str(tmp_path / "cp"), lambda: NOW).awaitTermination()

    a, b = "tenants/dev/ns/a.md", "tenants/dev/ns/b.md"
    drain("1.json", event(a, '"1"', 0), event(b, "1", 1), event(a, "2", 3), event("scratch/dev/bot/x.md", "1", 1), event(None, "1", 1))
    first = {r.path: r for r in store.current(spark).collect()}
    assert sorted(first) == ["a.md", "b.md"] and first["a.md"].etag == "2" and first["a.md"].created_at == moment(0)
    files[a] = b"alpha, rewritten"
    # The same etag again, an older event, and one object that changed.
    drain("2.json", event(b, "1", 9), event(a, "1", 2), event(a, "3", 9))
    again = {r.path: r for r in store.current(spark).collect()}
    assert [keys for keys in asked if keys] == [[a, b], [a]]
    assert again["a.md"].created_at == moment(0) and again["a.md"].etag == "3" and again["a.md"].entry_id == first["a.md"].entry_id
    assert again["a.md"].size == len(files[a])
    assert history.read_history(spark, store.entries, ENTRIES).count() == 3
