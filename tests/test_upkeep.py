"""Reconcile, sync, history, retention, sources, messages, scratch and alarms."""

import json
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from conftest import entry_row, values
from pyspark.sql import functions as F

from shelfmark.functions import keys
from shelfmark.operators import alarms, ledger, upkeep
from shelfmark.plans import reconcile as sweep_plan
from shelfmark.schemas import CHANGES, ENTRIES, OBJECTS, SOURCE_ITEMS
from shelfmark.sinks import history, tables
from shelfmark.sources import files, messages, records

NOW = datetime(2026, 6, 14, tzinfo=timezone.utc)
OLD = NOW - timedelta(hours=1)


def objects(spark, *paths, etag="e", ns="ns"):
    return spark.createDataFrame([(f"tenants/dev/{ns}/{p}", 1, etag, None, OLD) for p in paths], OBJECTS)


def rows(spark, *specs):
    return spark.createDataFrame([entry_row(**{"ns": "ns", "updated_at": OLD, **s}) for s in specs], ENTRIES)


@pytest.mark.parametrize(
    "stored,entry,state,action",
    [
        (["a"], dict(path="a"), "in_sync", "none"),
        (["a"], None, "new", "enqueue"),
        (["a"], dict(path="a", deleted_at=OLD), "revived", "enqueue"),
        (["a"], dict(path="a", etag="stale"), "drifted", "enqueue"),
        (["a"], dict(path="a", etag='"e"'), "in_sync", "none"),
        ([], dict(path="a"), "orphaned", "tombstone"),
        ([], dict(path="a", updated_at=NOW), "fresh", "none"),
        ([], dict(path="a", deleted_at=OLD), "gone", "none"),
    ],
)
def test_reconcile_states(spark, stored, entry, state, action):
    entries = rows(spark, entry) if entry else spark.createDataFrame([], ENTRIES)
    listed = objects(spark, *stored) if stored else spark.createDataFrame([], OBJECTS)
    got = values(upkeep.reconcile_states(listed, entries, NOW), "path", "state", "action")
    assert got == [("a", state, action)]


def test_a_second_sweep_is_clean(spark):
    entries = rows(spark, dict(path="kept"), dict(path="lost"), dict(path="only", ns="ghost"))
    stored = objects(spark, "kept", "fresh")
    strays = spark.createDataFrame([("scratch/dev/bot/x", 1, "e", None, OLD), ("junk", 1, "e", None, OLD)], OBJECTS)
    first = sweep_plan.reconcile(stored.union(strays), entries, NOW)
    report = first.report.first()
    assert report.asDict() == dict(namespaces=2, objects=2, live_rows=3, enqueued=1, tombstoned=2, in_sync=1)
    assert values(first.enqueue) == [("tenants/dev/ns/fresh",)]
    healed = upkeep.latest_version(
        entries.withColumn("b", F.lit(1)).unionByName(first.tombstones.withColumn("b", F.lit(2))), ["tenant_id", "namespace", "path"], ["b"]
    ).drop("b").unionByName(rows(spark, dict(path="fresh")))
    second = sweep_plan.reconcile(stored, healed, NOW).report.first()
    assert (second.enqueued, second.tombstoned, second.in_sync) == (0, 0, 2)


def test_untagged_stores_compare_size_and_time(spark):
    listed = spark.createDataFrame([("tenants/dev/ns/a", 1, "", None, OLD), ("tenants/dev/ns/b", 2, "", None, OLD)], OBJECTS)
    got = values(upkeep.reconcile_states(listed, rows(spark, dict(path="a"), dict(path="b")), NOW), "path", "state")
    assert got == [("a", "in_sync"), ("b", "drifted")]


def items(spark, *rows):
    return spark.createDataFrame([(p, p, 1, None, v) for p, v in rows], SOURCE_ITEMS)


def test_sync_decisions(spark):
    entries = rows(
        spark, dict(path="same.md", version="v1"), dict(path="text.md", checksum="c2", version="v1"),
        dict(path="new-version.md", version="v1"), dict(path="no-version.md", checksum="c5"),
        dict(path="dead.md", version="v1", checksum="c6", deleted_at=OLD), dict(path="pruned.md"),
    )
    listed = items(
        spark, ("same.md", "v1"), ("text.md", "v2"), ("new-version.md", "v2"), ("brand-new.md", "v1"),
        ("no-version.md", None), ("dead.md", "v1"), ("broken.md", "v1"), ("silent.md", "v1"),
    )
    contents = spark.createDataFrame(
        [("text.md", "c2", None), ("new-version.md", "cX", None), ("brand-new.md", "c4", None), ("no-version.md", "c5", None),
         ("dead.md", "c6", None), ("broken.md", None, "boom")],
        "path string, checksum string, error string",
    )
    plan = upkeep.sync_plan(listed, entries, contents)
    assert dict(plan.select("path", "decision").collect()) == {
        "same.md": "skip_version", "text.md": "skip_checksum", "new-version.md": "ingest", "brand-new.md": "ingest",
        "no-version.md": "skip_checksum", "dead.md": "ingest", "broken.md": "failed", "silent.md": "failed",
    }
    gone = upkeep.prune(listed, entries)
    assert values(gone, "path") == [("pruned.md",)]
    assert upkeep.sync_report(plan, gone).first().asDict() == dict(ingested=3, skipped=3, deleted=1, failed=2)
    assert values(upkeep.sync_errors(plan), "message") == [("broken.md: boom",), ("silent.md: not fetched",)]


def test_change_sets(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    changes = spark.createDataFrame(
        [("a", 2, "upsert", 1), ("a", 3, "upsert", 5), ("b", None, "delete", 2), ("d", 4, "upsert", 3), ("e", 9, "upsert", 6), ("e", None, "delete", 7)],
        "k string, v int, op string, seq long",
    )
    assert values(upkeep.apply_changes(current, changes, ["k"])) == [("a", 3), ("c", 1), ("d", 4)]
    assert values(upkeep.missing_paths(current, changes, ["k"])) == [("c",)]
    assert records.scan_changes(changes, 5).count() == 2 and records.scan_changes(changes).count() == 6
    assert records.next_cursor(changes.where("seq > 99"), 4).first().cursor == 4


def test_expired_versions_against_a_loop(spark):
    rng = random.Random(5)
    data = [(f"k{rng.randint(0, 8)}", rng.randint(0, 40), n) for n in range(150)]
    df = spark.createDataFrame(data, "k string, at int, n int")
    got = {r.n for r in upkeep.expired_versions(df, ["k"], ["at", "n"], "at", F.lit(25)).collect()}
    want = set()
    for key in {d[0] for d in data}:
        line = sorted((d[1], d[2]) for d in data if d[0] == key)
        want |= {n for (_, n), after in zip(line, line[1:]) if after[0] < 25}
    assert got == want


def test_scratch_ttl_and_cutoffs(spark):
    listed = spark.createDataFrame(
        [("scratch/dev/bot/old", 1, "", None, NOW - timedelta(days=8)), ("scratch/dev/bot/new", 1, "", None, NOW - timedelta(days=6)),
         ("tenants/dev/ns/old", 1, "", None, NOW - timedelta(days=80))], OBJECTS,
    )
    assert values(upkeep.expired_scratch(listed, F.lit(NOW)), "key") == [("scratch/dev/bot/old",)]
    days = listed.select("key", F.datediff(F.lit(NOW), upkeep.superseded_cutoff(F.col("key"), F.lit(NOW))).alias("d"))
    assert dict(days.collect()) == {"scratch/dev/bot/old": 1, "scratch/dev/bot/new": 1, "tenants/dev/ns/old": 30}


def test_history_table(spark, tmp_path):
    path = str(tmp_path / "entries")
    assert history.read_history(spark, path, ENTRIES).count() == 0
    tables.upsert_entries(rows(spark, dict(path="a"), dict(path="b")), path, 1)
    now = history.current_entries(history.read_history(spark, path, ENTRIES))
    dead = tables.tombstones(now, rows(spark, dict(path="a"), dict(path="zzz")), NOW)
    for _ in range(2):  # a batch that runs again replaces itself
        tables.upsert_entries(dead, path, 2)
    now = history.current_entries(history.read_history(spark, path, ENTRIES))
    assert values(now, "path", F.col("deleted_at").isNotNull().alias("dead")) == [("a", True), ("b", False)]
    tables.upsert_entries(rows(spark, dict(path="a", size=9)), path, 3)  # revive
    now = history.current_entries(history.read_history(spark, path, ENTRIES))
    assert values(now.where("deleted_at is null"), "path", "size") == [("a", 9), ("b", 1)]
    assert values(tables.hard_delete(now, rows(spark, dict(path="a"))), "path") == [("b",)]


def test_pages_of_a_document_that_shrank(spark, make_pages, tmp_path):
    from shelfmark.schemas import PAGES

    path = str(tmp_path / "pages")
    bad = tables.write_pages(make_pages({"a": ["1", "2", "3"], "b": ["x"]}), path, 1)
    assert bad.count() == 0
    tables.write_pages(make_pages({"a": ["new"]}), path, 2)
    now = history.current_pages(history.read_history(spark, path, PAGES))
    assert values(now, "page", "text") == [(1, "new"), (1, "x")]
    over = make_pages({"a": ["1"]}).withColumn("page", F.lit(-1))
    assert [r.problem for r in tables.write_pages(over, path, 3).collect()] == ["bad_page"]


def test_a_writer_that_dies_leaves_the_batch_as_it_was(spark, make_pages, tmp_path):
    from shelfmark.schemas import PAGES

    path = str(tmp_path / "pages")
    old = make_pages({"a": ["old 1", "old 2"]})
    tables.write_pages(old, path, 7)
    begun = history.read_history(spark, path, PAGES)
    # The attempt is whole on disk, but its writer dies before the commit.
    lost = history.write_attempt(make_pages({"a": ["half"]}), path, 7, ("tenant_id", "namespace"))
    assert values(history.read_history(spark, path, PAGES), "text") == [("old 1",), ("old 2",)]
    assert history.vacuum(spark, path, 3600) == 0
    tables.write_pages(make_pages({"a": ["new"]}), path, 7)
    assert values(history.read_history(spark, path, PAGES), "text", "batch_id") == [("new", 7)]
    # Who began to read before the commit still can.
    assert values(begun, "text") == [("old 1",), ("old 2",)]
    assert history.vacuum(spark, path, -5) == 2
    assert lost not in history.snapshot(spark, path).values()
    assert values(history.read_history(spark, path, PAGES), "text") == [("new",)]
    assert [b for b, _, _ in history.commits(spark, path)] == [7, 7]


def test_two_writers_of_one_batch_leave_one(spark, make_pages, tmp_path):
    from shelfmark.schemas import PAGES

    path = str(tmp_path / "pages")
    attempts = [history.write_attempt(make_pages({"a": [t]}), path, 1, ("tenant_id", "namespace")) for t in ("one", "two")]
    for attempt in attempts:
        history.commit(spark, path, 1, attempt)
    assert values(history.read_history(spark, path, PAGES), "text") == [("two",)]


def test_pages_beyond_key_strings_are_stored(spark, make_pages, tmp_path):
    from shelfmark.schemas import PAGES

    path = str(tmp_path / "pages")
    long = make_pages({"a": ["text"]}).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(10_005))))
    assert tables.write_pages(long, path, 1).count() == 0
    assert history.read_history(spark, path, PAGES).agg(F.max("page")).first()[0] == 10_005


def test_a_replayed_batch_leaves_nothing_of_its_first_attempt(spark, make_pages, tmp_path):
    from shelfmark.schemas import PAGES

    path = str(tmp_path / "pages")
    both = make_pages({"a": ["1"]}).unionByName(make_pages({"b": ["2"]}, ns="other"))
    tables.write_pages(both, path, 1)
    tables.write_pages(make_pages({"a": ["new"]}), path, 1)
    assert values(history.read_history(spark, path, PAGES), "namespace", "text") == [("handbook", "new")]
    tables.write_pages(make_pages({"a": ["1"]}).limit(0), path, 1)
    assert history.read_history(spark, path, PAGES).count() == 0


def unique_names(named):
    """Names given out in order; a name already given gets its number before the suffix."""
    given = []
    for number, name in enumerate(named):
        if name in given:
            name = re.sub(r"(?=\.[^.]*$)|$", f"-{number}", name, count=1)
        given.append(name)
    return given


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_against_a_loop(spark, seed):
    rng = random.Random(seed)
    pool = ["a.md", "b", "a-1.md", "a-2.md", "a-3.md", "a-2-5.md", "b-4", "c/d.tar.gz", "b-4-6"]
    names = [rng.choice(pool) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(names)), "idx long, path string")
    got = [r.path for r in records.uniquify_paths(df).orderBy("idx").collect()]
    assert got == unique_names(names)


def test_records(spark):
    data = [
        (0, "t0", {"file_name": "", "url": "https://h.org/a/../b.md", "version": "7"}), (1, "t1", {}),
        (2, "t2", {"title": "h.org/a/b.md", "etag": "x"}), (3, "é", {"source": "../.."}),
    ]
    df = spark.createDataFrame(data, "idx long, text string, metadata map<string,string>")
    got = {int(r.locator): r for r in records.scan_records(df).collect()}
    assert [got[i].path for i in range(4)] == ["h.org/a/b.md", "doc-1.md", "h.org/a/b-2.md", "doc-3.md"]
    assert got[0].version == "version:7" and got[2].version == "etag:x"
    assert got[1].version.startswith("sha256:") and len(got[1].version) == 23
    assert got[3].size == 2


def test_folders_on_loops_and_under_two_parents(spark):
    """Against a walk by levels that never passes a folder twice."""
    rng = random.Random(11)
    for _ in range(6):
        edges = [(str(i), rng.choice(["root", *map(str, range(12)), "lost"])) for i in range(9)]
        edges += [(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(3)]
        edges += [(f"d{i}", f"d{i - 1}" if i else "root") for i in range(21)] + [("n", None), ("root", "3")]
        rows = [(i, f"<{i}>", up, records.FOLDER_TYPE) for i, up in edges]
        listing = spark.createDataFrame(rows, "id string, name string, parent_id string, mime_type string")
        want, level = [("root", "")], [("root", "", ("root",))]
        while level:
            level = [
                (i, f"{prefix}<{i}>/", (*trail, i))
                for up, prefix, trail in level for i, above in edges if above == up and i not in trail
            ]
            want += [(i, prefix) for i, prefix, _ in level]
        assert values(records.folder_paths(listing, "root"), "id", "prefix") == sorted(want)


def test_folder_table(spark):
    folder, doc = records.FOLDER_TYPE, "application/vnd.google-apps.document"
    listing = spark.createDataFrame(
        [("f1", "Top", "root", folder, None, None, None), ("f2", "Sub", "f1", folder, None, None, None),
         ("f3", "Deep", "f2", folder, None, None, None), ("d1", "Notes", "f3", doc, None, "5", "t"),
         ("d2", "Plan.docx", "root", doc, None, None, "t2"), ("d3", "pic.png", "f1", "image/png", "12", None, None),
         ("x", "lost", "nowhere", "image/png", "1", None, None)],
        "id string, name string, parent_id string, mime_type string, size string, version string, modified_time string",
    )
    got = values(records.scan_folder_table(listing), "path", "size", "version")
    assert got == [("Plan.docx", None, "t2"), ("Top/Sub/Deep/Notes.docx", None, "5"), ("Top/pic.png", 12, None)]
    assert ("Top/Sub/Deep/Notes.pdf",) in values(records.scan_folder_table(listing, export_pdf=True), "path")


def test_files_and_objects(spark, tmp_path):
    for name, body in {"a.md": b"0123456789", "sub/b.txt": b"bb", ".git/x": b"no", "sub/.hid": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    listed = files.scan_tree(spark, str(tmp_path))
    assert values(listed, "path", "size", "content_type") == [("a.md", 10, "text/markdown"), ("sub/b.txt", 2, "text/plain")]
    assert all(r.version.startswith("mtime:") and r.version.endswith(f":{r.size}") for r in listed.collect())
    got = files.fetch_tree(spark, str(tmp_path), listed.where("path = 'sub/b.txt'"))
    assert [bytes(r.content) for r in got.collect()] == [b"bb"]
    contents = files.stored_contents(spark, str(tmp_path))
    asked = spark.createDataFrame([("a.md", 2, 4), ("a.md", 7, None), ("none", 0, 1)], "key string, start int, end int")
    got = values(files.read_objects(contents, asked), "key", "start", F.decode("content", "UTF-8").alias("t"))
    assert got == [("a.md", 2, "234"), ("a.md", 7, "789"), ("none", 0, None)]
    stored = objects(spark, "z/", "z//k.md", "q.md", etag='"t"')
    assert values(files.scan_prefix(stored, "tenants/dev/ns/z"), "path", "version") == [("k.md", "t")]
    rest, gone = tables.delete_prefix(stored, "tenants/dev/ns/z")
    assert rest.count() == 1 and gone.first().deleted == 2


def test_messages(spark):
    bodies = [
        {"detail": {"object": {"key": "tenants/dev/ns/a%20b.md"}}},
        {"Records": [{"s3": {"object": {"key": "tenants/dev/ns/x+y.md"}}}, {"s3": {}}]},
        {"detail": {"object": {"key": "k1"}}, "Records": [{"s3": {"object": {"key": "bad%zz+1"}}}]},
        {}, {"detail": "text"},
    ]
    data = [(str(i), json.dumps(b)) for i, b in enumerate(bodies)] + [("9", "not-json")]
    df = spark.createDataFrame(data, "message_id string, body string")
    got = values(messages.parse_object_events(df))
    assert got == [("0", "tenants/dev/ns/a b.md"), ("1", "tenants/dev/ns/x y.md"), ("2", "bad%zz 1"), ("2", "k1")]
    assert values(messages.malformed_messages(df), "message_id") == [("9",)]


def fold(rows, quota):
    used, out = {}, []
    for t, p, seq, delta in sorted(rows):
        now = used.get((t, p), 0)
        ok = not (delta > 0 and now + delta > quota)
        used[t, p] = now + delta if ok else now
        out.append((t, p, seq, delta, ok, used[t, p]))
    return out


@pytest.mark.parametrize("quota,blocks", [(100, 7), (1000, 16), (10, 1)])
def test_quota_replay_against_a_loop(spark, quota, blocks):
    rng = random.Random(quota)
    # One principal holds most rows, so it spans many blocks.
    data = [("dev", "hot" if rng.random() < 0.7 else f"p{rng.randint(0, 9)}", n, rng.randint(-40, 60)) for n in range(3000)]
    df = spark.createDataFrame(data, "tenant_id string, principal_id string, seq long, delta_bytes long")
    got = sorted(tuple(r) for r in ledger.quota_replay(df, quota, blocks=blocks).collect())
    assert got == fold(data, quota)
    report = {r.principal_id: (r.bytes_used, r.admitted, r.rejected) for r in ledger.quota_report(ledger.quota_replay(df, quota)).collect()}
    hot = [g for g in got if g[1] == "hot"]
    assert report["hot"] == (hot[-1][5], sum(g[4] for g in hot), sum(not g[4] for g in hot))


@pytest.mark.parametrize("quota,most", [(10**9, 1), (100, 8)])
def test_quota_blocks_settle(spark, monkeypatch, quota, most):
    """One principal over eight blocks: no block folds again without rejections, and a
    chain of rejecting blocks settles one per round."""
    rounds = []
    plain = ledger._Fold

    def counted(limit, starts):
        rounds.append(len(starts))
        return plain(limit, starts)

    monkeypatch.setattr(ledger, "_Fold", counted)
    rng = random.Random(9)
    data = [("d", "p", n, rng.randint(-40, 60)) for n in range(4000)]
    df = spark.createDataFrame(data, "tenant_id string, principal_id string, seq long, delta_bytes long")
    got = sorted(tuple(r) for r in ledger.quota_replay(df, quota, blocks=8).collect())
    assert got == fold(data, quota)
    assert len(rounds) - 1 <= most


def test_quota_literals(spark):
    df = spark.createDataFrame([("d", "p", 1, 60), ("d", "p", 2, 60), ("d", "p", 3, -10), ("d", "p", 4, 50)],
                               "tenant_id string, principal_id string, seq long, delta_bytes long")
    got = [(r.admitted, r.usage_after) for r in ledger.quota_replay(df, 100).orderBy("seq").collect()]
    assert got == [(True, 60), (False, 60), (True, 50), (True, 100)]


def test_scratch_state(spark):
    log = spark.createDataFrame(
        [("d", "p", "a", 1, "write", 5), ("d", "p", "a", 2, "write", 2), ("d", "p", "b", 3, "write", 7), ("d", "p", "b", 4, "delete", None), ("d", "q", "a", 5, "write", 1)],
        "tenant_id string, principal_id string, path string, seq long, op string, size long",
    )
    state = ledger.scratch_state(log)
    assert values(state) == [("d", "p", "a", 2), ("d", "q", "a", 1)]
    assert values(ledger.scratch_state_usage(state), "principal_id", "bytes_used", "objects_used") == [("p", 2, 1), ("q", 1, 1)]
    assert values(ledger.scratch_list(state, "a"), "principal_id", "path") == [("p", "a"), ("q", "a")]


def test_running_sum_spans_blocks(spark):
    from shelfmark.operators.blocks import with_rank, with_running_sum

    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.8 else f"g{rng.randint(0, 5)}", n, rng.randint(-5, 9)) for n in range(2000)]
    df = spark.createDataFrame(data, "g string, n int, v int")
    want, sums, ranks = {}, {}, {}
    for g, n, v in sorted(data):
        sums[g], ranks[g] = sums.get(g, 0) + v, ranks.get(g, 0) + 1
        want[n] = (sums[g], ranks[g])
    got = {r.n: r.total for r in with_running_sum(df, ["g"], ["n"], "v", "total").collect()}
    assert got == {n: w[0] for n, w in want.items()}
    got = {r.n: r["rank"] for r in with_rank(df, ["g"], ["n"]).collect()}
    assert got == {n: w[1] for n, w in want.items()}


@pytest.mark.parametrize("periods", [1, 2, 3])
def test_alarm_changes_against_a_loop(spark, periods):
    rng = random.Random(periods)
    start = datetime(2026, 1, 1)
    data = [(m, start + timedelta(minutes=5 * i, seconds=rng.randint(0, 299)), rng.choice([0, 1])) for m in "ab" for i in range(80) if rng.random() < 0.8]
    data.append(("a", start + timedelta(minutes=400), 0))
    df = spark.createDataFrame(data, "m string, ts timestamp, v int")
    windows = alarms.alarm_windows(df, "m", "ts", F.col("v"))
    got = values(alarms.alarm_changes(windows, "m", F.col("stat") >= 1, periods), "m", "period_start", "state")
    want = []
    for m in "ab":
        bad = {int((t - start).total_seconds() // 300) for k, t, v in data if k == m and v}
        on = False
        for i in range(81):
            alarm = all(i - j in bad for j in range(periods))
            if alarm != on:
                want.append((m, start + timedelta(minutes=5 * i), "ALARM" if alarm else "OK"))
            on = alarm
    assert got == sorted(want, key=lambda r: tuple(map(str, r)))
    with pytest.raises(ValueError):
        alarms.alarm_windows(df, "m", "ts", F.col("v"), "median")


def test_dimension_and_checkpoints(spark):
    cursors = spark.createDataFrame([("d", "c", "1", OLD), ("d", "c", "2", NOW), ("d", "k", "9", OLD)], "tenant_id string, connector_id string, cursor string, updated_at timestamp")
    assert values(tables.get_checkpoint(cursors), "connector_id", "cursor") == [("c", "2"), ("k", "9")]
    tenants = spark.createDataFrame([("a", "x"), ("b", "y")], "tenant_id string, name string")
    changes = spark.createDataFrame([("a", "z", "upsert", 1), ("b", None, "delete", 2)], "tenant_id string, name string, op string, seq long")
    assert values(tables.upsert_dimension(tenants, changes, ["tenant_id"])) == [("a", "z")]
    assert CHANGES.names[:2] == ["seq", "op"] and keys.PARSED.names[0] == "channel"
