"""Scratch usage, quota admission, alarms and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms, ledger
from ..session import scratch_path
from ..streaming import jobs, state
from . import corpus as c
from .registry import Registry

queries = Registry()

QUOTA = 400

LEDGER = """
ledger AS (
  SELECT 'acme' AS tenant_id, 'u' || user_id AS principal_id, event_id AS seq,
         CASE WHEN event_type = 'view' THEN -1 ELSE 1 END * CAST(floor(value) AS BIGINT) AS delta_bytes,
         CASE WHEN event_type = 'view' THEN -1 ELSE 1 END AS delta_objects FROM events)"""


def ledger_rows(spark, d):
    sign = F.when(F.col("event_type") == "view", -1).otherwise(1)
    return c.table(spark, d, "events").select(
        F.lit("acme").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principal_id"),
        F.col("event_id").alias("seq"),
        (sign * F.floor("value")).cast("long").alias("delta_bytes"),
        sign.alias("delta_objects"),
    )


@queries.add(
    "scratch_usage",
    "WITH " + LEDGER + """
SELECT tenant_id, principal_id, sum(delta_bytes)::BIGINT AS bytes_used, sum(delta_objects)::BIGINT AS objects_used FROM ledger GROUP BY ALL""",
)
def _usage(spark, d):
    return ledger.scratch_usage(ledger_rows(spark, d))


SCRATCH = """
files AS (
  SELECT * FROM (
    SELECT 'acme' AS tenant_id, 'u' || user_id AS principal_id, 'notes/' || json_extract_string(props, '$.k') || '.txt' AS path,
           CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op, CAST(floor(value * 100) AS BIGINT) AS size,
           row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS rk FROM events)
  WHERE rk = 1 AND op = 'write')"""


def scratch_log(spark, d):
    return c.table(spark, d, "events").select(
        F.lit("acme").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principal_id"),
        F.concat(F.lit("notes/"), F.get_json_object("props", "$.k"), F.lit(".txt")).alias("path"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"),
        F.floor(F.col("value") * 100).cast("long").alias("size"),
    )


@queries.add("scratch_state", "WITH " + SCRATCH + " SELECT tenant_id, principal_id, path, size FROM files")
def _state(spark, d):
    return ledger.scratch_state(scratch_log(spark, d))


@queries.add(
    "scratch_state_usage",
    "WITH " + SCRATCH + " SELECT tenant_id, principal_id, sum(size)::BIGINT AS bytes_used, count(*) AS objects_used FROM files GROUP BY ALL",
)
def _state_usage(spark, d):
    return ledger.scratch_state_usage(ledger.scratch_state(scratch_log(spark, d)))


@queries.add(
    "scratch_list",
    "WITH " + SCRATCH + """
SELECT tenant_id, principal_id, path, n > 5 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY principal_id ORDER BY path) AS pk, count(*) OVER (PARTITION BY principal_id) AS n
  FROM files WHERE starts_with(path, 'notes/1')) WHERE pk <= 5""",
)
def _list(spark, d):
    rows = ledger.scratch_list(ledger.scratch_state(scratch_log(spark, d)), "notes/1", 5)
    return rows.select("tenant_id", "principal_id", "path", "truncated")


@queries.add(
    "scratch_all",
    "WITH " + SCRATCH + c.in_pages("(SELECT tenant_id, principal_id, path, size FROM files)", "path", 5, "tenant_id, principal_id"),
)
def _list_all(spark, d):
    return ledger.scratch_pages(ledger.scratch_state(scratch_log(spark, d)), size=5)


REPLAY = "WITH RECURSIVE " + LEDGER + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY principal_id ORDER BY seq) AS n FROM ledger),
walk AS (
  SELECT tenant_id, principal_id, seq, delta_bytes, n, NOT (delta_bytes > 0 AND delta_bytes > {QUOTA}) AS admitted,
         CASE WHEN delta_bytes > 0 AND delta_bytes > {QUOTA} THEN 0 ELSE delta_bytes END AS usage_after FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.tenant_id, b.principal_id, b.seq, b.delta_bytes, b.n, NOT (b.delta_bytes > 0 AND w.usage_after + b.delta_bytes > {QUOTA}),
         CASE WHEN b.delta_bytes > 0 AND w.usage_after + b.delta_bytes > {QUOTA} THEN w.usage_after ELSE w.usage_after + b.delta_bytes END
  FROM walk w JOIN numbered b ON b.principal_id = w.principal_id AND b.n = w.n + 1)"""


@queries.add("quota_replay", REPLAY + " SELECT tenant_id, principal_id, seq, delta_bytes, admitted, usage_after FROM walk")
def _replay(spark, d):
    return ledger.quota_replay(ledger_rows(spark, d), QUOTA)


@queries.add(
    "quota_report",
    REPLAY + """ SELECT tenant_id, principal_id, sum(CASE WHEN admitted THEN delta_bytes ELSE 0 END)::BIGINT AS bytes_used,
  count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS rejected FROM walk GROUP BY ALL""",
)
def _quota_report(spark, d):
    return ledger.quota_report(ledger.quota_replay(ledger_rows(spark, d), QUOTA))


# --- alarms --------------------------------------------------------------------

WINDOWS = """
windows AS (
  SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, sum(CAST(floor(value) AS BIGINT))::BIGINT AS stat, count(*) AS samples
  FROM events GROUP BY ALL)"""


def windows(spark, d):
    events = c.table(spark, d, "events")
    return alarms.alarm_windows(events, "event_type", "ts", F.floor("value").cast("long"))


def _shown(rows):
    return rows.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm:ss"))


STAMP = "strftime(period_start, '%Y-%m-%d %H:%M:%S') AS period_start"


@queries.add("alarm_windows", f"WITH {WINDOWS} SELECT event_type, {STAMP}, stat, samples FROM windows")
def _windows(spark, d):
    return _shown(windows(spark, d))


@queries.add(
    "alarm_peaks",
    f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, max(value) AS stat, count(*) AS samples FROM events GROUP BY ALL)
SELECT event_type, {STAMP}, stat, samples FROM w""",
)
def _peaks(spark, d):
    return _shown(alarms.alarm_windows(c.table(spark, d, "events"), "event_type", "ts", F.col("value"), "max"))


@queries.add(
    "alarm_changes",
    f"""WITH {WINDOWS}, spine AS (
  SELECT t.event_type, p.period_start FROM (SELECT DISTINCT event_type FROM events) t,
    (SELECT unnest(range(min(period_start), max(period_start) + INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS period_start FROM windows) p),
judged AS (
  SELECT s.event_type, s.period_start, CASE WHEN w.stat > 30 THEN 1 ELSE 0 END AS breach
  FROM spine s LEFT JOIN windows w ON w.event_type = s.event_type AND w.period_start = s.period_start),
firing AS (
  SELECT *, sum(breach) OVER (PARTITION BY event_type ORDER BY period_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alarm FROM judged),
turns AS (SELECT *, lag(alarm, 1, false) OVER (PARTITION BY event_type ORDER BY period_start) AS was FROM firing)
SELECT event_type, {STAMP}, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state FROM turns WHERE alarm <> was""",
)
def _changes(spark, d):
    turns = alarms.alarm_changes(windows(spark, d), "event_type", F.col("stat") > 30, periods=2)
    return _shown(turns)


# --- streams -------------------------------------------------------------------


def drain(spark, stream, label: str, mode: str, schema, at: tuple[str, str] | None = None):
    """Run a stream over everything there is and read back what it wrote, now and before ``at`` the same places."""
    out, checkpoint = at or (scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-checkpoint"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).select(schema.names)


def event_stream(spark, d):
    schema = c.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@queries.add(
    "alarm_stream",
    f"""WITH {WINDOWS} SELECT event_type, {STAMP}, stat, samples FROM windows""",
)
def _alarm_stream(spark, d):
    stream = jobs.alarm_stream(
        event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")),
        "event_type", "ts", F.floor("value").cast("long"),
    )
    # Update mode writes a period again when it grew; its largest count is the last one.
    out = drain(spark, stream, "alarms", "update", stream.schema)
    newest = out.groupBy("event_type", "period_start").agg(F.max(F.struct("samples", "stat")).alias("_n"))
    return _shown(newest.select("event_type", "period_start", "_n.stat", "_n.samples"))


@queries.add("quota_stream", REPLAY + " SELECT tenant_id, principal_id, seq, delta_bytes, admitted, usage_after FROM walk")
def _quota_stream(spark, d):
    sign = F.when(F.col("event_type") == "view", -1).otherwise(1)
    rows = event_stream(spark, d).select(
        F.lit("acme").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("principal_id"),
        F.col("event_id").alias("seq"),
        (sign * F.floor("value")).cast("long").alias("delta_bytes"),
    )
    return drain(spark, jobs.quota_stream(rows, QUOTA), "quota", "append", jobs.QUOTA_OUTPUT)


# --- streams with keyed state ------------------------------------------------------


def in_turns(spark, rows, order: str, build, label: str, files: int = 4):
    """Everything that the stream ``build(source)`` writes over ``rows`` put into files in order of ``order``,
    a trigger a file; the stream is stopped before the last file comes and started anew from its checkpoint."""
    inbox, at = scratch_path(spark, f"{label}-in"), (scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-checkpoint"))
    spark.conf.set(jobs.STATE_STORE, jobs.ROCKS_DB)
    number = F.col(order).cast("double")
    cuts = rows.select(F.percentile_approx(number, [i / files for i in range(1, files)])).first()[0] or []
    edges = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        above = F.lit(True) if low is None else number > low
        part = rows.where(above & (F.lit(True) if high is None else number <= high))
        part.coalesce(1).write.mode("append").parquet(inbox)
        if n >= len(edges) - 3:
            source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
            stream = build(source)
            out = drain(spark, stream, label, "append", stream.schema, at)
    return out


@queries.add(
    "delivery_counts",
    """WITH gaps AS (
  SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh, row_number() OVER w AS k FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
spells AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY k) AS spell FROM gaps),
counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, spell ORDER BY k) AS n FROM spells)
SELECT 'u' || user_id AS message_id, CASE WHEN n > 5 THEN 'dead' ELSE 'delivery' END AS kind, n FROM counted
UNION ALL SELECT 'u' || user_id, 'expired', max(n) FROM counted GROUP BY user_id, spell
HAVING max(n) > 5 AND (max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)""",
)
def _delivery_counts(spark, d):
    """Every event as one more delivery of its user's message, forgotten after half a day of silence."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("message_id")
    rows = c.table(spark, d, "events").select(user, F.col("event_type").alias("body"), F.col("ts").cast("timestamp").alias("ts"))
    out = in_turns(spark, rows, "ts", lambda s: state.count_deliveries(s, "ts", keep_days=0.5), "deliveries")
    return out.select("message_id", "kind", "n")


@queries.add(
    "changed_objects",
    """SELECT 'o' || user_id AS key, arg_max(event_type, ts) AS etag, epoch_us(min(ts)) // 1000 AS first FROM events GROUP BY user_id""",
)
def _changed_objects(spark, d):
    """Events as new versions of a user's object; the last one reported is what it is now."""
    rows = c.table(spark, d, "events").select(
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("etag"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("size"), F.lit("text/plain").alias("content_type"),
    )
    out = in_turns(spark, rows, "ts", lambda s: state.changed_objects(s, "ts"), "objects")
    return out.groupBy("key").agg(F.max_by("etag", "at").alias("etag"), F.min(F.unix_millis("first")).alias("first"))


@queries.add(
    "alarm_timers",
    f"""WITH {WINDOWS}, spine AS (
  SELECT t.event_type, p.period_start FROM (SELECT DISTINCT event_type FROM events) t,
    (SELECT unnest(range(min(period_start), max(period_start) + INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS period_start FROM windows) p),
firing AS (
  SELECT s.event_type, s.period_start, coalesce(w.stat, 0) > 30 AND lag(coalesce(w.stat, 0), 1, 0) OVER (PARTITION BY s.event_type ORDER BY s.period_start) > 30 AS alarm
  FROM spine s LEFT JOIN windows w ON w.event_type = s.event_type AND w.period_start = s.period_start),
turns AS (SELECT *, lag(alarm, 1, false) OVER (PARTITION BY event_type ORDER BY period_start) AS was FROM firing)
SELECT event_type, {STAMP}, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state FROM turns
WHERE alarm <> was AND period_start + INTERVAL 15 MINUTE < (SELECT max(ts) FROM events)""",
)
def _alarm_timers(spark, d):
    """The turns of ``alarm_changes`` as far as the watermark has come, by timers in a stream."""
    rows = c.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = in_turns(
        spark, rows, "ts",
        lambda s: state.alarm_timers(s, "event_type", "ts", F.floor("value").cast("long"), 30, periods=2), "timers",
    )
    return _shown(out.select(F.col("metric").alias("event_type"), F.col("at").alias("period_start"), F.col("kind").alias("state")))
