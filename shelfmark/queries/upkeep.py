"""Reconcile, sync, history, retention and source-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, paths
from ..operators import upkeep
from ..session import scratch_path
from ..sinks import history
from ..sinks import tables as sink
from ..sources import files, messages, records
from . import corpus as c
from .registry import Registry

queries = Registry()


# --- reconcile -----------------------------------------------------------------

STATES = c.with_views(c.ENTRIES, c.CATALOG) + f""", states AS (
  SELECT coalesce(e.tenant_id, k.tenant_id) AS tenant_id, coalesce(e.namespace, k.namespace) AS namespace, coalesce(e.path, k.path) AS path,
         CASE WHEN e.path IS NOT NULL AND k.path IS NULL THEN 'new' WHEN e.path IS NOT NULL AND k.dead THEN 'revived'
              WHEN e.path IS NOT NULL AND k.etag <> e.etag THEN 'drifted' WHEN e.path IS NOT NULL THEN 'in_sync'
              WHEN k.dead THEN 'gone' WHEN k.updated_at > TIMESTAMP '2024-01-01' + to_seconds(1800 - 900) THEN 'fresh' ELSE 'orphaned' END AS state,
         e.path IS NOT NULL AS has_object, coalesce(NOT k.dead, false) AS has_live_row
  FROM entries e FULL OUTER JOIN catalog k ON k.tenant_id = e.tenant_id AND k.namespace = e.namespace AND k.path = e.path)"""
ACTION = "CASE WHEN state IN ('new', 'revived', 'drifted') THEN 'enqueue' WHEN state = 'orphaned' THEN 'tombstone' ELSE 'none' END"


def states(spark, d):
    return upkeep.reconcile_states(
        c.stored_objects(spark, d), c.drifted_catalog(spark, d), F.timestamp_seconds(F.lit(c.SWEEP_AT))
    )


@queries.add(
    "reconcile_actions",
    STATES + f" SELECT tenant_id, namespace, path, state, {ACTION} AS action, has_object, has_live_row FROM states",
)
def _actions(spark, d):
    return states(spark, d)


@queries.add(
    "reconcile_report",
    STATES + f"""
SELECT count(DISTINCT tenant_id || '/' || namespace) AS namespaces, count(*) FILTER (has_object) AS objects, count(*) FILTER (has_live_row) AS live_rows,
       count(*) FILTER ({ACTION} = 'enqueue') AS enqueued, count(*) FILTER ({ACTION} = 'tombstone') AS tombstoned,
       count(*) FILTER (state = 'in_sync') AS in_sync FROM states""",
)
def _report(spark, d):
    return upkeep.reconcile_report(states(spark, d))


# --- sync ----------------------------------------------------------------------

SYNC = c.with_views(c.ENTRIES) + """, plan AS (
  SELECT e.path, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'skip_version' WHEN contains(e.text, '@') THEN 'failed'
                      WHEN l.quality = 0 AND l.toxic = 0 THEN 'skip_checksum' ELSE 'ingest' END AS decision
  FROM entries e LEFT JOIN labels l ON l.doc_id = e.doc_id)"""


def source_items(spark, d):
    docs = c._identity(c.table(spark, d, "documents"))
    return docs.select(
        "path",
        F.col("doc_id").cast("string").alias("locator"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit(None).cast("string").alias("content_type"),
        F.concat(F.lit("v"), F.col("n_chars").cast("string")).alias("version"),
    )


def fetched(spark, d):
    """Content hashes of the source; texts with an address cannot be fetched."""
    docs = c._identity(c.table(spark, d, "documents"))
    return docs.select(
        "path",
        paths.checksum(F.col("text")).alias("checksum"),
        F.when(F.contains("text", F.lit("@")), "unreadable").alias("error"),
    )


def known_rows(spark, d):
    """What the catalog knows of the source: labelled documents, and benchmark items
    that the source no longer has."""
    docs = c._identity(c.table(spark, d, "documents")).withColumn("_sum", paths.checksum(F.col("text")))
    labelled = docs.drop("text").join(c.table(spark, d, "labels"), "doc_id")
    toxic = F.col("toxic") == 1
    good = (F.col("quality") == 1) & ~toxic
    rows = labelled.select(
        "path",
        F.when(toxic, "stale").otherwise(F.col("_sum")).alias("checksum"),
        F.when(good, F.concat(F.lit("v"), F.col("n_chars").cast("string"))).otherwise("old").alias("_v"),
    ).union(
        c.table(spark, d, "benchmark").select(
            F.concat(F.lit("lost/"), F.col("item_id").cast("string")), F.lit("x"), F.lit("old")
        )
    )
    return rows.select(
        "path",
        paths.entry_id(F.lit("acme"), F.lit("src"), F.col("path")).alias("entry_id"),
        "checksum",
        F.struct(F.lit("docs").alias("connector_id"), F.col("path").alias("remote_id"), F.col("_v").alias("version")).alias("source"),
        F.timestamp_seconds(F.lit(c.EPOCH)).alias("created_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def plan(spark, d):
    return upkeep.sync_plan(source_items(spark, d), known_rows(spark, d), fetched(spark, d))


@queries.add("sync_plan", SYNC + " SELECT path, decision, CASE WHEN decision = 'failed' THEN 'unreadable' END AS error FROM plan")
def _plan(spark, d):
    return plan(spark, d).select("path", "decision", "error")


@queries.add(
    "sync_report",
    SYNC + """ SELECT count(*) FILTER (decision = 'ingest') AS ingested, count(*) FILTER (decision LIKE 'skip%') AS skipped,
  (SELECT count(*) FROM benchmark) AS deleted, count(*) FILTER (decision = 'failed') AS failed FROM plan""",
)
def _sync_report(spark, d):
    gone = upkeep.prune(source_items(spark, d), known_rows(spark, d))
    return upkeep.sync_report(plan(spark, d), gone)


@queries.add("sync_errors", SYNC + " SELECT path, path || ': unreadable' AS message FROM plan WHERE decision = 'failed'")
def _sync_errors(spark, d):
    return upkeep.sync_errors(plan(spark, d))


@queries.add("prune", "SELECT 'lost/' || item_id AS path FROM benchmark")
def _prune(spark, d):
    return upkeep.prune(source_items(spark, d), known_rows(spark, d)).select("path")


# Events as a change feed of user records: an error deletes the record.
CHANGES = """
changes AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_type AS state FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rk FROM changes) WHERE rk = 1)"""


def changes(spark, d):
    return c.table(spark, d, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("event_type").alias("state"),
    )


@queries.add(
    "apply_changes",
    "WITH " + CHANGES + """
SELECT c_custkey AS user_id, 'old' AS state FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)
UNION ALL SELECT user_id, state FROM last WHERE op = 'upsert'""",
)
def _apply(spark, d):
    current = c.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("old").alias("state")
    )
    return upkeep.apply_changes(current, changes(spark, d), ["user_id"])


@queries.add(
    "scan_changes",
    "SELECT count(*) AS changes, max(event_id) AS cursor FROM events WHERE event_id > 500",
)
def _scan_changes(spark, d):
    rest = records.scan_changes(changes(spark, d), 500)
    return records.next_cursor(rest, 500)


# --- history and retention -----------------------------------------------------


@queries.add(
    "latest_version",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders) WHERE rk = 1""",
)
def _latest(spark, d):
    history = c.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return upkeep.latest_version(history, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@queries.add(
    "tree_version",
    "SELECT o_orderstatus AS tenant_id, o_orderpriority AS namespace, count(*) AS writes, max(o_orderkey) AS last_seq FROM orders GROUP BY ALL",
)
def _tree_version(spark, d):
    return upkeep.tree_version(
        c.table(spark, d, "orders").select(
            F.col("o_orderstatus").alias("tenant_id"),
            F.col("o_orderpriority").alias("namespace"),
            F.col("o_orderkey").alias("seq"),
        )
    )


@queries.add(
    "retention",
    """WITH v AS (
  SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 7 ELSE 30 END AS days,
         lead(o_orderdate) OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_at
  FROM orders)
SELECT o_custkey, o_orderkey FROM v WHERE superseded_at < TIMESTAMP '1997-01-01' - to_days(days)""",
)
def _retention(spark, d):
    area = F.when(F.col("o_orderstatus") == "F", "scratch").when(F.col("o_orderstatus") == "O", "derived").otherwise("tenants")
    history = c.table(spark, d, "orders").select(
        F.concat_ws("/", area, F.col("o_custkey").cast("string")).alias("key"),
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    )
    now = F.to_timestamp(F.lit("1997-01-01"))
    cutoff = upkeep.superseded_cutoff(F.col("key"), now)
    gone = upkeep.expired_versions(history, ["key"], ["o_orderdate", "o_orderkey"], "o_orderdate", cutoff)
    return gone.select("o_custkey", "o_orderkey")


def scratch_objects(spark, d):
    """Each event leaves a file in its user's scratch space; purchases are originals."""
    owner = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".txt"))
    key = F.when(
        F.col("event_type") == "purchase", keys.originals_key(F.lit("acme"), owner, name)
    ).otherwise(keys.scratch_key(F.lit("acme"), owner, name))
    return c.table(spark, d, "events").select(
        key.alias("key"),
        F.floor("value").cast("long").alias("size"),
        F.lit("").alias("etag"),
        F.col("ts").cast("timestamp").alias("last_modified"),
    )


@queries.add(
    "scratch_ttl",
    """SELECT 'scratch/acme/u' || user_id || '/e' || event_id || '.txt' AS key, floor(value)::BIGINT AS size FROM events
WHERE event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY""",
)
def _ttl(spark, d):
    gone = upkeep.expired_scratch(scratch_objects(spark, d), F.to_timestamp(F.lit("2024-01-20")))
    return gone.select("key", "size")


@queries.add(
    "delete_prefix",
    "SELECT count(*) AS deleted FROM events WHERE event_type <> 'purchase' AND starts_with(CAST(user_id AS VARCHAR), '1')",
)
def _delete_prefix(spark, d):
    return sink.delete_prefix(scratch_objects(spark, d), "scratch/acme/u1")[1]


@queries.add(
    "delete_documents",
    c.with_views(c.ENTRIES, c.LINES) + """, asked AS (SELECT * FROM entries WHERE namespace = 'de')
SELECT 'tombstones' AS what, count(*) AS n FROM asked WHERE NOT deleted
UNION ALL SELECT 'pages', count(DISTINCT entry_id || '/' || page) FROM doc_lines WHERE namespace <> 'de' OR deleted
UNION ALL SELECT 'objects', count(*) FROM entries WHERE namespace <> 'de'""",
)
def _delete_documents(spark, d):
    entries = c.entries(spark, d)
    asked = entries.where("namespace = 'de'")
    dead, pages, objects = sink.delete_documents(
        entries, c.pages(spark, d), c.stored_objects(spark, d), asked, F.timestamp_seconds(F.lit(c.SWEEP_AT))
    )
    parts = [("tombstones", dead), ("pages", pages), ("objects", objects)]
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts]
    return counted[0].union(counted[1]).union(counted[2])


@queries.add(
    "set_extraction",
    c.with_views(c.ENTRIES) + """
SELECT path, 'extracted' AS status, 'updated' AS outcome FROM entries WHERE NOT deleted AND status = 'catalog_only'
UNION ALL SELECT 'items/' || item_id, 'extracted', 'missing' FROM benchmark""",
)
def _set_extraction(spark, d):
    entries = c.entries(spark, d)
    done = F.struct(
        F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("reason"),
        F.lit(1).alias("page_count"), F.lit("x").alias("text_checksum"), F.lit("pdf").alias("extractor"),
    )
    asked = entries.where("extraction.status = 'catalog_only' AND deleted_at IS NULL").select("tenant_id", "namespace", "path")
    lost = c.table(spark, d, "benchmark").select(
        F.lit("acme").alias("tenant_id"), F.lit("lost").alias("namespace"),
        F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("path"),
    )
    updated, missing = sink.set_extraction(
        entries, asked.union(lost).withColumn("extraction", done), F.timestamp_seconds(F.lit(c.SWEEP_AT))
    )
    return updated.select("path", F.col("extraction.status").alias("status"), F.lit("updated").alias("outcome")).union(
        missing.select("path", F.col("extraction.status"), F.lit("missing"))
    )


CURSORS = """SELECT event_type AS tenant_id, CAST(user_id AS VARCHAR) AS connector_id, max_by(CAST(event_id AS VARCHAR), ts) AS cursor FROM events GROUP BY ALL"""


def cursor_puts(spark, d):
    return c.table(spark, d, "events").select(
        F.col("event_type").alias("tenant_id"), F.col("user_id").cast("string").alias("connector_id"),
        F.col("event_id").cast("string").alias("cursor"), F.col("ts").alias("updated_at"),
    )


@queries.add("checkpoints", CURSORS)
def _checkpoints(spark, d):
    return sink.get_checkpoint(cursor_puts(spark, d)).drop("updated_at")


@queries.add("checkpoints_stored", CURSORS)
def _checkpoints_stored(spark, d):
    """Cursors stored in two batches, the first of them twice, and read back."""
    puts, path = cursor_puts(spark, d), scratch_path(spark, "cursors")
    early = F.pmod(F.xxhash64("cursor"), F.lit(2)) == 0
    for batch_id, rows in ((0, puts.where(early)), (1, puts.where(~early)), (0, puts.where(early))):
        sink.put_checkpoint(rows, path, batch_id)
    return sink.get_checkpoint(history.read_history(spark, path, puts.schema)).drop("updated_at")


@queries.add("hard_delete", c.with_views(c.ENTRIES) + " SELECT tenant_id, namespace, path FROM entries WHERE NOT deleted")
def _hard_delete(spark, d):
    entries = c.entries(spark, d)
    dead = entries.where(F.col("deleted_at").isNotNull())
    return sink.hard_delete(entries, dead).select("tenant_id", "namespace", "path")


@queries.add(
    "upsert_dimension",
    "WITH " + CHANGES + """
SELECT s_suppkey AS user_id, 'known' AS state FROM supplier WHERE s_suppkey NOT IN (SELECT user_id FROM last)
UNION ALL SELECT user_id, state FROM last WHERE op = 'upsert'""",
)
def _dimension(spark, d):
    current = c.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("known").alias("state"))
    return sink.upsert_dimension(current, changes(spark, d), ["user_id"])


# --- sources -------------------------------------------------------------------


@queries.add(
    "record_paths",
    r"""WITH r AS (
  SELECT page_id, html, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare, split_part(regexp_replace(url, '[?#].*', ''), '/', 3) AS host FROM pages),
named AS (SELECT *, host || '/index.html' AS natural_path FROM r)
SELECT CASE WHEN page_id = min(page_id) OVER (PARTITION BY natural_path) THEN natural_path
            ELSE host || '/index-' || page_id || '.html' END AS path,
       CAST(page_id AS VARCHAR) AS locator, CAST(strlen(html) AS BIGINT) AS size, 'text/markdown' AS content_type,
       'sha256:' || substr(sha256(html), 1, 16) AS version FROM named""",
)
def _records(spark, d):
    site = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0), F.lit("/../index.html"))
    rows = c.table(spark, d, "pages").select(
        F.col("page_id").alias("idx"), F.col("html").alias("text"),
        F.create_map(F.lit("url"), site, F.lit("file_name"), F.lit("")).alias("metadata"),
    )
    return records.scan_records(rows)


def folder_listing(spark, d):
    """Regions hold nations, nations hold suppliers (documents) and customers (files)."""
    text = lambda col: F.col(col).cast("string")
    none = F.lit(None).cast("string")
    shape = ["id", "name", "parent_id", "mime_type", "size", "version", "modified_time"]

    def rows(name, ident, label, parent, mime, version=none):
        return c.table(spark, d, name).select(
            ident.alias("id"), label.alias("name"), parent.alias("parent_id"), F.lit(mime).alias("mime_type"),
            none.alias("size"), version.alias("version"), F.lit("2024").alias("modified_time"),
        ).select(shape)

    return (
        rows("region", F.concat(F.lit("r"), text("r_regionkey")), F.col("r_name"), F.lit("root"), records.FOLDER_TYPE)
        .union(rows("nation", F.concat(F.lit("n"), text("n_nationkey")), F.col("n_name"),
                    F.concat(F.lit("r"), text("n_regionkey")), records.FOLDER_TYPE))
        .union(rows("supplier", F.concat(F.lit("s"), text("s_suppkey")), F.col("s_name"),
                    F.concat(F.lit("n"), text("s_nationkey")), "application/vnd.google-apps.document", text("s_suppkey")))
        .union(rows("customer", F.concat(F.lit("c"), text("c_custkey")), F.col("c_name"),
                    F.concat(F.lit("n"), text("c_nationkey")), "application/pdf"))
    )


@queries.add(
    "folder_paths",
    """WITH place AS (SELECT n_nationkey, r_name || '/' || n_name || '/' AS prefix FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT prefix || s_name || '.docx' AS path, 's' || s_suppkey || chr(9) || 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' AS locator,
       'application/vnd.openxmlformats-officedocument.wordprocessingml.document' AS content_type, CAST(s_suppkey AS VARCHAR) AS version
FROM supplier JOIN place ON n_nationkey = s_nationkey
UNION ALL SELECT prefix || c_name, 'c' || c_custkey || chr(9), 'application/pdf', '2024' FROM customer JOIN place ON n_nationkey = c_nationkey""",
)
def _folders(spark, d):
    return records.scan_folder_table(folder_listing(spark, d)).drop("size")


@queries.add(
    "folder_closure",
    """WITH RECURSIVE f AS (
  SELECT 'c' || c_custkey AS id, 'n' || c_custkey AS name, CASE WHEN c_custkey % 40 = 0 THEN 'root' ELSE 'c' || (c_custkey - 1) END AS parent FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_custkey, 'c' || (c_custkey + 5) FROM customer WHERE c_custkey % 97 = 0),
walk AS (
  SELECT id, name || '/' AS prefix, [id] AS trail FROM f WHERE parent = 'root'
  UNION ALL
  SELECT f.id, w.prefix || f.name || '/', list_append(w.trail, f.id) FROM f JOIN walk w ON f.parent = w.id WHERE NOT list_contains(w.trail, f.id))
SELECT id, prefix FROM walk UNION ALL SELECT 'root', ''""",
)
def _closure(spark, d):
    """Chains of forty folders; some folders have a second parent, which closes a loop or adds a way."""
    key = F.col("c_custkey")
    named = lambda number: F.concat(F.lit("c"), number.cast("string"))
    folders = c.table(spark, d, "customer").select(
        named(key).alias("id"),
        F.concat(F.lit("n"), key.cast("string")).alias("name"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.pmod(key, F.lit(40)) == 0, "root").otherwise(named(key - 1)),
                    F.when(F.pmod(key, F.lit(97)) == 0, named(key + 5)),
                )
            )
        ).alias("parent_id"),
        F.lit(records.FOLDER_TYPE).alias("mime_type"),
    )
    return records.folder_paths(folders, "root")


@queries.add(
    "tree_scan",
    "SELECT 'source=' || source AS folder, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL",
)
def _tree_scan(spark, d):
    """Documents written as a folder of text files per source, which are then listed."""
    folder = scratch_path(spark, "tree")
    docs = c.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("source").text(folder)
    found = files.scan_tree(spark, folder)
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("size").alias("bytes"))


def event_messages(spark, d):
    """Each event as a queue message: one shape, the other, both, an empty body or text
    that is not JSON."""
    key = F.concat(F.lit("tenants/acme/u"), F.col("user_id").cast("string"), F.lit("/a+b%20"), F.col("event_id").cast("string"), F.lit(".md"))
    one = F.concat(F.lit('{"detail":{"object":{"key":"'), key, F.lit('"}}'))
    two = F.concat(F.lit('"Records":[{"s3":{"object":{"key":"'), key, F.lit('"}}},{"s3":{"object":{"key":"scratch/acme/bot/x"}}}]}'))
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.concat(one, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("{"), two))
        .when(kind == "purchase", F.concat(one, F.lit(","), two))
        .when(kind == "signup", "{}")
        .otherwise("not-json")
    )
    return c.table(spark, d, "events").select(F.col("event_id").cast("string").alias("message_id"), body.alias("body"))


@queries.add(
    "event_keys",
    """WITH k AS (SELECT CAST(event_id AS VARCHAR) AS message_id, event_type, 'tenants/acme/u' || user_id || '/a b ' || event_id || '.md' AS key FROM events)
SELECT message_id, key, true AS indexable FROM k WHERE event_type IN ('view', 'purchase')
UNION ALL SELECT message_id, key, true FROM k WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT message_id, 'scratch/acme/bot/x', false FROM k WHERE event_type IN ('click', 'purchase')""",
)
def _event_keys(spark, d):
    found = messages.parse_object_events(event_messages(spark, d))
    return found.withColumn("indexable", keys.is_indexable(F.col("key")))


@queries.add("malformed_messages", "SELECT CAST(event_id AS VARCHAR) AS message_id, 'malformed' AS error FROM events WHERE event_type = 'error'")
def _malformed(spark, d):
    return messages.malformed_messages(event_messages(spark, d)).select("message_id", "error")


@queries.add(
    "scan_prefix",
    c.with_views(c.ENTRIES) + """
SELECT substr(path, 1) AS path, 'tenants/acme/en/' || path AS locator, size, etag AS version FROM entries WHERE tenant_id = 'acme' AND namespace = 'en'""",
)
def _scan_prefix(spark, d):
    return files.scan_prefix(c.stored_objects(spark, d), "tenants/acme/en").drop("content_type")


@queries.add(
    "list_objects",
    c.with_views(c.ENTRIES) + """, o AS (SELECT 'tenants/' || tenant_id || '/' || namespace || '/' || path AS key, size FROM entries),
r AS (SELECT *, row_number() OVER (ORDER BY key) AS rk, count(*) OVER () AS n FROM o WHERE starts_with(key, 'tenants/globex/'))
SELECT key, size FROM r WHERE rk <= 1000""",
)
def _list_objects(spark, d):
    return files.list_objects(c.stored_objects(spark, d), "tenants/globex/").select("key", "size")


@queries.add(
    "object_pages",
    c.with_views(c.ENTRIES) + c.in_pages(
        "(SELECT 'tenants/' || tenant_id || '/' || namespace || '/' || path AS key, size FROM entries)", "key", 1000
    ),
)
def _object_pages(spark, d):
    rows = files.object_pages(c.stored_objects(spark, d))
    return rows.select("key", "size", "ordinal", "page_no", "next_cursor")


@queries.add(
    "stat_objects",
    c.with_views(c.ENTRIES) + """, o AS (SELECT 'tenants/' || tenant_id || '/' || namespace || '/' || path AS key, size FROM entries)
SELECT key, size FROM o UNION ALL SELECT 'tenants/acme/lost/' || item_id, NULL FROM benchmark""",
)
def _stat_objects(spark, d):
    objects = c.stored_objects(spark, d)
    lost = c.table(spark, d, "benchmark").select(F.concat(F.lit("tenants/acme/lost/"), F.col("item_id").cast("string")).alias("key"))
    return files.stat_objects(objects, objects.select("key").union(lost)).select("key", "size")


@queries.add(
    "read_objects",
    "SELECT CAST(doc_id AS VARCHAR) AS key, md5(text) AS whole, hex(encode(text)[3:7]) AS part FROM documents",
)
def _read_objects(spark, d):
    contents = c.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("key"), F.encode("text", "UTF-8").alias("content")
    )
    asked = contents.select("key")
    part = files.read_objects(contents, asked.withColumn("start", F.lit(2)).withColumn("end", F.lit(6)))
    whole = files.read_objects(contents, asked)
    return whole.select("key", F.md5("content").alias("whole")).join(
        part.select("key", F.hex("content").alias("part")), "key"
    )
