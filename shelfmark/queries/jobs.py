"""Whole jobs and written tables: their results read back and compared."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators import extraction as ex
from ..operators import upkeep
from ..operators.blocks import with_rank, with_running_sum
from ..operators.catalog import PK
from ..plans import ingest, reconcile, sync
from ..schemas import CHANGES, ENTRIES, PAGES
from ..session import scratch_path
from ..sinks import history, tables
from ..sources import connector
from ..sources.normalizers import NATIVE, Normalized, Normalizer, extract
from ..streaming import jobs as streams
from . import corpus as c
from .registry import Registry
from .upkeep import changes, source_items

queries = Registry()

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


# --- scalar functions ------------------------------------------------------------


@queries.add(
    "path_facts",
    c.with_views(c.ENTRIES) + """
SELECT path, split_part(path, '/', -1) AS name, regexp_extract(path, '[.][a-z]+$') AS extension, content_type, content_type AS given_or_guessed,
       'application/octet-stream' AS unknown FROM entries""",
)
def _path_facts(spark, d):
    path = F.col("path")
    return c.entries(spark, d).select(
        "path",
        paths.basename(path).alias("name"),
        paths.extension(path).alias("extension"),
        paths.guess_type(path).alias("content_type"),
        paths.guess_type(path, F.lit("")).alias("given_or_guessed"),
        paths.guess_type(F.concat(path, F.lit(".zzz"))).alias("unknown"),
    )


@queries.add(
    "url_paths",
    r"""SELECT page_id, array_to_string(list_filter(string_split(replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '\', '/'), '/'),
  lambda p: p <> '' AND p <> '..'), '/') AS path FROM pages""",
)
def _url_paths(spark, d):
    return c.table(spark, d, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))


@queries.add(
    "scratch_deltas",
    """SELECT b.conv_id, b.turn, strlen(b.text)::BIGINT - coalesce(strlen(a.text), 0) AS delta_bytes
FROM conversations b LEFT JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1""",
)
def _deltas(spark, d):
    turns = c.table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.octet_length("text").alias("was"))
    return turns.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", paths.delta_bytes(F.col("text"), F.col("was")).alias("delta_bytes")
    )


@queries.add("missing_paths", "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _missing(spark, d):
    known = c.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return upkeep.missing_paths(known, c.table(spark, d, "events"), ["user_id"])


# --- running sums over groups of any size ------------------------------------------


@queries.add(
    "running_bytes",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, sum(size) OVER (PARTITION BY tenant_id, namespace ORDER BY path)::BIGINT AS bytes_so_far FROM entries""",
)
def _running(spark, d):
    rows = c.entries(spark, d).select("tenant_id", "namespace", "path", "size")
    return with_running_sum(rows, ["tenant_id", "namespace"], ["path"], "size", "bytes_so_far").drop("size")


@queries.add(
    "listing_pages",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, (row_number() OVER (PARTITION BY tenant_id, namespace ORDER BY path) - 1) // 100 + 1 AS page_no
FROM entries WHERE NOT deleted""",
)
def _listing(spark, d):
    rows = c.entries(spark, d).where("deleted_at IS NULL").select("tenant_id", "namespace", "path")
    ranked = with_rank(rows, ["tenant_id", "namespace"], ["path"])
    return ranked.select(
        "tenant_id", "namespace", "path", (F.floor((F.col("rank") - 1) / 100) + 1).alias("page_no")
    )


# --- written tables ------------------------------------------------------------


@queries.add(
    "history_entries",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, CASE WHEN namespace = 'de' AND NOT deleted THEN 2 ELSE 1 END AS writes, deleted OR namespace = 'de' AS dead FROM entries""",
)
def _history_entries(spark, d):
    """All rows in one batch, one namespace tombstoned in the next."""
    path = scratch_path(spark, "entries")
    entries = c.entries(spark, d)
    tables.upsert_entries(entries, path, 1)
    now = history.current_entries(history.read_history(spark, path, ENTRIES))
    tables.upsert_entries(tables.tombstones(now, now.where("namespace = 'de'"), NOW), path, 2)
    stored = history.read_history(spark, path, ENTRIES)
    writes = stored.groupBy(*PK).agg(F.count("*").alias("writes"))
    live = history.current_entries(stored).select(*PK, F.col("deleted_at").isNotNull().alias("dead"))
    return live.join(writes, PK)


@queries.add(
    "history_replayed",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, size + 1 AS size, 5 AS batch_id FROM entries WHERE NOT deleted""",
)
def _history_replayed(spark, d):
    """A batch of all rows; an attempt to write it again that dies; then one that ends and leaves out dead rows."""
    path = scratch_path(spark, "entries")
    entries = c.entries(spark, d)
    tables.upsert_entries(entries, path, 5)
    history.write_attempt(entries.where("namespace = 'de'"), path, 5)
    again = history.read_history(spark, path, ENTRIES).where("deleted_at IS NULL").drop("batch_id")
    tables.upsert_entries(again.withColumn("size", F.col("size") + 1), path, 5)
    stored = history.read_history(spark, path, ENTRIES)
    return stored.select(*PK, "size", F.col("batch_id").cast("int").alias("batch_id"))


@queries.add(
    "history_pages",
    c.with_views(c.ENTRIES, c.LINES, c.PAGES) + """
SELECT entry_id, page, md5(text) AS text_md5 FROM doc_pages WHERE namespace <> 'fr' OR page = 1""",
)
def _history_pages(spark, d):
    """All pages in one batch; in the next, documents of one namespace shrink to a page."""
    path = scratch_path(spark, "pages")
    pages = c.pages(spark, d).withColumn("source_locator", F.lit(None).cast("string"))
    tables.write_pages(pages, path, 1)
    tables.write_pages(pages.where("namespace = 'fr' AND page = 1"), path, 2)
    now = history.current_pages(history.read_history(spark, path, PAGES))
    return now.select("entry_id", "page", F.md5("text").alias("text_md5"))


# --- jobs ----------------------------------------------------------------------


def line_pages(content: bytes, content_type: str, path: str) -> Normalized:
    """A stand-in parser: every line is a page."""
    lines = content.decode("utf-8").split("\n")
    return Normalized([(line[::-1], f"line={n}") for n, line in enumerate(lines, 1)], confidence=0.75)


def bodies(spark, d):
    docs = c._identity(c.table(spark, d, "documents"))
    return docs.select("tenant_id", "namespace", "path", F.encode("text", "UTF-8").alias("content"))


@queries.add(
    "extract_with_parsers",
    c.with_views(c.ENTRIES) + """
SELECT path, CASE WHEN content_type LIKE 'text/%' THEN 'text_native' WHEN content_type = 'application/pdf' THEN 'pdf' END AS extractor,
       CASE WHEN content_type LIKE 'text/%' THEN 1 WHEN content_type = 'application/pdf' THEN n_lines ELSE 0 END AS page_count,
       CASE WHEN content_type LIKE 'text/%' THEN length(text) WHEN content_type = 'application/pdf' THEN length(text) - n_lines + 1 ELSE 0 END AS char_count,
       CASE WHEN content_type = 'application/pdf' THEN 0.75::DOUBLE END AS confidence FROM entries""",
)
def _parsers(spark, d):
    found = extract(ingest.describe(bodies(spark, d)), [NATIVE, Normalizer("pdf", line_pages)])
    pages, chars, _ = ex.quality_of(F.col("pages"))
    return found.select(
        "path", "extractor", F.greatest(pages, F.lit(0)).alias("page_count"), chars.alias("char_count"), "confidence"
    )


@queries.add(
    "extract_backlog",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, entry_id, CASE WHEN content_type LIKE 'text/%' THEN 'extracted' ELSE 'catalog_only' END AS status
FROM entries WHERE deleted OR status <> 'extracted'""",
)
def _extract_backlog(spark, d):
    objects = c.stored_objects(spark, d)
    contents = bodies(spark, d).select(F.concat_ws("/", F.lit("tenants"), *PK).alias("key"), "content")
    made = ingest.extract_backlog(objects.select("key"), objects, contents, c.entries(spark, d), NOW)
    return made.entries.select(*PK, "entry_id", "extraction.status")


@queries.add(
    "sync_run",
    c.with_views(c.ENTRIES) + """
SELECT path, CASE WHEN starts_with(path, 'lost/') THEN 'deleted' WHEN same THEN 'reversioned' ELSE 'ingested' END AS outcome, version FROM (
  SELECT e.path, l.quality = 0 AND l.toxic = 0 AS same, 'v' || d.n_chars AS version
  FROM entries e JOIN documents d ON d.doc_id = e.doc_id LEFT JOIN labels l ON l.doc_id = e.doc_id
  WHERE NOT coalesce(l.quality = 1 AND l.toxic = 0, false) AND NOT contains(e.text, '@')
  UNION ALL SELECT 'lost/' || item_id, NULL, 'old' FROM benchmark)""",
)
def _sync_run(spark, d):
    """Rows a sync appends: new or changed items, new versions of equal content, and
    tombstones of what the source no longer has."""
    from .upkeep import known_rows

    none = lambda kind: F.lit(None).cast(kind)
    known = known_rows(spark, d).withColumn("tenant_id", F.lit("acme")).withColumn("namespace", F.lit("src"))
    given = set(known.columns)
    entries = known.select(
        *(F.col(f.name) if f.name in given else none(f.dataType).alias(f.name) for f in ENTRIES.fields)
    )
    texts = c._identity(c.table(spark, d, "documents")).select("path", "text")

    def fetch(items):
        broken = F.contains("text", F.lit("@"))
        return texts.join(items.select("path"), "path", "left_semi").select(
            "path",
            F.when(~broken, F.encode("text", "UTF-8")).alias("content"),
            F.when(broken, "unreadable").alias("error"),
        )

    run = sync.sync(source_items(spark, d), fetch, entries, "acme", "src", "docs", NOW, prune_missing=True)
    outcome = (
        F.when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("size").isNull(), "reversioned")
        .otherwise("ingested")
    )
    return run.entries.select("path", outcome.alias("outcome"), F.col("source.version").alias("version"))


@queries.add(
    "reconcile_sweep",
    c.with_views(c.ENTRIES, c.CATALOG) + """
SELECT 'enqueue' AS action, 'tenants/' || e.tenant_id || '/' || e.namespace || '/' || e.path AS target
FROM entries e LEFT JOIN catalog k ON k.tenant_id = e.tenant_id AND k.namespace = e.namespace AND k.path = e.path
WHERE k.path IS NULL OR k.dead OR k.etag <> e.etag
UNION ALL SELECT 'tombstone', path FROM catalog WHERE namespace = 'lost' AND NOT dead AND updated_at <= TIMESTAMP '2024-01-01 00:15:00'""",
)
def _sweep(spark, d):
    at = datetime.fromtimestamp(c.SWEEP_AT, timezone.utc)
    sweep = reconcile.reconcile(c.stored_objects(spark, d), c.drifted_catalog(spark, d), at)
    return sweep.enqueue.select(F.lit("enqueue").alias("action"), F.col("key").alias("target")).union(
        sweep.tombstones.select(F.lit("tombstone"), "path")
    )


@queries.add(
    "ingest_stream",
    c.with_views(c.ENTRIES) + """
SELECT tenant_id, namespace, path, entry_id, size, CASE WHEN content_type LIKE 'text/%' THEN 'extracted' ELSE 'catalog_only' END AS status,
       CASE WHEN content_type LIKE 'text/%' THEN checksum END AS text_checksum FROM entries""",
)
def _ingest_stream(spark, d):
    """A message per stored document, plus noise, drained into an empty store."""
    objects = c.stored_objects(spark, d)
    contents = bodies(spark, d).select(F.concat_ws("/", F.lit("tenants"), *PK).alias("key"), "content")
    inbox = scratch_path(spark, "inbox")
    body = F.to_json(F.struct(F.struct(F.struct("key").alias("object")).alias("detail")))
    noise = c.table(spark, d, "benchmark").select(F.lit("not-json").alias("body"))
    rows = objects.select(body.alias("body")).union(noise)
    rows.select(F.md5("body").alias("message_id"), "body", F.lit(1).alias("attempt")).write.json(inbox)
    store = ingest.Store(scratch_path(spark, "entries"), scratch_path(spark, "pages"))
    streams.ingest_stream(
        streams.message_stream(spark, inbox), lambda: objects, lambda: contents, store,
        scratch_path(spark, "checkpoint"), scratch_path(spark, "quarantine"), lambda: NOW,
    ).awaitTermination()
    return store.current(spark).select(
        *PK, "entry_id", "size", "extraction.status", "extraction.text_checksum"
    )


DELTA = """WITH last AS (SELECT user_id, max(event_id) AS seq FROM events GROUP BY ALL)
SELECT 'u' || e.user_id AS path, event_type AS version FROM events e JOIN last l ON l.user_id = e.user_id AND l.seq = e.event_id WHERE event_type <> 'error'"""


def change_rows(spark, d):
    """Events as changes of the documents of their users."""
    none = F.lit(None).cast("string")
    return changes(spark, d).select(
        F.col("seq"), "op", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        none.alias("locator"), F.lit(None).cast("long").alias("size"), none.alias("content_type"),
        F.col("state").alias("version"),
    )


@queries.add("connector_changes", DELTA)
def _connector_changes(spark, d):
    """A connector followed by a stream over three batches of its feed, with a restart before
    the later two; each batch is stored once, and the last change of a path decides."""
    feed, store, seen = (scratch_path(spark, name) for name in ("feed", "changes", "checkpoint"))
    rows = change_rows(spark, d)
    newest = rows.agg(F.max("seq")).first()[0] or 0
    part = F.floor(F.col("seq") * 3 / (newest + 1))
    connector.register_changes(spark, "batch_folders", connector.BatchFolders)

    def keep(batch, batch_id):
        history.append_batch(batch, store, batch_id)
        return 0

    for run in ((0,), (1, 2)):
        for n in run:
            rows.where(part == n).write.parquet(f"{feed}/{n:06d}")
        followed = connector.follow_connector(spark, "batch_folders", root=feed)
        streams.delta_sync(followed, keep, seen).awaitTermination()
    stored = history.read_history(spark, store, CHANGES).select("seq", "op", "path", "version")
    nothing = stored.select("path", "version").limit(0)
    return upkeep.apply_changes(nothing, stored, ["path"])


@queries.add("delta_sync", DELTA)
def _delta_sync(spark, d):
    """Events as a change feed read by a stream; every batch is folded into the state
    of the batch before it."""
    feed, state = scratch_path(spark, "feed"), scratch_path(spark, "state")
    change_rows(spark, d).write.parquet(feed)
    done: list[str] = []

    def apply(batch, batch_id):
        shape = batch.select("path", "version")
        before = spark.read.schema(shape.schema).parquet(done[-1]) if done else shape.limit(0)
        done.append(f"{state}/{batch_id}")
        upkeep.apply_changes(before, batch, ["path"]).write.mode("overwrite").parquet(done[-1])
        return 0

    streams.delta_sync(streams.change_stream(spark, feed), apply, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("path string, version string").parquet(done[-1])


@queries.add(
    "row_text",
    """SELECT doc_id, md5(array_to_string(list_concat(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '[^[:space:]]')),
  ['k | ' || source, lang || ' | ']), chr(10) || chr(10))) AS text_md5 FROM documents""",
)
def _row_text(spark, d):
    """The lines of a document as paragraphs, with a small table below them."""
    cells = F.array(
        F.array(F.lit(" k "), F.col("source")), F.array(F.lit(""), F.lit(" ")), F.array(F.col("lang"), F.lit("")),
    )
    rows = c.table(spark, d, "documents")
    return rows.select("doc_id", F.md5(tx.join_row_text(F.split("text", "\n"), cells)).alias("text_md5"))


@queries.add(
    "decoded_text",
    "SELECT doc_id, md5(text) AS text_md5, NOT regexp_matches(text, '[^[:space:]]') AS blank, substr(text, 1, 300) AS head FROM documents",
)
def _decoded(spark, d):
    raw = c.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    text = tx.decode_text(F.col("content"))
    return raw.select(
        "doc_id", F.md5(text).alias("text_md5"), tx.is_blank(text).alias("blank"), tx.truncate(text).alias("head")
    )
