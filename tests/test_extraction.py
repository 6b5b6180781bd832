"""Rung selection, parsers, OCR pages, and whole ingest and sync jobs."""

import hashlib
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from conftest import entry_row, values
from pyspark.sql import functions as F

from shelfmark.operators import extraction as ex
from shelfmark.operators import ocr
from shelfmark.plans import ingest, sync
from shelfmark.schemas import ENTRIES, OBJECTS, OCR_BLOCKS, SOURCE_ITEMS
from shelfmark.sinks import history
from shelfmark.sources.normalizers import NATIVE, Declined, Gate, Normalized, Normalizer, extract

NOW = datetime(2026, 6, 14, tzinfo=timezone.utc)


def documents(spark, files, tenant="dev", ns="ns"):
    rows = [(tenant, ns, p, bytearray(b)) for p, b in files.items()]
    return spark.createDataFrame(rows, "tenant_id string, namespace string, path string, content binary")


def nothing(spark):
    return spark.createDataFrame([], ENTRIES)


ROUTES = {"application/pdf": ["pdf"], "image/*": ["textract"], "*": ["text_native"]}


def test_routes(spark):
    df = spark.createDataFrame([("application/pdf",), ("image/png",), ("text/plain",), (None,)], "t string")
    got = [tuple(r) for r in df.select(ex.route(F.col("t"), ROUTES), ex.route_ladder(F.col("t"), ROUTES)).collect()]
    assert got == [("application/pdf", ["pdf"]), ("image/*", ["textract"]), ("*", ["text_native"]), ("*", ["text_native"])]
    bare = {k: v for k, v in ROUTES.items() if k != "*"}
    assert [r[0] for r in df.select(ex.route_ladder(F.col("t"), bare)).collect()][2:] == [None, None]


def test_ladders():
    assert ex.ladder() == ["text_native", "pdf", "docx"]
    assert ex.ladder(preset="full")[-1] == "llm"
    assert ex.ladder(["pdf"], preset="full") == ["pdf"]
    with pytest.raises(ValueError):
        ex.ladder(preset="nope")
    with pytest.raises(ValueError):
        ex.ladder(["mystery"])
    assert ex.ladder(["mystery"], known=["mystery"]) == ["mystery"]


@pytest.mark.parametrize(
    "rung,kind,path,want",
    [
        ("tesseract", "image/png", "a", True),
        ("rapidocr", None, "scan.TIFF", True),
        ("rapidocr", "text/plain", "a.docx", False),
        ("text_native", "text/csv", "x", True), ("text_native", "application/json", "x", True),
        ("text_native", None, "a/B.MD", True), ("text_native", "image/png", "x.png", False),
        ("pdf", None, "x.PDF", True), ("docx", None, "x.docx", True), ("textract", "image/gif", "x", True),
        ("textract_analyze", None, "x.tiff", True), ("llm", "application/pdf", "x", True), ("docling", None, "x.pptx", True),
        ("docling", "text/plain", "x.txt", False),
    ],
)
def test_claims(spark, rung, kind, path, want):
    df = spark.createDataFrame([(kind, path)], "t string, p string")
    assert df.select(ex.accepts(rung, F.col("t"), F.col("p"))).first()[0] is want


def test_select_rung(spark):
    data = [
        ("ok", 1, "text_native", None, 1, 5, None), ("ok", 2, "pdf", None, 9, 9, None),
        ("shaky", 1, "a", None, 1, 5, 0.4), ("shaky", 2, "b", None, 2, 5, 0.9),
        ("failed", 1, "a", "parse_failed", 1, 5, None), ("empty", 1, "a", None, 0, 0, None), ("blank", 1, "a", None, 1, 0, None),
    ]
    df = spark.createDataFrame(data, "doc string, rung_no int, rung string, error string, page_count int, min_chars_per_page int, confidence double")
    assert values(ex.select_rung(df, ["doc"]), "doc", "extractor") == [("ok", "text_native"), ("shaky", "a")]
    assert values(ex.select_rung(df, ["doc"], min_confidence=0.6), "doc", "extractor", "page_count") == [("ok", "text_native", 1), ("shaky", "b", 2)]


def test_renumber(spark):
    df = spark.createDataFrame([([(3, "c", "p3"), (1, " \n", "p1"), (2, "b", "p2")],)], "pages array<struct<page:int,text:string,source_locator:string>>")
    got = df.select(ex.renumber(F.col("pages")).alias("p"), *ex.quality_of(F.col("pages"))).first()
    assert [tuple(p) for p in got.p] == [(1, "b", "p2"), (2, "c", "p3")]
    assert (got.page_count, got.char_count, got.min_chars_per_page) == (3, 4, 1)


def flaky(content, content_type, path):
    if content == b"boom":
        raise RuntimeError("boom")
    if content == b"no":
        raise Declined("missing_dependency")
    return Normalized([(content.decode(), "p:1"), ("two", "p:2")], ocr_used=True, confidence=0.5)


def steady(content, content_type, path):
    return Normalized([("steady", "s:1")])


FLAKY = Normalizer("pdf", flaky)
STEADY = Normalizer("steady", steady, claims=lambda kind, path: F.endswith(path, F.lit(".pdf")))
FILES = {"a.md": b"alpha", "blank.txt": b" \n", "good.pdf": b"page", "boom.pdf": b"boom", "no.pdf": b"no", "x.bin": b"\x00"}


def test_parsers_are_walked_in_order(spark):
    docs = ingest.describe(documents(spark, FILES))
    got = {r.path: r for r in extract(docs, [NATIVE, FLAKY, STEADY]).collect()}
    assert {p: r.extractor for p, r in got.items()} == {
        "a.md": "text_native", "blank.txt": None, "good.pdf": "pdf", "boom.pdf": "steady", "no.pdf": "steady", "x.bin": None,
    }
    assert [p.text for p in got["good.pdf"].pages] == ["page", "two"] and got["good.pdf"].ocr_used
    assert got["blank.txt"].error == "text_native:empty_document"
    sure = {r.path: r for r in extract(docs, [NATIVE, FLAKY, STEADY], Gate(min_confidence=0.6)).collect()}
    assert sure["good.pdf"].extractor == "steady"
    alone = {r.path: r.error for r in extract(docs, [FLAKY]).collect()}
    assert alone["boom.pdf"] == "pdf:parse_failed:RuntimeError" and alone["no.pdf"] == "pdf:missing_dependency"


def test_ingest(spark):
    docs = documents(spark, {**FILES, "../bad": b"x"})
    old = spark.createDataFrame([entry_row("a.md", ns="ns", entry_id="KEEP"), entry_row("x.bin", ns="ns", deleted_at=NOW, entry_id="DEAD")], ENTRIES)
    made = ingest.ingest_documents(docs, old, NOW, [NATIVE, FLAKY])
    got = {r.path: r for r in made.entries.collect()}
    assert set(got) == set(FILES)
    a = got["a.md"]
    assert (a.entry_id, a.created_at.year, a.updated_at.month) == ("KEEP", 2026, 6) and a.created_at < a.updated_at
    assert (a.size, a.title, a.content_type) == (5, "a.md", "text/markdown")
    assert a.checksum == hashlib.sha256(b"alpha").hexdigest() and a.etag == hashlib.md5(b"alpha").hexdigest()
    assert tuple(a.extraction) == ("extracted", None, 1, a.checksum, "text_native")
    assert tuple(got["x.bin"].extraction) == ("catalog_only", "no_extractor", None, None, None)
    assert got["x.bin"].entry_id != "DEAD"
    assert got["good.pdf"].extraction.text_checksum == hashlib.sha256(b"page\ntwo").hexdigest()
    assert values(made.pages, "page", "text") == [(1, "alpha"), (1, "page"), (2, "two")]
    assert [r.problem for r in made.quarantined.collect()] == ["bad_path"]
    waiting = ingest.ingest_documents(docs, old, NOW, deferred=True)
    assert {r.extraction.status for r in waiting.entries.collect()} == {"pending"} and waiting.pages.count() == 0


def test_store_round_trip_and_backlog(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "e"), str(tmp_path / "p"))
    ingest.save(ingest.ingest_documents(documents(spark, FILES), nothing(spark), NOW), store, 1)
    entries = store.current(spark)
    assert dict(entries.groupBy("extraction.status").count().collect()) == {"extracted": 1, "catalog_only": 5}
    stored = spark.createDataFrame(
        [(f"tenants/dev/ns/{p}", len(b), hashlib.md5(b).hexdigest(), None, NOW) for p, b in FILES.items()]
        + [("tenants/dev/ns/dropped.md", 3, "t", None, NOW), ("scratch/dev/bot/x.md", 1, "t", None, NOW)], OBJECTS,
    )
    contents = spark.createDataFrame(
        [(f"tenants/dev/ns/{p}", bytearray(b)) for p, b in {**FILES, "dropped.md": b"new"}.items()], "key string, content binary"
    )
    asked = stored.select("key")
    made = ingest.extract_backlog(asked, stored, contents, entries, NOW, [NATIVE, FLAKY])
    assert "a.md" not in {r.path for r in made.entries.collect()}  # done already
    ingest.save(made, store, 2)
    entries = store.current(spark)
    assert {r.path for r in entries.where("extraction.status = 'extracted'").collect()} == {"a.md", "good.pdf", "dropped.md"}
    again = ingest.extraction_backlog(stored, entries)
    assert values(again, "path") == [("blank.txt",), ("boom.pdf",), ("no.pdf",), ("x.bin",)]
    changed = stored.withColumn("etag", F.when(F.col("key").endswith("a.md"), "other").otherwise(F.col("etag")))
    assert ("a.md",) in values(ingest.extraction_backlog(changed, entries), "path")


def source(spark, files):
    rows = [(p, f"loc:{p}", len(b), None, v) for p, (b, v) in files.items()]
    contents = spark.createDataFrame(
        [(p, None if b == b"!" else bytearray(b), "boom" if b == b"!" else None) for p, (b, _) in files.items()],
        "path string, content binary, error string",
    )
    asked = []

    def fetch(items):
        asked.append(sorted(r.path for r in items.collect()))
        return contents.join(items.select("path"), "path", "left_semi")

    return spark.createDataFrame(rows, SOURCE_ITEMS), fetch, asked


def test_sync_runs(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "e"), str(tmp_path / "p"))

    def run(files, batch, **kw):
        items, fetch, asked = source(spark, files)
        done = sync.sync(items, fetch, store.current(spark), "dev", "ns", "local", NOW, **kw)
        report = done.report.first().asDict()
        ingest.save(ingest.Ingested(done.entries, done.pages, nothing(spark)), store, batch)
        return report, asked[0], done

    first = {"a.md": (b"alpha", "1"), "sub/b.txt": (b"beta", "1"), "bad.md": (b"!", "1")}
    report, asked, done = run(first, 1)
    assert report == dict(ingested=2, skipped=0, deleted=0, failed=1) and len(asked) == 3
    assert values(done.errors, "message") == [("bad.md: boom",)]
    # An unchanged version is not even fetched; the same bytes under a new one are.
    report, asked, _ = run({"a.md": (b"alpha", "1"), "sub/b.txt": (b"beta", "2")}, 2)
    assert report == dict(ingested=0, skipped=2, deleted=0, failed=0) and asked == ["sub/b.txt"]
    report, asked, _ = run({"a.md": (b"alpha", "1"), "sub/b.txt": (b"beta", "2")}, 3)
    assert asked == []
    report, _, _ = run({"a.md": (b"ALPHA", "2")}, 4, prune_missing=True)
    assert report == dict(ingested=1, skipped=0, deleted=1, failed=0)
    now = store.current(spark)
    assert values(now.where("deleted_at is null"), "path", "source.version") == [("a.md", "2")]
    gone = spark.createDataFrame([("a.md",)], "path string")
    report, _, _ = run({"c.md": (b"c", "1")}, 5, deleted=gone)
    assert report == dict(ingested=1, skipped=0, deleted=1, failed=0)
    assert values(store.current(spark).where("deleted_at is null"), "path") == [("c.md",)]


def test_split_changes(spark):
    from shelfmark.schemas import CHANGES

    rows = [(1, "upsert", "a", "l", 1, None, "1"), (2, "delete", "a", None, None, None, None), (3, "upsert", "b", "l", 1, None, "2")]
    upserts, gone = sync.split_changes(spark.createDataFrame(rows, CHANGES))
    assert values(upserts, "path") == [("b",)] and values(gone, "path") == [("a",)]


def blocks(spark, *rows):
    names = [f.name for f in OCR_BLOCKS.fields]
    full = [{"doc": "d", "page": 1, "seq": n, **r} for n, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in full], OCR_BLOCKS)


def word(i, text):
    return dict(id=i, block_type="WORD", text=text)


FORM = [
    dict(id="l1", block_type="LINE", text="Hello world", confidence=90.0, child_ids=["w1", "w2"]),
    dict(id="l2", block_type="LINE", text="Item Qty", confidence=80.0, child_ids=["w3", "w4"]),
    word("w1", "Hello"), word("w2", "world"), word("w3", "Item"), word("w4", "Qty"), word("w5", "Tank"), word("w6", "1"),
    dict(id="t", block_type="TABLE", child_ids=["c1", "c2", "c3", "c4"]),
    dict(id="c1", block_type="CELL", row_index=1, column_index=1, child_ids=["w3"]),
    dict(id="c2", block_type="CELL", row_index=1, column_index=2, child_ids=["w4"]),
    dict(id="c3", block_type="CELL", row_index=2, column_index=1, child_ids=["w5"]),
    dict(id="c4", block_type="CELL", row_index=2, column_index=2, child_ids=["w6", "s1", "s2"]),
    dict(id="s1", block_type="SELECTION_ELEMENT", selection_status="SELECTED"),
    dict(id="s2", block_type="SELECTION_ELEMENT", selection_status="NOT_SELECTED"),
    dict(id="k", block_type="KEY_VALUE_SET", entity_types=["KEY"], child_ids=["w7"], value_ids=["v"]),
    dict(id="v", block_type="KEY_VALUE_SET", entity_types=["VALUE"], child_ids=["w8", "w9"]),
    word("w7", "Vessel"), word("w8", "Northern"), word("w9", "Star"),
    dict(id="f", block_type="LAYOUT_FIGURE"),
    dict(id="p2", page=2, block_type="LINE", text="  ", confidence=10.0),
    dict(id="p3", page=3, block_type="LINE", text="last"),
]


def test_ocr_pages(spark):
    table = blocks(spark, *FORM)
    got = {r.page: r for r in ocr.assemble_pages(table).collect()}
    assert got[1].text.split("\n\n") == [
        "Hello world", "| Item | Qty |\n| --- | --- |\n| Tank | 1 [x] |", "**Vessel**: Northern Star", "[figure 1: see source page]",
    ]
    assert got[1].confidence == pytest.approx(0.85) and got[3].confidence is None
    numbered, quality = ocr.finish_pages(ocr.assemble_pages(table))
    assert values(numbered, "number", "source_locator") == [(1, "ocr:page=1"), (2, "ocr:page=3")]
    q = quality.first()
    assert (q.page_count, q.min_chars_per_page, q.ocr_used) == (2, 4, True) and q.confidence == pytest.approx(0.85)
    plain = {r.page: r.text for r in ocr.plain_pages(table).collect()}
    assert plain == {1: "Hello world\nItem Qty", 2: "  ", 3: "last"}
    assert {r.page: r.confidence for r in ocr.line_confidence(table).collect()}[2] == pytest.approx(0.1)


def test_lines_with_loose_words_stay(spark):
    table = blocks(
        spark, dict(id="l", block_type="LINE", text="a b", child_ids=["w1", "w2"]), word("w1", "a"), word("w2", "b"),
        dict(id="t", block_type="TABLE", child_ids=["c"]), dict(id="c", block_type="CELL", row_index=2, column_index=2, child_ids=["w1"]),
        dict(id="x", block_type="CELL", row_index=1, column_index=1, child_ids=["w2"]),
    )
    text = ocr.assemble_pages(table).first().text
    assert text == "a b\n\n|  |  |\n| --- | --- |\n|  | a |"


def test_text_checksums(spark, make_pages):
    got = ex.text_checksums(make_pages({"a": ["x", "y"]}), ["entry_id"]).first()
    assert got.text_checksum == hashlib.sha256(b"x\ny").hexdigest() and got.page_count == 2


def test_reasons(make_entries):
    got = ex.reasons(make_entries("a", dict(path="b", status="extracted"), dict(path="c", deleted_at=NOW)))
    assert values(got) == [("extracted", "", 1), ("pending", "", 1)]
    assert ex.needs_extraction(make_entries("a", dict(path="b", status="extracted"))).count() == 1


def test_history_of_ingest_is_idempotent(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "e"), str(tmp_path / "p"))
    for _ in range(2):
        ingest.save(ingest.ingest_documents(documents(spark, FILES), nothing(spark), NOW), store, 1, str(tmp_path / "q"))
    assert history.read_history(spark, store.entries, ENTRIES).count() == len(FILES)


def test_parsed_pages_leave_a_task_in_parts():
    """A batch of many documents is answered a few megabytes at a time, and kept columns keep their types."""
    from shelfmark.sources import normalizers as nz

    def wide(content, content_type, path):
        return Normalized([(content.decode() * 50, f"p:{n}") for n in range(4)])

    many = 400
    batch = pa.RecordBatch.from_pydict(
        {
            "size": pa.array([None if n % 2 else n for n in range(many)], pa.int64()),
            "content_type": [None] * many,
            "path": [f"{n}.pdf" for n in range(many)],
            nz.CLAIMED: [["pdf"] if n % 4 else [] for n in range(many)],
            nz.BODY: [b"x" * 1000 if n % 4 else None for n in range(many)],
        }
    )
    made = list(nz._Walk([Normalizer("pdf", wide)], nz.Gate(), ["path", "size"])(iter([batch])))
    assert len(made) > 10 and max(b.nbytes for b in made) < 2 * nz.ANSWER_BYTES
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["path"], r["size"]) for r in rows] == [(f"{n}.pdf", None if n % 2 else n) for n in range(many)]
    for n, r in enumerate(rows):
        assert r["extractor"] == ("pdf" if n % 4 else None) and r["error"] is None
        assert [len(p["text"]) for p in r["pages"] or []] == [50_000] * (4 if n % 4 else 0)


def test_content_may_be_kept_and_is_sent_for_claimed_documents_only(spark):
    docs = ingest.describe(documents(spark, FILES))
    found = {r.path: r for r in extract(docs, [FLAKY], keep=["path", "content"]).collect()}
    assert {p: bytes(r.content) for p, r in found.items()} == FILES
    assert found["x.bin"].extractor is None and found["x.bin"].error is None
