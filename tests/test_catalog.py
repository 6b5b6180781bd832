"""Listing, lookup, globbing, finding, duplicates, access and folder views."""

from datetime import datetime, timezone

import pytest
from conftest import values
from pyspark.sql import functions as F

from shelfmark.operators import access, bounds, catalog, tree

DEAD = datetime(2026, 2, 1, tzinfo=timezone.utc)


def test_prefix_paging(make_entries):
    entries = make_entries(*[f"docs/{i}.txt" for i in range(4)], "other.txt")
    first = catalog.list_entries(entries, "dev", "handbook", prefix="docs/", limit=2).orderBy("path").collect()
    assert [r.path for r in first] == ["docs/0.txt", "docs/1.txt"]
    cursor = first[0].next_cursor
    assert bounds.decode_cursor(cursor) == "docs/1.txt"
    second = catalog.list_entries(entries, "dev", "handbook", prefix="docs/", limit=2, cursor=cursor)
    assert values(second, "path", "next_cursor") == [("docs/2.txt", None), ("docs/3.txt", None)]


def test_tombstones_are_hidden(make_entries):
    entries = make_entries("a", dict(path="b", deleted_at=DEAD))
    assert values(catalog.live(entries), "path") == [("a",)]
    assert len(catalog.live(entries, include_deleted=True).collect()) == 2
    asked = entries.select("tenant_id", "namespace", "path")
    got = dict(catalog.stat(entries, asked).select("path", "error").collect())
    assert got == {"a": None, "b": "not_found"}


def test_checksum_spans_namespaces_not_tenants(spark, make_entries):
    entries = make_entries(
        dict(path="a", checksum="sha-xyz"), dict(path="b", ns="other", checksum="sha-xyz"),
        dict(path="c", tenant="else", checksum="sha-xyz"), "d",
    )
    wanted = spark.createDataFrame([("dev", "sha-xyz")], "tenant_id string, checksum string")
    assert values(catalog.find_by_checksum(entries, wanted), "namespace", "path") == [("handbook", "a"), ("other", "b")]
    groups = catalog.duplicate_groups(entries).collect()
    assert [(g.copies, g.namespaces, g.first_copy) for g in groups] == [(2, 2, "handbook/a")]


@pytest.fixture(scope="module")
def shelf(make_entries):
    return make_entries(
        dict(path="onboarding/welcome.md", content_type="text/markdown", size=100, status="extracted", page_count=1),
        dict(path="policies/security.md", content_type="application/pdf", size=5000, status="extracted", page_count=1),
        dict(path="policies/leave.pdf", content_type="application/pdf", size=2000, status="catalog_only"),
        dict(path="eng/arch.md", content_type="text/markdown", size=100, status="extracted", page_count=1),
    )


def test_find_filters(shelf):
    def paths(**kw):
        return [r[0] for r in values(catalog.find(shelf, **kw), "path")]

    assert paths(content_type="application/pdf") == ["policies/leave.pdf", "policies/security.md"]
    assert paths(status="catalog_only") == ["policies/leave.pdf"]
    assert paths(min_size=3000) == ["policies/security.md"]
    assert paths(min_size=100, max_size=100) == ["eng/arch.md", "onboarding/welcome.md"]
    assert paths(modified_after=datetime(2099, 1, 1, tzinfo=timezone.utc)) == []
    assert len(paths(modified_after=datetime(2000, 1, 1, tzinfo=timezone.utc))) == 4
    assert paths(pattern="policies/*.md") == ["policies/security.md"]


def test_find_says_when_more_matched(shelf):
    assert values(catalog.find(shelf, limit=2), "path", "truncated") == [("eng/arch.md", True), ("onboarding/welcome.md", True)]
    assert {r.truncated for r in catalog.find(shelf, limit=4).collect()} == {False}


def test_answers_have_no_bound_of_their_own(make_entries):
    entries = make_entries(*[f"d/{i:04d}.md" for i in range(1203)])
    assert catalog.glob(entries, "d/*", limit=None).count() == 1203
    found = catalog.find(entries, pattern="d/*", limit=1100)
    assert found.count() == 1100 and found.first().truncated
    assert catalog.list_entries(entries, "dev", "handbook", limit=1200).count() == 1200
    assert catalog.list_entries(entries, "dev", "handbook", limit=None).first().next_cursor is None
    lines = tree.tree_lines(entries).orderBy("line_no").collect()
    assert [(r.line_no, r.name) for r in lines[:2]] == [(1, "d"), (2, "0000.md")]
    assert [r.name for r in lines[1:]] == [f"{i:04d}.md" for i in range(1203)]
    assert [r.line_no for r in lines] == list(range(1, 1205))


@pytest.mark.parametrize("size", [1, 3, 4, 8, 9])
def test_every_page_has_the_cursor_of_the_next(make_entries, size):
    """One namespace holds most rows; the pages met by their cursors are the whole answer."""
    entries = make_entries(*[f"p{i}" for i in range(8)], dict(path="p0", ns="other"))
    rows = catalog.in_pages(catalog.glob(entries, "*", None, True).drop("truncated"), size)
    got = {}
    for r in rows.orderBy("namespace", "ordinal").collect():
        got.setdefault((r.namespace, r.page_no), []).append(r)
    assert [r.ordinal for (ns, _), page in got.items() if ns == "handbook" for r in page] == list(range(1, 9))
    assert all(len(page) <= size for page in got.values())
    for (ns, number), page in got.items():
        (cursor,) = {r.next_cursor for r in page}
        more = got.get((ns, number + 1))
        assert (cursor is None) == (more is None)
        if more:
            one = catalog.in_namespace(entries, "dev", ns)
            resumed = catalog.glob(one, "*", limit=size, cursor=cursor)
            assert sorted(r.path for r in resumed.collect()) == [r.path for r in more]


def test_pages_of_nothing(make_entries):
    assert catalog.list_pages(make_entries("a"), prefix="b").collect() == []


def test_glob(shelf):
    assert values(catalog.glob(shelf, "*.md"), "path") == [("eng/arch.md",), ("onboarding/welcome.md",), ("policies/security.md",)]
    assert values(catalog.glob(shelf, "policies/*"), "path") == [("policies/leave.pdf",), ("policies/security.md",)]


def test_by_status_checks_its_argument(shelf):
    assert values(catalog.by_status(shelf, "catalog_only"), "path") == [("policies/leave.pdf",)]
    with pytest.raises(ValueError):
        catalog.by_status(shelf, "lost")


def test_tree(shelf):
    row = tree.tree(shelf).first()
    assert (row.dirs, row.files, row.truncated) == (3, 4, False)
    assert row.tree.split("\n") == [
        "eng/", "  arch.md", "onboarding/", "  welcome.md", "policies/", "  leave.pdf", "  security.md",
    ]
    below = tree.tree(shelf, prefix="policies/").first()
    assert (below.dirs, below.files, below.tree) == (0, 2, "leave.pdf\nsecurity.md")
    assert tree.tree(shelf, max_entries=2).first().truncated


def test_tree_puts_folders_before_files(make_entries):
    entries = make_entries("b.md", "a/z.md", "a/b/c.md", "a.md", "ab/x.md", "a b/y.md")
    lines = tree.tree(entries).first().tree.split("\n")
    assert lines == ["a/", "  b/", "    c.md", "  z.md", "a b/", "  y.md", "ab/", "  x.md", "a.md", "b.md"]


def test_tree_rollup(shelf):
    got = {r.folder: (r.files, r.direct_files, r.bytes) for r in tree.tree_rollup(shelf).collect()}
    assert got == {"": (4, 0, 7200), "eng": (1, 1, 100), "onboarding": (1, 1, 100), "policies": (2, 2, 7000)}


def test_top_per_group_with_a_hot_group(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i}", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = values(bounds.top_per_group(df, ["g"], ["v"], 5), "g", "v")
    want = [("hot", i) for i in range(5)] + [(f"g{i}", 1) for i in range(20)]
    assert sorted(got) == sorted(want)


CLAIMS = [
    ("absent", "acme", "fs:read ingest", None, []),
    ("star", "acme", "fs:read", "*", ["*"]),
    ("mixed", "acme", None, "hr,*", ["*"]),
    ("commas", "acme", "", "hr, it  ops", ["hr", "it", "ops"]),
    ("blank", "acme", None, "", []),
]


def test_contexts_from_claims(spark):
    df = spark.createDataFrame(
        [c[:4] for c in CLAIMS] + [("no_tenant", None, None, "hr"), (None, "acme", None, "hr")],
        "sub string, tenant_id string, scope string, namespaces string",
    )
    got = {r.principal_id: r for r in access.contexts_from_claims(df).collect()}
    for sub, _, scope, _, names in CLAIMS:
        assert got[sub].namespaces == names and got[sub].rejected is None
        assert got[sub].scopes == sorted(set((scope or "").split()))
    assert got["no_tenant"].rejected == "no_tenant"
    assert got[None].rejected == "no_principal"
    fallback = access.contexts_from_claims(df, default_tenant="home", default_namespaces="x y")
    got = {r.principal_id: r for r in fallback.collect()}
    assert got["no_tenant"].tenant_id == "home" and got["no_tenant"].rejected is None
    assert got["absent"].namespaces == ["x", "y"] and got["blank"].namespaces == []


def test_list_claims(spark):
    df = spark.createDataFrame(
        [("a", "acme", ["fs:read"], ["hr", "it"]), ("b", "acme", None, ["it", "*"])],
        "sub string, tenant_id string, scope array<string>, namespaces array<string>",
    )
    got = {r.principal_id: (r.scopes, r.namespaces) for r in access.contexts_from_claims(df).collect()}
    assert got == {"a": (["fs:read"], ["hr", "it"]), "b": ([], ["*"])}


def test_visible_entries(spark, make_entries):
    entries = make_entries(
        dict(path="a", ns="hr"), dict(path="b", ns="it"), dict(path="c", ns="hr", tenant="else"),
        dict(path="d", ns="hr", deleted_at=DEAD),
    )
    granted = spark.createDataFrame(
        [("dev", "ann", "hr"), ("dev", "bob", "*"), ("else", "cy", "it")], "tenant_id string, principal_id string, namespace string"
    )
    assert values(access.visible_entries(entries, granted, "dev", "ann"), "path") == [("a",)]
    assert values(access.visible_entries(entries, granted, "dev", "bob"), "path") == [("a",), ("b",)]
    assert values(access.visible_entries(entries, granted, "else", "cy"), "path") == []
    assert values(access.visible_entries(entries, granted, "dev", "nobody"), "path") == []
    held = spark.createDataFrame([(["fs:read", "ingest"],), ([],)], "s array<string>")
    assert [r[0] for r in held.select(access.has_scopes(F.col("s"), ["fs:read"])).collect()] == [True, False]
    assert [r[0] for r in held.select(access.has_scopes(F.col("s"), [])).collect()] == [True, True]
