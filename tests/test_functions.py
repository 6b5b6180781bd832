"""Column functions against Python's own string rules."""

import fnmatch
import itertools
import mimetypes
import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import dialect, keys, paths
from shelfmark.functions import text as tx


def apply(spark, strings, *columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


ODD = ["", "a", "a\n", "\n", "\n\n", "a\r\nb", "a\rb\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b", "a\u2028b\u2029c", "x\n\r\ny", "a\x1fb"]


def test_lines_follow_python(spark):
    texts = ODD + ["".join(p) for p in itertools.product("a\n\r\u2028", repeat=4)]
    got = apply(spark, texts, tx.split_lines(F.col("s")))
    assert [g[0] for g in got] == [t.splitlines() for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\u00a0\u2003\x1c\x1f\n|:-#"), min_size=20, max_size=60))
def test_strip_and_blank_follow_python(spark, texts):
    got = apply(spark, texts, tx.strip(F.col("s")), tx.is_blank(F.col("s")))
    assert got == [(t.strip(), t.strip() == "") for t in texts]


def test_headings(spark):
    lines = ["# Intro", "## Set up ##", "####### no", "#no", "#  x # y #", "### ", " # indented", "#\u00a0wide", "# " + "t" * 250]
    got = apply(
        spark, lines, tx.is_heading(F.col("s")), tx.heading_level(F.col("s")), tx.heading_title(F.col("s"))
    )
    assert got == [
        (True, 1, "Intro"), (True, 2, "Set up"), (False, 0, ""), (False, 0, ""), (True, 1, "x # y"),
        (False, 0, ""), (False, 0, ""), (True, 1, "wide"), (True, 1, "t" * 200),
    ]


def test_table_cells(spark):
    lines = ["| a | b |", " |x|| y", "|---|:-:|", "| - | x |", "||", "---", ""]
    got = apply(spark, lines, tx.table_cells(F.col("s")), tx.is_table_separator(F.col("s")))
    assert got == [
        (["a", "b"], False), (["x", "", "y"], False), (["---", ":-:"], True), (["-", "x"], False),
        ([""], True), (["---"], True), ([""], True),
    ]


GLOBS = ["*", "a/*", "*.md", "a/?.md", "[ab]/*", "[!a]*", "a.*", "*[0-9].md", "[]x]*", "[!]]*", "[z-a]x", "[!z-a]?*",
         "[", "a[", "x(1)+$^.md", "**/c.md", "[a-c-e]*", "[\\]*", "[&&~]*", "é*", "[[]*", "a|b"]
PATHS = ["a/b.md", "a/bb.md", "b/c.md", "c.md", "a.md", "A.MD", "notes/1.md", "]x", "x(1)+$^.md", "[", "a[", "deep/er/c.md",
         "e-", "-", "\\x", "&", "~a", "é.md", "a\nb.md", "", "a|b", "zx", "d"]


def test_globs_follow_fnmatch(spark):
    got = apply(spark, PATHS, *(dialect.matches_glob(F.col("s"), g) for g in GLOBS))
    for path, row in zip(PATHS, got):
        for pattern, answer in zip(GLOBS, row):
            assert answer == fnmatch.fnmatchcase(path, pattern), (path, pattern)


@pytest.mark.parametrize(
    "pattern,prefix",
    [("policies/*.md", "policies/"), ("a/b*/c", "a/"), ("*.md", ""), ("x?", ""), ("a/b/[cd]", "a/b/"), ("a", "")],
)
def test_glob_prefix(pattern, prefix):
    assert dialect.glob_prefix(pattern) == prefix


def test_glob_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a/b.md",), ("c.md",)], "path string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(dialect.matches_glob(F.col("path"), "a/*.md"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a/)" in plan


def test_python_regex(spark):
    import re

    cases = [(r"(?P<w>\w+)-(?P=w)", "née-née"), (r"\bcaf\u00e9\b", "un CAFÉ noir"), (r"x\Z", "ax"), (r"\d+", "\u0663"), (r"a\\Z", "a\\Z")]
    for pattern, text in cases:
        got = apply(spark, [text], F.col("s").rlike(dialect.python_regex(pattern, True)))
        assert got[0][0] == bool(re.search(pattern, text, re.I)), pattern
    with pytest.raises(ValueError, match="invalid regex"):
        dialect.python_regex("(unclosed")


GOOD_KEYS = {
    "tenants/acme/handbook/course-101/intro.pdf": ("original", "acme", "handbook", "course-101/intro.pdf", None, None, None, False),
    "scratch/acme/agent-7/notes/draft.md": ("scratch", "acme", None, "notes/draft.md", "agent-7", None, None, False),
    "derived/text/acme/handbook/01JABCDEF/0007.md": ("derived_text", "acme", "handbook", None, None, "01JABCDEF", 7, False),
    "derived/text/acme/handbook/01JABCDEF/0007.md.metadata.json": ("derived_text", "acme", "handbook", None, None, "01JABCDEF", 7, True),
    "derived/meta/acme/handbook/01JABCDEF/manifest.json": ("derived_meta", "acme", "handbook", None, None, "01JABCDEF", None, False),
    "derived/tree/acme/handbook.json.zst": ("derived_tree", "acme", "handbook", None, None, None, None, False),
}
BAD_KEYS = [
    "tenants/acme/handbook", "tenants/acme/handbook/../x", "tenants/acme/handbook//x", "tenants/acme/handbook/_private/x",
    "other/acme/handbook/x", "derived/text/acme/handbook/ID/7.md", "derived/text/acme/handbook/ID/0007.txt",
    "derived/tree/acme/handbook.json", "derived/meta/acme/handbook/ID/other.json", "tenants/Acme/handbook/x", "", "tenants",
    "scratch/acme/agent", "tenants/acme/ns/a/scratch/b", "derived/text/acme/handbook/0007.md", "derived/tree/acme/x/y.json.zst",
]


def test_parse_key(spark):
    every = [*GOOD_KEYS, *BAD_KEYS]
    got = apply(spark, every, keys.parse_key(F.col("s")), keys.is_indexable(F.col("s")))
    for key, (parsed, indexable) in zip(every, got):
        want = GOOD_KEYS.get(key)
        assert (tuple(parsed) if parsed else None) == want, key
        assert indexable == bool(want and want[0] == "original"), key


def test_admission(spark):
    bad_paths = ["../escape", "/abs/path", "a/../b", "_hidden/x", "a//b", "", "a/", "."]
    assert [r[0] for r in apply(spark, ["a/b.md", "x", *bad_paths], keys.valid_path(F.col("s")))] == [True, True] + [False] * 8
    slugs = ["acme", "a-b_1", "Acme", "ac me", "-lead", ""]
    assert [r[0] for r in apply(spark, slugs, keys.valid_slug(F.col("s")))] == [True, True] + [False] * 4
    got = apply(spark, ["01AB"], keys.derived_text_key(F.lit("acme"), F.lit("ns"), F.col("s"), F.lit(10000)))
    assert got == [(None,)]


def test_guess_type_follows_the_builtin_table(spark):
    known = mimetypes.MimeTypes()
    names = ["a.md", "b/c.PDF", "x.tar.gz", "x.tgz", ".bashrc", "noext", "a.b/c", "p.svgz", "w.docx", "t.json.gz", "..x.txt", "u.unknown", "x.gz"]
    got = apply(spark, names, paths.guess_type(F.col("s")), paths.extension(F.col("s")))
    for name, (kind, ext) in zip(names, got):
        assert kind == (known.guess_type(name)[0] or "application/octet-stream"), name
        assert ext == posixpath.splitext(posixpath.basename(name))[1].lower(), name


def test_small_text_helpers(spark):
    assert apply(spark, ['"abc"', ' "x" ', "plain"], paths.norm_etag(F.col("s"))) == [("abc",), ("x",), ("plain",)]
    assert apply(spark, ["https://h.com//a/../b c.md", "C:\\d\\e.txt", "s3://", "a/./b"], paths.url_path(F.col("s"))) == [
        ("h.com/a/b c.md",), ("C:/d/e.txt",), ("",), ("a/./b",),
    ]
    df = spark.sql("select timestamp'2026-01-02 03:04:05' as a, timestamp'2026-01-02 03:04:05.25' as b")
    row = df.select(paths.iso8601(F.col("a")), paths.iso8601(F.col("b"))).first()
    assert tuple(row) == ("2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.250000+00:00")


def test_markdown_rendering(spark):
    rows = F.array(F.array(F.lit(" a "), F.lit(None).cast("string")), F.array(F.lit("1"), F.lit("2")))
    ragged = F.array(F.array(F.lit("a|b"), F.lit("x\ny")), F.array(F.lit("1")))
    got = spark.range(1).select(tx.table_to_markdown(rows), tx.grid_to_markdown(ragged)).first()
    assert got[0] == "| a |  |\n| --- | --- |\n| 1 | 2 |"
    assert got[1] == "| a\\|b | x y |\n| --- | --- |\n| 1 |  |"
    text = tx.join_row_text(
        F.array(F.lit("one"), F.lit("  ")), F.array(F.array(F.lit(" a "), F.lit("")), F.array(F.lit(" "), F.lit("")))
    )
    assert spark.range(1).select(text).first()[0] == "one\n\na | "


def test_decode_replaces_bad_bytes(spark):
    raw = [b"ok", b"\xff\xfeab", "né".encode()]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, c binary")
    got = [r[0] for r in df.orderBy("i").select(tx.decode_text(F.col("c"))).collect()]
    assert got == [r.decode("utf-8", errors="replace") for r in raw]
