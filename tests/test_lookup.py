"""Indexes of stored tables and the pattern translator, against full scans and Python's ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import values
from shelfmark.functions import patterns
from shelfmark.operators import grep, lookup, text
from shelfmark.schemas import PAGES
from shelfmark.session import scratch_path

DOC = ["tenant_id", "namespace", "entry_id"]

LINES = [
    "", "The cat sat on the mat", "the THEME of it", "error 404: not found", "Error 12", "a.b.c", "foo(bar)", "x_1 y-2",
    "été à la plage", "ÉTÉ", "STRASSE straße", "k K", "s ſ ss", "aaa", "abab abab", "2024-01-15 10:22", "email: me@x.org",
    "tab\there", "nbsp\u00a0here", "line\u2028sep", "cr\rhere", "٣ arabic three", "x² power", "_private", "[bracket]",
    "back\\slash", "aXbXc", "<a><b></a>", "foobar foobaz", "日本語テキスト", "end\n", "two\nlines\n", "naïve café", "ǅ title", "e\u0301 mark",
]

PATTERNS = [
    r"cat", r"the", r"(?i)the", r"th[ae]t? [a-z]+", r"\bthe\b", r"\Bat\b", r"^the", r"mat$", r"\Aerror|\Zx", r"e.r", r"(?s)o.l",
    r"(?m)^lines$", r"\d+", r"\w+@\w+\.\w+", r"\s", r"\S+\s\S+", r"[^\w\s]", r"[\W\d]{2,}", r"[^\W\d_]+\d", r"(?a:\w)é|(?a:\d\d)",
    r"(?P<q>a)(?P=q)", r"(ab)\1", r"(?P<year>\d{4})-(?P<month>\d\d)", r"a{2,}", r"a{,2}X", r"(?:foo)(?=ba[rz])", r"foo(?!bar)",
    r"(?<=foo)baz", r"(?<!foo)bar", r"[[]bracket[]]", r"[a&&b]", r"[a-z&&[^b]]", r"\\s", r"(<)?a(?(1)>|x)", r"(x)?(?(1)_|a)a",
    r"(?>a+)b", r"a++X", r"a*?b", r"x²|\u0663", r"(?i)straße|ſs", r"(?x) a \. b  # spaced", r"[\d\-:]{5}", r"\x41|\u00e9", r"(?i:E)rror \d",
    r"(?-i:E)rror", r"$", r"^$", r"#|~", r"日本", r"\.",
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "n int, t string").cache()


@pytest.mark.parametrize("ignore_case", [False, True])
def test_patterns_find_what_python_finds(lines, ignore_case):
    tests = [F.col("t").rlike(patterns.java_regex(p, ignore_case)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]
    for row in lines.select("t", *tests).collect():
        for n, p in enumerate(PATTERNS):
            want = re.search(p, row["t"], re.IGNORECASE if ignore_case else 0) is not None
            assert row[f"p{n}"] == want, (p, row["t"])


def test_group_numbers_stay(lines):
    regex = patterns.java_regex(r"(?P<user>\w+)@(?P<host>\w)")
    found = lines.select(F.regexp_extract("t", regex, 1).alias("u"), F.regexp_extract("t", regex, 2).alias("h"))
    assert ("me", "x") in values(found)


@pytest.mark.parametrize("bad", ["(", "a{2,1}", "[z-a]", r"(?P<a>x)(?P<a>y)", "*", r"\1", "(?<=a*)b"])
def test_invalid_patterns_are_refused(bad):
    with pytest.raises(ValueError):
        patterns.java_regex(bad)


def test_needed_trigrams():
    need = patterns.needed_trigrams
    assert need("ab") is None and need("a.c.e") is None and need("(?:cat)?") is None and need("cat|x") is None
    assert need("cat") == "cat" and need("CaT") == "cat" and need("c(a)(?:t)") == "cat"
    assert need("cats") == ("all", ("cat", "ats"))
    assert need("cat|dog") == ("any", ("cat", "dog"))
    assert need("c[au]t") == ("any", ("cat", "cut"))
    assert need("(?:cat)+s") == "cat" and need("x?yesé") == "yes"
    assert need(r"cat\b.*dog") == ("all", ("cat", "dog"))


def test_no_match_lacks_a_needed_trigram():
    def ok(need, grams):
        if need is None or isinstance(need, str):
            return need is None or need in grams
        return (all if need[0] == "all" else any)(ok(p, grams) for p in need[1])

    for p in [*PATTERNS, "(?:ab){2} abab", "(?:th|wh)e", "[Tt]he (?:cat|dog) s", "(?:foo(?:bar|baz) ?){2}", "a+bab", "error.*(?:found|x)"]:
        for line in LINES:
            if re.search(p, line, re.IGNORECASE):
                low = line.translate(str.maketrans(*patterns.FOLDED)).lower()
                assert ok(patterns.needed_trigrams(p, True), {low[i : i + 3] for i in range(len(low))}), (p, line)


# --- indexes ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark):
    """Pages of 400 documents in two namespaces, stored by document in some twenty files."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "error", "warning"]
    rows = []
    for d in range(400):
        for p in range(1, 1 + d % 4):
            body = "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(5))
            if d % 97 == 0:
                body += f"\nneedle-{d} İstanbul"
            rows.append((f"t{d % 2}", "ns", f"doc{d:04d}", p, body, None))
    rows += [("t0", "ns", "empty", 1, "", None), ("t0", "ns", "null", 1, None, None), ("t0", "ns", "short", 1, "ab", None)]
    path = scratch_path(spark, "pages")
    laid = spark.createDataFrame(rows, PAGES).repartitionByRange(20, *DOC).sortWithinPartitions(*DOC, "page")
    laid.write.parquet(path)
    return path


def test_key_index_opens_few_files(spark, store):
    index = lookup.key_index(lookup.stored(spark, store, PAGES), DOC)
    requests = spark.createDataFrame([("t0", "ns", "doc0002"), ("t1", "ns", "doc0301"), ("t1", "ns", "doc0301"), ("t0", "ns", None), ("t9", "x", "y")], "tenant_id string, namespace string, entry_id string")
    files = lookup.named(lookup.files_with(index, requests, DOC))
    assert 2 <= len(files) <= 3
    rows = lookup.rows_of(spark, store, PAGES, index, requests, DOC)
    assert len(rows.inputFiles()) == len(files)
    found = rows.join(requests.distinct(), DOC, "left_semi")
    want = lookup.stored(spark, store, PAGES).join(requests.distinct(), DOC, "left_semi")
    assert values(found, *DOC, "page") == values(want, *DOC, "page") != []


@pytest.mark.parametrize("blocks", [None, 1, 3])
def test_key_index_never_misses_a_key(spark, store, blocks):
    rows = lookup.stored(spark, store, PAGES)
    index = lookup.key_index(rows, DOC, blocks).cache()
    assert len(lookup.named(lookup.files_with(index, rows.select(*DOC), DOC))) == len(rows.inputFiles())
    for doc in ("doc0000", "doc0399", "empty", "doc0203"):
        one = rows.where(F.col("entry_id") == doc).select(*DOC).distinct()
        files = lookup.named(lookup.files_with(index, one, DOC))
        here = lookup.stored(spark, store, PAGES, files).where(F.col("entry_id") == doc).count()
        assert here == rows.where(F.col("entry_id") == doc).count()


def test_absent_keys_pass_few_filters(spark, store):
    index = lookup.key_index(lookup.stored(spark, store, PAGES), DOC).cache()
    absent = spark.range(2000).select(
        F.lit("t0").alias("tenant_id"), F.lit("ns").alias("namespace"), F.concat(F.lit("doc0"), F.col("id").cast("string"), F.lit("x")).alias("entry_id")
    )
    *lead, last = DOC
    tried = index.join(absent, lead).where(F.col(last).between(F.col("low"), F.col("high"))).select(lookup.FILE, last).distinct().count()
    passed = sum(len(lookup.named(lookup.files_with(index, absent.where(F.col("entry_id") == f"doc0{n}x"), DOC))) for n in range(0, 12))
    assert tried > 0 and passed <= 2


GREPPED = ["needle-\\d+", "needle-97", "alpha beta gamma", "error.*warning", "İstanbul", "istanbul", "zebra", "gam+a", "a", "(?:needle|zebra)-[0-9]{2}"]


@pytest.mark.parametrize("rows_per_run", [8, 32])
def test_text_index_equals_the_scan(spark, store, rows_per_run):
    pages = lookup.stored(spark, store, PAGES)
    index = lookup.text_index(pages, rows_per_run=rows_per_run).cache()
    total = pages.count()
    for p in [*GREPPED, *PATTERNS[::1 if rows_per_run == 8 else 9]]:
        hit = F.col("text").rlike(patterns.java_regex(p, True))
        some = lookup.rows_matching(spark, store, PAGES, index, p)
        assert values(some.where(hit), *DOC, "page") == values(pages.where(hit), *DOC, "page"), p
        if p.startswith("needle"):
            assert some.count() < total / 4
        if p == "zebra":
            assert some.count() == 0


def test_refresh_indexes_new_files_only(spark, store):
    path, at = scratch_path(spark, "pages"), scratch_path(spark, "index")
    pages = lookup.stored(spark, store, PAGES)
    pages.limit(50).write.parquet(path)
    build = lambda rows: lookup.key_index(rows, DOC)
    first = lookup.refresh(spark, path, PAGES, at, build)
    seen = first.select(lookup.FILE).distinct().count()
    assert lookup.refresh(spark, path, PAGES, at, build).count() == first.count()
    pages.where("entry_id >= 'doc0300'").write.mode("append").parquet(path)
    again = lookup.refresh(spark, path, PAGES, at, build)
    assert again.select(lookup.FILE).distinct().count() > seen
    one = spark.createDataFrame([("t1", "ns", "doc0399")], "tenant_id string, namespace string, entry_id string")
    rows = lookup.rows_of(spark, path, PAGES, again, one, DOC)
    assert rows.where("entry_id = 'doc0399'").count() == 3


def test_empty_store_and_requests(spark):
    path = scratch_path(spark, "pages")
    spark.createDataFrame([], PAGES).write.parquet(path)
    rows = lookup.stored(spark, path, PAGES)
    keys, grams = lookup.key_index(rows, DOC), lookup.text_index(rows)
    none = spark.createDataFrame([], "tenant_id string, namespace string, entry_id string")
    assert lookup.rows_of(spark, path, PAGES, keys, none, DOC).count() == 0
    assert lookup.rows_matching(spark, path, PAGES, grams, "needle").count() == 0


def test_read_moves_no_text(spark, make_corpus):
    texts = {f"d{n}.md": [f"page {p} of {n}" for p in range(1, 4)] for n in range(30)}
    entries, pages = make_corpus(texts)
    path = scratch_path(spark, "pages")
    pages.repartition(6, "entry_id").write.parquet(path)
    index = lookup.key_index(lookup.stored(spark, path, PAGES), DOC)
    requests = spark.createDataFrame(
        [("dev", "handbook", "d3.md", 2, None), ("dev", "handbook", "d9.md", 7, 9), ("dev", "handbook", "gone.md", None, None), ("dev", "handbook", "d3.md", 2, None)],
        "tenant_id string, namespace string, path string, start_page int, end_page int",
    )
    keys = entries.join(requests, ["tenant_id", "namespace", "path"], "left_semi").select(*DOC)
    some = lookup.rows_of(spark, path, PAGES, index, keys, DOC)
    assert len(some.inputFiles()) <= 3 < len(lookup.stored(spark, path, PAGES).inputFiles())
    found = text.read(entries, some, requests)
    assert values(found) == values(text.read(entries, pages, requests))
    assert sorted((r["path"], r["page"], r["error"]) for r in found.collect() if r["path"] == "d3.md") == [("d3.md", p, None) for p in (2, 2, 3, 3)]
    assert {(r["path"], r["page"], r["error"]) for r in found.collect() if r["path"] != "d3.md"} == {("d9.md", None, None), ("gone.md", None, "not_found")}
    moved = [line for line in exchanges(found) if "text" in line]
    assert not moved


def exchanges(df):
    """The output columns of every hash or range exchange of the executed plan."""
    out = []
    df.collect()
    shown = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    for block in shown.split("\n\n"):
        if re.match(r"\(\d+\) Exchange", block):
            out.append(block)
    return out


def test_grep_over_an_indexed_store(spark, make_corpus):
    texts = {f"d{n}.md": [f"common line\nmark {n * 7919 % 1000:03d} here", "other"] for n in range(40)}
    entries, pages = make_corpus(texts)
    path = scratch_path(spark, "pages")
    pages.repartition(5, "entry_id").write.parquet(path)
    index = lookup.text_index(lookup.stored(spark, path, PAGES), rows_per_run=4)
    for pattern in ("mark 919", "common", r"mark 9\d\d"):
        some = lookup.rows_matching(spark, path, PAGES, index, pattern)
        assert values(grep.grep(entries, some, pattern), "path", "page", "line", "text") == values(
            grep.grep(entries, pages, pattern), "path", "page", "line", "text"
        )
