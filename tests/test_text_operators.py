"""Search, reading, outlines, tables and differences on small corpora."""

import difflib
import random
import re

import pytest
from conftest import values
from pyspark.sql import functions as F

from shelfmark import limits
from shelfmark.operators import diff, grep, tables, text

CORPUS = {
    "a.md": ["alpha beta\ngamma", "delta beta"],
    "b.md": ["zeta\nbeta only here"],
    "notes/c.md": ["nothing here"],
    "scan.pdf": None,
}


@pytest.fixture(scope="module")
def corpus(make_corpus):
    return make_corpus(CORPUS)


def where(found):
    return values(found, "path", "page", "line")


def test_grep(corpus):
    hits, summary = grep.grep_bounded(*corpus, "beta")
    assert where(hits) == [("a.md", 1, 1), ("a.md", 2, 1), ("b.md", 1, 2)]
    row = summary.first()
    assert (row.files_searched, row.truncated) == (3, False)
    assert where(grep.grep(*corpus, "BETA")) == where(hits)
    assert where(grep.grep(*corpus, "BETA", ignore_case=False)) == []
    assert where(grep.grep(*corpus, "beta", path_glob="a.*")) == [("a.md", 1, 1), ("a.md", 2, 1)]


def test_grep_bounds(corpus):
    hits, summary = grep.grep_bounded(*corpus, "beta", max_matches=1)
    assert where(hits) == [("a.md", 1, 1)]
    assert summary.first().truncated
    with pytest.raises(ValueError, match="invalid regex"):
        grep.grep(*corpus, "(unclosed")


def test_grep_within_one_namespace(make_corpus):
    here, there = make_corpus(CORPUS), make_corpus({"z.md": ["beta"]}, ns="other")
    both = [a.unionByName(b) for a, b in zip(here, there)]
    hits, summary = grep.grep_bounded(*both, "beta", within=("dev", "other"))
    assert where(hits) == [("z.md", 1, 1)] and summary.count() == 1
    hits, summary = grep.grep_bounded(*both, "beta", max_files=1)
    assert where(hits) == [("a.md", 1, 1), ("a.md", 2, 1), ("z.md", 1, 1)]
    assert values(summary, "namespace", "files_searched", "file_cap_hit") == [("handbook", 1, True), ("other", 1, False)]


def test_large_candidate_lists_are_not_broadcast(spark, corpus):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = where(grep.grep(*corpus, "beta", path_glob="*.md"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert where(grep.grep(*corpus, "beta", path_glob="*.md")) == want
        assert values(grep.grep_files(*corpus, "beta", path_glob="a*"), "path") == [("a.md",)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_grep_context(corpus):
    row = grep.grep(*corpus, "gamma", context_lines=1).first()
    assert (row.before, row.after) == (["alpha beta"], [])
    row = grep.grep(*corpus, "^alpha", context_lines=3).first()
    assert (row.before, row.after) == ([], ["gamma"])


def test_grep_files(corpus):
    assert values(grep.grep_files(*corpus, "beta|nothing"), "path") == [("a.md",), ("b.md",), ("notes/c.md",)]
    files, _ = grep.grep_bounded(*corpus, "beta", files_with_matches=True)
    assert values(files, "path") == [("a.md",), ("b.md",)]


def test_long_lines_are_cut(make_corpus):
    row = grep.grep(*make_corpus({"x.md": ["é" * 400 + "z"]}), "z$").first()
    assert row.text == "é" * limits.GREP_LINE_CHARS


def test_all_hits_whole(make_corpus):
    lines = [f"hit {i}" for i in range(30)] + ["hit " + "é" * 400]
    corpus = make_corpus({"x.md": ["\n".join(lines), "hit on two"]})
    assert sorted(where(grep.grep(*corpus, "hit"))) == [("x.md", 1, i + 1) for i in range(31)] + [("x.md", 2, 1)]
    assert len(where(grep.grep(*corpus, "hit", max_matches_per_file=25))) == 25
    rows = {(r.page, r.line): r for r in grep.grep(*corpus, "hit", context_lines=8, line_chars=None).collect()}
    assert rows[1, 31].text == lines[30] and rows[1, 20].before == lines[11:19] and rows[1, 25].after == lines[25:]
    assert len(grep.grep_bounded(*corpus, "hit", context_lines=8)[0].orderBy("line").collect()[-1].before) == 5


def walk(texts, pattern, max_files, max_matches, per_file, budget, files_only):
    """The budgets as one reader would apply them, document after document."""
    rx = re.compile(pattern, re.I)
    spent, found, named, searched, cut = 0, [], [], 0, False
    for path in sorted(texts)[:max_files]:
        if spent >= budget or len(found) >= max_matches:
            cut = True
            break
        searched += 1
        mine = 0
        for number, page in enumerate(texts[path], 1):
            if spent >= budget:
                cut = True
                break
            spent += len(page.encode())
            for n, line in enumerate(page.splitlines(), 1):
                if mine < per_file and len(found) < max_matches and rx.search(line):
                    mine += 1
                    if files_only:
                        named.append((path,))
                        mine = per_file
                    else:
                        found.append((path, number, n))
            if mine >= per_file or len(found) >= max_matches:
                break
    return (sorted(named) if files_only else sorted(found)), searched, cut


@pytest.mark.parametrize("files_only", [False, True])
def test_grep_budgets_against_a_loop(spark, make_corpus, files_only):
    rng = random.Random(7 + files_only)
    for _ in range(4):
        texts = {
            f"d{i:02d}.md": [
                "\n".join(rng.choice(["hit", "miss", "x" * rng.randint(0, 30)]) for _ in range(rng.randint(1, 5)))
                for _ in range(rng.randint(1, 4))
            ]
            for i in range(rng.randint(2, 9))
        }
        kw = dict(
            max_files=rng.randint(2, 9), max_matches=rng.randint(1, 12),
            max_matches_per_file=rng.randint(1, 4), byte_budget=rng.choice([20, 60, 150, 10**6]),
        )
        hits, summary = grep.grep_bounded(*make_corpus(texts), "hit", files_with_matches=files_only, **kw)
        want, searched, cut = walk(
            texts, "hit", kw["max_files"], kw["max_matches"],
            kw["max_matches_per_file"], kw["byte_budget"], files_only,
        )
        got = values(hits, "path") if files_only else where(hits)
        row = summary.first()
        assert (got, row.files_searched, row.truncated) == (want, searched, cut), (texts, kw)
        assert row.file_cap_hit == (len(texts) > kw["max_files"])


GUIDE = {
    "guide.md": ["# Intro\n\nhello\n\n## Setup\ndetails", "## Security\nlock\n\n## Appendix\nmore"],
    "plain.md": ["no headings here"],
    "leave.pdf": None,
}


@pytest.fixture(scope="module")
def guide(make_corpus):
    return make_corpus(GUIDE)


def test_outline(guide):
    got = values(text.outline(*guide), "path", "ordinal", "level", "title", "page", "truncated")
    assert got == [
        ("guide.md", 1, 1, "Intro", 1, False), ("guide.md", 2, 2, "Setup", 1, False),
        ("guide.md", 3, 2, "Security", 2, False), ("guide.md", 4, 2, "Appendix", 2, False),
    ]
    cut = text.outline(*guide, max_headings=2)
    assert values(cut, "title", "truncated") == [("Intro", True), ("Setup", True)]


def test_whole_answers_reach_the_last_page(spark, make_corpus):
    """Eighty pages, five headings each; the section that is asked for starts on page sixty."""
    title = "t" * 300
    many = [f"## {n} {title}\n" + "\n".join(f"### {n}.{k}" for k in range(4)) + "\n\n| a |\n|---|\n| 1 |" for n in range(1, 81)]
    many[59] = many[59].replace("## 60 ", "# Late ")
    corpus = make_corpus({"long.md": many, "short.md": ["# One"]})
    whole = text.outline(*corpus, max_headings=None, max_pages=None, title_chars=None)
    rows = whole.where("path = 'long.md'").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, 401)) and not any(r.truncated for r in rows)
    assert [r.page for r in rows] == [n for n in range(1, 81) for _ in range(5)]
    assert rows[0].title == f"1 {title}"
    some = text.outline(*corpus, max_headings=350, max_pages=None).where("path = 'long.md'").collect()
    assert sorted(r.ordinal for r in some) == list(range(1, 351)) and all(r.truncated for r in some)
    asked = ask(spark, ("long.md", "late"), schema="path string, section string")
    assert sorted(r.page for r in text.read_section(*corpus, asked, max_pages=None).collect()) == list(range(60, 81))
    assert sorted(r.page for r in text.read_section(*corpus, asked).collect()) == list(range(60, 80))
    range_ = ask(spark, ("long.md", 2, None), schema="path string, start_page int, end_page int")
    assert sorted(r.page for r in text.read(*corpus, range_, max_pages=None).collect()) == list(range(2, 81))
    found = tables.tables(*corpus, max_pages=None, max_tables=None, max_rows=None).collect()
    assert sorted((r.table_no, r.page) for r in found) == [(n, n) for n in range(1, 81)]
    assert not any(r.truncated for r in found)


def ask(spark, *rows, schema):
    return spark.createDataFrame([("dev", "handbook", *r) for r in rows], "tenant_id string, namespace string, " + schema)


def test_read_section(spark, guide):
    asked = ask(
        spark, ("guide.md", " setup "), ("guide.md", "SECURITY"), ("guide.md", "intro"), ("guide.md", "nowhere"),
        ("leave.pdf", "x"), schema="path string, section string",
    )
    got = values(text.read_section(*guide, asked), "section", "page", "error")
    assert got == [
        (" setup ", 1, None), (" setup ", 2, None), ("SECURITY", 2, None), ("intro", 1, None), ("intro", 2, None),
        ("nowhere", None, "no_section"), ("x", None, "catalog_only"),
    ]


def test_sections_behind_the_outline(spark, make_corpus):
    long = ["# Start"] + ["text"] * 53 + ["## Late\nx"] + ["text"] * 2 + ["## After"] + ["text"] * 2
    dense = ["\n".join(f"## h{i}" for i in range(400)), "# Last\ny", "z"]
    corpus = make_corpus({"long.md": long, "dense.md": dense})
    asked = ask(
        spark, ("long.md", "late"), ("long.md", "after"), ("long.md", "start"), ("dense.md", "h399"), ("dense.md", "last"),
        schema="path string, section string",
    )
    got = values(text.section_ranges(*corpus, asked), "path", "section", "start_page", "end_page")
    assert sorted(got) == [
        ("dense.md", "h399", 1, 2), ("dense.md", "last", 2, 3),
        ("long.md", "after", 58, 60), ("long.md", "late", 55, 58), ("long.md", "start", 1, 60),
    ]
    read = values(text.read_section(*corpus, asked.where("section = 'late'")), "page", "error")
    assert read == [(55, None), (56, None), (57, None), (58, None)]
    cut = values(text.section_ranges(*corpus, asked, bounded=True), "path", "section", "start_page")
    assert ("long.md", "late", None) in cut and ("long.md", "start", 1) in cut


def test_read_ranges(spark, make_corpus):
    corpus = make_corpus({"long.md": [f"p{i}" for i in range(1, 31)], "leave.pdf": None})
    asked = ask(
        spark, ("long.md", 1, None), ("long.md", 29, 40), ("long.md", 3, 4), ("long.md", -5, 2), ("long.md", 31, None),
        ("leave.pdf", 1, None), ("gone.md", 1, None), ("../x", 1, None), schema="path string, start_page int, end_page int",
    )
    got = {}
    for r in text.read(*corpus, asked).collect():
        key = (r.path, r.start_page)
        got.setdefault(key, ([], r.range_start, r.range_end, r.truncated, r.error))[0].append(r.page)
    assert sorted(got["long.md", 1][0]) == list(range(1, 21)) and got["long.md", 1][1:] == (1, 20, True, None)
    assert sorted(got["long.md", 29][0]) == [29, 30] and got["long.md", 29][1:] == (29, 30, True, None)
    assert sorted(got["long.md", 3][0]) == [3, 4] and got["long.md", 3][1:] == (3, 4, True, None)
    assert sorted(got["long.md", -5][0]) == [1, 2]
    assert got["long.md", 31] == ([None], 31, 31, False, None)
    assert got["leave.pdf", 1][4] == "catalog_only"
    assert got["gone.md", 1][4] == "not_found"
    assert got["../x", 1][4] == "invalid_path"


def test_tables(make_corpus):
    corpus = make_corpus({"r.md": ["| Region | Sales |\n| --- | --- |\n| EU | 10 |\n| US | 20 |\n\nnotes"], "n.md": ["a | b"]})
    row = tables.tables(*corpus).collect()
    assert len(row) == 1
    assert (row[0].path, row[0].header, row[0].rows) == ("r.md", ["Region", "Sales"], [["EU", "10"], ["US", "20"]])


def scan_tables(page):
    """Tables as a pattern over line classes: P pipe row and rule, p pipe row, s rule only."""
    lines = page.splitlines()

    def cells(line):
        return [cell.strip() for cell in re.sub(r"^\|+|\|+$", "", line.strip()).split("|")]

    def letter(line):
        row = line.lstrip().startswith("|")
        rule = not any(c and not re.fullmatch(":?-+:?", c) for c in cells(line))
        return {(True, True): "P", (True, False): "p", (False, True): "s", (False, False): "x"}[row, rule]

    found = re.finditer("[Pp][Ps][Pp]*", "".join(map(letter, lines)))
    grids = [[cells(line) for line in lines[m.start() : m.end()]] for m in found]
    return [(grid[0], grid[2:]) for grid in grids]


def test_tables_against_a_scan(spark, make_corpus):
    rng = random.Random(3)
    kinds = ["| a | b |", "| 1 |", "|---|---|", "---", "", "text", " | x", "|:-:|", "||", "a | b"]
    texts = {f"t{i:03d}.md": ["\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 12)))] for i in range(120)}
    got = {}
    for r in tables.tables(*make_corpus(texts)).orderBy("path", "table_no").collect():
        got.setdefault(r.path, []).append((r.header, r.rows))
    assert got == {p: scan_tables(t[0]) for p, t in texts.items() if scan_tables(t[0])}


def test_table_rows_are_capped(make_corpus):
    body = "\n".join(f"| {i} |" for i in range(250))
    row = tables.tables(*make_corpus({"big.md": [f"| n |\n|---|\n{body}"]})).first()
    assert len(row.rows) == limits.TABLE_ROWS and row.truncated
    whole = tables.tables(*make_corpus({"big.md": [f"| n |\n|---|\n{body}"]}), max_rows=None).first()
    assert len(whole.rows) == 250 and not whole.truncated


def test_diff(spark, make_corpus):
    old, new = "line one\nline two\nline three", "line one\nline TWO changed\nline three"
    corpus = make_corpus({"v1.md": [old], "v2.md": [new], "leave.pdf": None})
    asked = ask(
        spark, ("v1.md", "v2.md"), ("v1.md", "v1.md"), ("v1.md", "leave.pdf"), ("v1.md", "gone.md"),
        schema="path_a string, path_b string",
    )
    got = {(r.path_a, r.path_b): r for r in diff.diff(*corpus, asked).collect()}
    want = "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), "v1.md", "v2.md", lineterm=""))
    assert got["v1.md", "v2.md"].diff == want
    assert got["v1.md", "v1.md"].diff == ""
    assert got["v1.md", "leave.pdf"].error == "catalog_only"
    assert got["v1.md", "gone.md"].error == "not_found"
    changed = values(diff.diff_lines(*corpus, asked), "line", "removed", "added")
    assert changed == [("line TWO changed", 0, 1), ("line two", 1, 0)]


def test_unreadable_pairs(spark, make_corpus):
    entries, _ = make_corpus({"a.md": ["x"], "b.md": ["x"], "leave.pdf": None})
    pairs = [("a.md", "b.md"), ("a.md", "leave.pdf"), ("nowhere", "leave.pdf"), ("leave.pdf", "nowhere"), ("a.md", "nowhere")]
    asked = ask(spark, *pairs, *pairs, schema="path_a string, path_b string")
    assert values(diff.unreadable_pairs(entries, asked), "path_a", "path_b", "error") == [
        ("a.md", "leave.pdf", "catalog_only"), ("a.md", "nowhere", "not_found"),
        ("leave.pdf", "nowhere", "catalog_only"), ("nowhere", "leave.pdf", "not_found"),
    ]


def test_diff_lines_of_all_pages(spark, make_corpus):
    same = [f"same {i}" for i in range(25)]
    texts = {
        "p.md": same, "q.md": same[:22] + ["other", "other"] + same[24:], "one.md": ["\n".join(same)],
        "ends.md": ["a\n", "b\n"], "flat.md": ["a\n\nb"], "empty.md": [""], "leave.pdf": None,
    }
    asked = ask(
        spark, ("p.md", "q.md"), ("p.md", "q.md"), ("p.md", "one.md"), ("p.md", "p.md"), ("ends.md", "flat.md"),
        ("empty.md", "flat.md"), ("p.md", "leave.pdf"), schema="path_a string, path_b string",
    )
    got = values(diff.diff_lines(*make_corpus(texts), asked), "path_a", "path_b", "line", "removed", "added")
    assert sorted(got) == [
        ("empty.md", "flat.md", "", 0, 1), ("empty.md", "flat.md", "a", 0, 1), ("empty.md", "flat.md", "b", 0, 1),
        ("p.md", "q.md", "other", 0, 2), ("p.md", "q.md", "same 22", 1, 0), ("p.md", "q.md", "same 23", 1, 0),
    ]


def test_diff_bounds(spark, make_corpus):
    corpus = make_corpus({
        "a.md": ["\n".join(f"a{i}" for i in range(600))], "b.md": ["\n".join(f"b{i}" for i in range(600))],
        "p.md": [f"same {i}" for i in range(25)], "q.md": [f"same {i}" for i in range(20)] + ["other"] * 5,
    })
    asked = ask(spark, ("a.md", "b.md"), ("p.md", "q.md"), schema="path_a string, path_b string")
    got = {r.path_a: r for r in diff.diff(*corpus, asked).collect()}
    assert len(got["a.md"].diff.split("\n")) == limits.DIFF_LINES and got["a.md"].truncated
    assert got["p.md"].diff == "" and got["p.md"].pages_truncated


def test_whole_answers_look_at_each_page_once(spark, make_corpus):
    """Numbering all tables or headings partitions them by range, which must not parse the pages again."""
    table = "| h{0} | v |\n| --- | --- |\n| {0} | x |"
    texts = {f"{d}.md": [f"# {d} {p}\n\n" + table.format(p) + "\n\n" + table.format(-p) for p in range(1, 9)] for d in "abc"}
    entries, pages = make_corpus({**texts, "gone.md": None})
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    watched = pages.withColumn("text", F.udf(look, "string").asNondeterministic()("text"))
    found = tables.tables(entries, watched, max_pages=None, max_tables=None, max_rows=None).collect()
    assert seen.value == pages.count()
    assert sorted((r.path, r.table_no, r.page, r.header[0], r.rows) for r in found) == [
        (f"{d}.md", 2 * p - 1 + n, p, f"h{v}", [[str(v), "x"]])
        for d in "abc" for p in range(1, 9) for n, v in enumerate((p, -p))
    ]
    seen.value = 0
    heads = text.outline(entries, watched, max_headings=None, max_pages=None).collect()
    assert seen.value == pages.count()
    assert sorted((r.path, r.ordinal, r.title) for r in heads) == [(f"{d}.md", p, f"{d} {p}") for d in "abc" for p in range(1, 9)]
