"""Queries against their SQL over documents that are empty, blank at an end, or end in a newline."""

import check
import duckdb
import pytest

from shelfmark.operators import text

SMALL = "/root/testdata/sf0.001"
LONG = "\n".join(f"line {n} of a text that goes on" for n in range(23))
TEXTS = [
    "", LONG, "", LONG + "\n", "one", "\n".join(["a line"] * 10) + "\n", LONG + "\n\n", "", "\n" + LONG,
    "\n".join(["a line"] * 9 + ["", "the page before ends in a blank line"]), "x\n", "", "two\nlines", "", "",
]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """The smallest tables, with other documents, on which quality and toxicity are marked in part."""
    made = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for name in check.TABLES:
        if name not in ("documents", "labels"):
            (made / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE l (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    for n, text in enumerate(TEXTS * 2):
        con.execute("INSERT INTO d VALUES (?, ?, ?, ?, ?)", [n, text, ("de", "en", "fr")[n // 4 % 3], f"src{n % 3}", len(text)])
        if n % 2:
            con.execute("INSERT INTO l VALUES (?, 1, ?)", [n, n // 2 % 2])
    con.execute(f"COPY d TO '{made}/documents.parquet' (FORMAT parquet)")
    con.execute(f"COPY l TO '{made}/labels.parquet' (FORMAT parquet)")
    return str(made)


@pytest.mark.parametrize("name", ["text_checksum", "quality_report", "quality_gate", "history_pages", "delete_documents", "lines", "read_all"])
def test_query_on_odd_texts(spark, odd_dir, name):
    ok, note = check.compare(spark, check.connect(odd_dir), odd_dir, name)
    assert ok, note


def test_lines_of_cut_pages(spark, make_pages):
    """Pages that were cut between two lines keep a last line that is empty; others follow Python's rule."""
    pages = make_pages({"a": ["", "x\n", "x\n\ny", "\n"]})
    kept = text.lines(pages, ended=False).orderBy("page", "line").collect()
    assert [(r.page, r.line, r.line_text) for r in kept] == [
        (1, 1, ""), (2, 1, "x"), (2, 2, ""), (3, 1, "x"), (3, 2, ""), (3, 3, "y"), (4, 1, ""), (4, 2, ""),
    ]
    ended = text.lines(pages).orderBy("page", "line").collect()
    assert [(r.page, r.line, r.line_text) for r in ended] == [
        (2, 1, "x"), (3, 1, "x"), (3, 2, ""), (3, 3, "y"), (4, 1, ""),
    ]
