import re

import pytest

from lexweave import catalog
from oracle import SF, compare

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_what_has_no_sql():
    """SQL can say neither how a snippet is cut nor how a tree of markup is written; these have tests of their own."""
    assert set(QUERIES) - set(SQL) == {"search_snippets", "html_to_markdown"}


def test_snippets(spark):
    """Of each hit: a mark, around words of the query only, and no more than 16 words, which stand in the text."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["search_snippets"](spark, SF).collect()
    assert rows
    for r in rows:
        marked = re.findall(r"<mark>(.*?)</mark>", r["snippet"])
        plain = re.sub(r"</?mark>", "", r["snippet"]).strip("…")
        assert marked and all({"the", "of"} & set(re.findall(r"\w+", m.lower())) for m in marked)
        assert len(re.findall(r"[^\W_]+", plain)) <= 16 and plain in texts[r["doc_id"]]


def test_pages_as_markdown(spark):
    """Of each page: its headings and paragraphs, and nothing of its head."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["html_to_markdown"](spark, SF).collect():
        html = pages[r["page_id"]]
        heading = re.search(r"<h1>([^<&]*)</h1>", html)
        assert "<" not in r["markdown"] and "track(" not in r["markdown"] and (heading is None or f"# {heading[1].strip()}\n" in r["markdown"])
        assert r["markdown"].count("](") == html.count("<a href")
