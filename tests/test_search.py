"""Folding, fragments of texts, and many queries at once."""

import itertools
import random
import re
import unicodedata

import pytest

from lexweave.functions import text
from lexweave.operators import combined, search


def test_text_and_query_are_folded_alike(spark):
    r = random.Random(4)
    pool = [*"aAeEzZ 12-_.", "é", "É", "e\u0301", "ệ", "Việt", "Ελλάδα", "ΛΌΓΟΣ", "Й", "ß", "Ł", "ﬁ", "İ", "ñ", "\u0301", "中文", "한글", "अ", "Ǆ", "ộ", "ϓ"]
    rows = ["".join(r.choices(pool, k=12)) for _ in range(300)] + ["", "Việt Nam", "Ελλάδα", "cafe\u0301", "café"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for x in df.select("t", text.folded(df.t).alias("f"), text.tokens(df.t).alias("k")).collect():
        assert x["f"] == text.folded_text(x["t"]), x
        assert x["k"] == [w for w in re.split(r"[\W_]+", x["f"]) if w] or unicodedata.normalize("NFD", x["t"]) != x["t"], x
    found = lambda q: sorted(x["t"] for x in df.where("i >= 300").where(search.matches(q, df.t)).collect())
    assert found("Việt") == found("viet") == ["Việt Nam"] and found("Ελλάδα") == ["Ελλάδα"]
    assert found("café") == found("cafe\u0301") == found("CAFE") == sorted(["cafe\u0301", "café"])


def best_of_all(tokens, starts, phrases, width):
    """The best score over every start."""

    def score(s):
        here = [k for k, p in enumerate(phrases) for i in range(s, s + width - len(p) + 1) if tokens[i : i + len(p)] == p]
        return 1000 * len(set(here)) + len(here) + (100 if s in starts else 0), len(here)

    return max((score(s)[0] for s in range(len(tokens)) if score(s)[1]), default=None), score


def test_fragments():
    r = random.Random(7)
    for _ in range(400):
        tokens = r.choices("abcdefgh", k=r.randint(1, 60))
        starts = {0, *r.sample(range(len(tokens)), len(tokens) // 9)}
        phrases = [list(p) for p in dict.fromkeys(tuple(r.choices("abcdz", k=r.randint(1, 3))) for _ in range(r.randint(1, 4)))]
        width = r.randint(3, 16)
        s, found = text.fragment(tokens, starts, phrases, width)
        assert found == sorted(found) and set(found) == {(i, i + len(p)) for p in phrases for i in range(len(tokens)) if tokens[i : i + len(p)] == p}
        best, score = best_of_all(tokens, starts, phrases, width)
        if best is not None:  # a fragment that is moved to be centred keeps its places
            assert score(s)[0] >= best - (100 if s not in starts else 0) and score(s)[0] // 1000 == best // 1000, (tokens, starts, phrases, width, s)


SHOWN = [
    ("One. Two of the three, of-the!", "One. Two <mark>of the</mark> three, <mark>of-the</mark>!"),
    ("x " * 30 + "of the end. Here is more of the same, and so on it goes for a while until it is over and done", "…Here is more <mark>of the</mark> same, and so on it goes for a while…"),
    ("nothing", "nothing"), ("", ""), (None, None), ("... !", "... !"), ("Of  The", "<mark>Of  The</mark>"), ("o\u0301f ó", "o\u0301f ó"),
]


@pytest.mark.parametrize("given,want", SHOWN)
def test_snippets(given, want):
    assert text.snippet_of(given, [["of", "the"]], 14) == want


def test_marks_are_merged_and_cut_text_stands_in_the_text():
    assert text.snippet_of("a b a b a c", [["a", "b", "a"], ["c"]]) == "<mark>a b a b a</mark> <mark>c</mark>"
    whole = " ".join(f"w{i}" for i in range(100))
    got = text.snippet_of(whole, [["w50"], ["w55"]])
    assert re.sub("[…]|</?mark>", "", got) in whole and "<mark>w50</mark>" in got and "<mark>w55</mark>" in got and len(got.split()) == 16


ENTRIES = [
    (1, "A", 0, "God so LOVED the world", ["Love", "beloved", "true love"]), (2, "A", 1, "well then known", ["love_it"]), (3, "A", 5000, "a well-known fact", []), (4, "B", 0, "Café world", ["love"]), (5, "B", 1, None, None), (6, None, 1, "the world", ["in  the", "Lo"]),
    *[(10 + i, "C", 3 * i, "world of one", []) for i in range(3000)],
]
ASKED = [(0, "loved world"), (1, "known well"), (2, "well-known"), (3, "cafe"), (4, "..."), (5, "love"), (6, "h02"), (7, " "), (8, None), (9, "world"), (10, "LO"), (11, "lo%e"), (12, "the"), (13, "l_ve"), (14, "world  LOVED"), (15, "lo"), (16, "H2")]


def test_many_queries_at_once(spark):
    tags = lambda words: None if words is None else [(i, w, [f"H{len(w)}", "H2"] if i else [f"H{len(w)}"]) for i, w in enumerate(words)]
    entries = spark.createDataFrame([(i, s, p, t, tags(w)) for i, s, p, t, w in ENTRIES], "id long, source string, place long, text string, words array<struct<word_index:int,surface_text:string,numbers:array<string>>>")
    queries = spark.createDataFrame(ASKED, "query_id int, query string")
    out = combined.combined(entries, queries, cap=50)
    got = {}
    for q, part, source, item, n in out.collect():
        got.setdefault((q, part), []).append((source, item, n))
    want = {}
    for q, query in ASKED:
        phrases = search.query_phrases(query or "")
        hits = {}
        for i, source, place, t, w in sorted(ENTRIES, key=lambda e: (str(e[1]), e[2], e[0])):
            padded = f" {' '.join(x for p in search.query_phrases(t or '') for x in p)} "
            if phrases and all(f" {' '.join(p)} " in padded for p in phrases):
                hits.setdefault(source, []).append(str(i))
            term = (query or "").strip().lower()
            number = "H2" if term in ("h02", "h2") else None
            like = re.compile("".join("." if c == "_" else ".*" if c == "%" else re.escape(c) for c in term))
            for k, x, numbers in tags(w or []):
                if term and (number in numbers if number else any(like.match(x.lower()[at:]) for at in [0, *[m.end() for m in re.finditer(" ", x)]])):
                    want.setdefault((q, "slots"), {}).setdefault((None, None), []).append(1)
                    for h in numbers:
                        if number in (None, h):
                            want.setdefault((q, "number"), {}).setdefault((source, h), []).append(1)
        for source, ids in hits.items():
            want.setdefault((q, "hit"), {}).update({(source, i): n for n, i in enumerate(ids[:50], 1)})
            want.setdefault((q, "total"), {})[source, None] = len(ids)
    flat = {k: sorted(((s, i, n if isinstance(n, int) else len(n)) for (s, i), n in v.items()), key=str) for k, v in want.items()}
    assert {k: sorted(v, key=str) for k, v in got.items()} == flat
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ExistingRDD") + plan.count("LogicalRDD") == 3  # the entries once, the queries before and after


def test_tokens_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexweave.sources import tables

    texts_ = ["of the end and of it", "the of", "of and the", "and of the", "", "of the the and"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "entry_id int, text string")
    tables.save_tokens(docs.select("entry_id", F.posexplode(text.tokens(docs.text)).alias("place", "token")), f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    for query in ("of-the", "of-the and", "the", "and-of-the", "zzz the", "...", "the-the"):
        want = [r["entry_id"] for r in docs.where(search.matches(query, docs.text)).collect()]
        assert sorted(r["entry_id"] for r in search.by_tokens(stored, query).collect()) == sorted(want), query
    plan = search.by_tokens(stored, "of the")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token, [of,the])" in plan or "In(token" in plan


def test_no_prefix_is_lost():
    assert all(len(set(p)) == len(p) for p in itertools.chain([text.FOLD_FROM]))


def test_a_text_is_not_copied_for_each_of_its_tokens(spark):
    """Beside each of so many tokens the whole text would be some 6 GB. Entries of one id and place answer for themselves."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "A", 1, long, None), (2, "A", 2, "w7 w8", None), (2, "A", 2, "w29999", None), (3, "A", 3, "w29999 w7", [(0, "w7", ["H1"]), (1, "W7", ["H1"]), (2, "w7", None)])]
    entries = spark.createDataFrame(rows, "id long, source string, place long, text string, words array<struct<word_index:int,surface_text:string,numbers:array<string>>>")
    out = combined.combined(entries, spark.createDataFrame([(1, "w29999 w7"), (2, "w7-w8"), (3, "w7 w7")], "query_id int, query string"))
    got = {(r["query_id"], r["part"], r["item"], r["n"]) for r in out.collect()}
    want = {(1, "hit", "1", 1), (1, "hit", "3", 2), (1, "total", None, 2), (2, "hit", "1", 1), (2, "hit", "2", 2), (2, "total", None, 2)}
    want |= {(3, "hit", "1", 1), (3, "hit", "2", 2), (3, "hit", "3", 3), (3, "total", None, 3)}
    assert got == want
