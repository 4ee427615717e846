"""Operators 11 to 13 against brute force: nulls, empty and odd texts, ties, repeated rows, empty tables, columns with clashing names."""

import collections
import math
import re

import numpy as np
import pytest

from lexweave.llm import divergence, lexical, licenses, tokens

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i % 97}x{i % 13} Été{i % 7}" for i in range(400))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "b"), (2, LONG, "en", "b"), (3, LONG + " tail tail the THE", "en", None), (4, None, "en", "d"), (5, "", None, None), (6, "one, two", "fr", "a"),
    (7, "One-TWO", "fr", "b"), (8, "one 2 two\ttwo", "fr", "b"), (9, "ÉCOLE école", "fr", "é"), (10, "alone", "", "a"), (None, LONG[50:900], "en", "a"), (11, "x" * 3000 + " one", "fr", "a"),
    (12, "\x00one\x7ftwo_three", "fr", "a"), (13, "nothing", "zz", "a"), (14, "here", "zz", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, 0, "n", "t") for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, term string, places string")


def diverging(rows):
    groups, seen = collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for r, (_, text, lang, source) in enumerate(rows):
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        for t in found:
            seen[lang or "", t].add(r)
    kept = collections.defaultdict(list)
    for (lang, t), where in seen.items():
        if len(where) >= 3:
            kept[lang].append(t)

    def shares(counts, terms):
        n = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(terms)) for t in terms}

    p = {g: shares(c, kept[g[0]]) for g, c in groups.items()}
    whole = {lang: shares(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()), kept[lang]) for lang, _ in groups}
    for lang, source in groups:
        mine, q = p[lang, source], whole[lang]
        pairs = [(sum((mine[t] - p[lang, s][t]) ** 2 // p[lang, s][t] for t in mine), s) for x, s in groups if x == lang and s != source]
        terms = [((mine[t] - q[t]) ** 2 // q[t], t) for t in mine if groups[lang, source][t] and mine[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= divergence.TOP:
                    yield lang, source, part, item, value, rank


def test_divergence(docs):
    got = [tuple(r) for r in divergence.source_divergence(docs).collect()]
    assert len(got) == len(set(got)) and {r[2] for r in got} == {"pair", "term"}
    assert sorted(got) == sorted(diverging(ROWS))
    assert ("zz", "a", "pair", "b", 0, 1) in got  # a language that keeps no term
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_only_the_first_terms_are_ranked(spark):
    rows = [(i, " ".join(f"{'abcdefghij'[j // 100]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j % 10]}" for j in range(230)), "en", "many" if i < 3 else "few") for i in range(3)]
    rows += [(9 + i, "other words here", "en", "few") for i in range(3)]
    got = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()]
    assert sorted(got) == sorted(diverging(rows))
    assert max(r[5] for r in got if r[2] == "term") == divergence.TOP


def test_shares_of_great_counts(spark):
    """Counts whose products are beyond 64 bits."""
    from pyspark.sql import functions as F

    n, total, terms = 4 * 10**17, 9 * 10**17, 10**6
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 1) // (total + terms)


def ends_of(regions, words, at):
    """All places where the regions can end: by plain recursion."""
    if not regions:
        return {at}
    first, rest = regions[0], regions[1:]
    if isinstance(first, list):
        starts = ends_of(first, words, at) | {at}
    elif isinstance(first, tuple):
        starts = {at + i for i in range(first[0], first[1] + 1) if at + i <= len(words)}
    else:
        starts = {at + 1} if at < len(words) and words[at] in first else set()
    return set().union(*[ends_of(rest, words, s) for s in starts]) if starts else set()


def scanned(text, templates):
    words = WORD.findall((text or "").translate(LOWER))
    found, covered = [], set()
    wordings = [(t, licenses.parsed(t.wording)) for t in templates]
    for at in range(len(words)):
        ends = [(max(e), t) for t, r in wordings if (e := ends_of(r, words, at))]
        most = max((e for e, t in ends if not t.base), default=0)
        here = [(t.label, t.base, at, e) for e, t in ends if t.base or e == most]
        found += here
        for _, _, _, e in here:
            covered |= set(range(at, e))
    return len(words), len(covered), found


NOTICES = [
    None, "", " \n", "Released under the MIT License.", "mit license MIT-LICENSE mit licence", "Licensed under CC BY-NC 4.0.", "cc by nc", "general PUBLIC\tlicense, Apache License",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the GNU General Public License, version 3.", "the GNU Lesser General Public License",
    "MIT License\n\nCopyright (c) 2024 Some One and Others\n\n" + re.sub(r"\(\(|\)\)|\[\[.*?\]\]", "", licenses.TEMPLATES[0].wording.split("permission", 1)[1].join(["Permission", ""])),
    "permission is hereby granted free of charge to any person obtaining another copy", "x" * 4000 + " mit license " + "y " * 3000, "mit", "license mit license", "apacheé license mit_license",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license and more",
]


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_licenses(spark, monkeypatch, piece):
    monkeypatch.setattr(tokens, "PIECE", piece)  # of this process; workers have modules of their own
    templates = licenses.BASE + licenses.TEMPLATES
    a, base = licenses.automaton(templates), frozenset(i for i, t in enumerate(templates) if t.base)
    for text in NOTICES:
        n, found = licenses.places(a, memoryview((text or "").encode()), base)
        n_words, _, want = scanned(text, templates)
        assert n == n_words
        assert sorted((templates[t].label, templates[t].base, x, y) for x, y, t in found) == sorted(want)


def test_license_rows(spark):
    templates = licenses.BASE + licenses.TEMPLATES
    df = spark.createDataFrame([(i % 5 if i else None, t, "kept", 7) for i, t in enumerate(NOTICES)], "doc_id long, text string, label string, N_Words int")
    got = licenses.license_scan(df).collect()
    assert df.columns[:3] == licenses.license_scan(df).columns[:3] and {r["label"] for r in got} == {"kept"}
    by_text = {r["text"]: r for r in got}
    for text in NOTICES:
        n, covered, found = scanned(text, templates)
        r = by_text[text]
        assert (r["n_words"], r["n_covered"], sorted(map(tuple, r["places"]))) == (n, covered, sorted(found))
    rows = {r["n_words"]: r for r in licenses.license_digest(df).collect()}
    assert rows[0]["labels"] == "" and rows[0]["score"] == 0 and rows[0]["first_word"] is None
    assert len(licenses.license_digest(df).collect()) == len(NOTICES)
    mit = next(r for r in licenses.license_digest(df.where("text like 'mit license MIT%'")).collect())
    assert (mit["n_base"], mit["first_word"], mit["last_word"], mit["base_labels"]) == (2, 0, 2, "mit")
    cc = licenses.license_digest(df.where("text like '%CC BY-NC%'")).first()
    assert (cc["labels"], cc["base_labels"], cc["score"]) == ("cc-by-nc", "", 1.0)
    assert licenses.license_digest(df.limit(0)).collect() == []


def test_templates():
    one = (licenses.Template("x", "a ((b [[0-2]] c/d)) e"),)
    a = licenses.compiled(one)
    for text in ("a e", "a b c e", "a b x d e", "a b x y c e", "a b x y z c e", "a b e", "a c e", "a b c c c e", "a a b c e e"):
        assert sorted((x, y) for x, y, _ in licenses.places(a, memoryview(text.encode()), frozenset())[1]) == [(x, y) for _, _, x, y in scanned(text, one)[2]]
    for bad in ("((a))", "[[0-2]] a", ""):
        with pytest.raises(ValueError):
            licenses.compiled((licenses.Template("x", bad),))
    with pytest.raises(ValueError):
        licenses.parsed("a ((b")


def ranked(rows, items, k=10):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t, *_ in rows]
    n_docs, n_words = sum(1 for w in words if w), sum(map(len, words))
    counts = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(WORD.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc_id, *_), w, c in zip(rows, words, counts):
            m = 10 + 90 * len(w) * n_docs // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(0, "w1x1 w2x2 tail ONE"), (1, None), (2, "absent words"), (3, "one one TWO"), (3, "Été3"), (None, "école x"), (4, LONG), (5, "")]


@pytest.mark.parametrize("terms", [1 << 16, 60])
def test_search(spark, docs, monkeypatch, terms):
    """Also with items in several blocks."""
    monkeypatch.setattr(lexical, "TERMS", terms)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in lexical.search(docs, items).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ranked(ROWS, ITEMS)))
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


def test_search_of_many_equal_rows(spark):
    rows = [(i, f"same words here {'often ' * (i % 3)}") for i in range(60)] + [(i, "same words here") for i in (7, 7, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, "same often"), (2, "here")]
    got = [tuple(r) for r in lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 25).collect()]
    assert sorted(got) == sorted(ranked(rows, items, 25))


def test_windows(monkeypatch):
    """Windows of few documents, postings counted in several steps, words longer than a piece: the same scores. (Without Spark.)"""
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"t{x}" for x in rng.zipf(1.6, 40) % 50)) for i in rng.permutation(300)] + [(1000, "t1 " * 500 + "y" * 90), (1001, None)]
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 50, 6))) for i in range(20)]
    monkeypatch.setattr(lexical, "WINDOW", 64)
    monkeypatch.setattr(lexical, "GATHERED", 100)
    monkeypatch.setattr(tokens, "PIECE", 16)
    words = sorted({w for _, t in items for w in tokens.split(t)})
    number = {w.encode(): i for i, w in enumerate(words, 1)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    index = list(lexical._indexed(number)(iter([batch.slice(0, 100), batch.slice(100)])))
    assert len(index) == -(-len(rows) // 64)
    n_docs, n_words = (sum(b.column(c)[0].as_py() for b in index) for c in ("n_docs", "n_words"))
    df = collections.Counter()
    for b in index:
        df.update(dict(zip(b.column("terms")[0].as_py(), b.column("counts")[0].as_py())))
    weights = np.zeros(len(words) + 1, np.int64)
    for t, n in df.items():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    asked = [lexical.Item(i, np.array(sorted({number[w.encode()] for w in tokens.split(t)}))) for i, t in items]
    (out,) = lexical._scored(asked, weights, n_docs, n_words, 10)(iter(index))
    got = sorted(zip(*(out.column(c).to_pylist() for c in ("item_id", "doc_id", "score"))))
    assert got == sorted((i, d, s) for i, _, d, s in ranked(rows, items))


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_words_in_pieces(size):
    for text in ("", "one", "One,TWO  été3\x00x", " a b ", "ab" * 50 + " c", "é" * 30):
        want = WORD.findall(text.translate(LOWER))
        assert [w.decode() for p in tokens.pieces(text.encode(), size) for w in p.split()] == want
        assert np.concatenate([np.zeros(0, int), *tokens.numbered(memoryview(text.encode()), {b"one": 1, b"c": 2}, size)]).tolist() == [{"one": 1, "c": 2}.get(w, 0) for w in want]


PARAGRAPHS = "".join(f"<p>Paragraph {i}, with a good many words in it, so that it counts, as it should, for main text.</p>" for i in range(5))
PLAIN = " ".join(re.findall(r"<p>(.*?)</p>", PARAGRAPHS))
WHOLE = [
    f"<body><form><div>{PARAGRAPHS}</div></body>",
    f"<body><form id=aspnet><nav><a href=u>menu</a></nav><div>{PARAGRAPHS}<fieldset><input><p>A short field, to be filled in, by all.</p></fieldset></div></form></body>",
    f"<body><nav>x</nav><fieldset><div>{PARAGRAPHS}</div></fieldset><form><p>Say what you think about it, if you like to.</p></form></body>",
    f"<body><article>{PARAGRAPHS}</article><form><div>{PARAGRAPHS * 40}</div></form></body>",
    f"<body><main>{PARAGRAPHS}</main><aside><div>{PARAGRAPHS * 9}</div></aside></body>",
]


@pytest.mark.parametrize("page", WHOLE)
def test_forms_around_and_beside_main_text(page):
    """A form that is around the main text stays, one beside it goes, however long."""
    from lexweave.llm import html

    assert html.main_text(page) == PLAIN


def test_articles_in_parts():
    """Parts in other branches are kept if all around them is alike; comments, menus and lists of links are not."""
    from lexweave.llm import html

    page = f"<body><div class=page><div><h1>T</h1>{PARAGRAPHS}</div></div><div class=ad><div>{PARAGRAPHS}</div></div><div class=page><div>{PARAGRAPHS}</div></div><div class=thread><div>{PARAGRAPHS}</div></div></body>"
    assert html.main_text(page) == f"T {PLAIN} {PLAIN}"
    links = PARAGRAPHS.replace("<p>", "<p><a href=u>").replace("</p>", "</a></p>")
    assert html.main_text(f"<body><div class=page><div>{PARAGRAPHS}</div></div><div class=page><div>{links}</div></div></body>") == PLAIN
    deep = f"<section class='a b'><div><div id=x1>{PARAGRAPHS}</div></div></section>"
    assert html.main_text(f"<body>{deep}<section><div><div>{PARAGRAPHS}</div></div></section>{deep.replace('x1', 'x2')}</body>") == f"{PLAIN} {PLAIN}"


def test_pages_without_article(spark):
    """Scoring alone finds what the element says: pages whose article is made a plain block."""
    from lexweave.llm import html
    from oracle import SF

    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        assert html.main_text(re.sub(r"<(/?)article\b", r"<\1div", page)) == html.main_text(page)
