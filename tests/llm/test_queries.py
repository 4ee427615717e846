"""Queries against their SQL, and edge cases of each operator: nulls, empty and odd texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import bpe, chat, html, jaccard, kernels, mixing, phrases, quality, queries, sharding, suffixes, topk
from oracle import SF, compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(400))
TEXTS = [
    (1, LONG, "b"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " tail", None), (4, None, "a"), (5, "", None), (6, "one two", "b"), (7, "one two", "c"),
    (None, LONG, "a"), (8, "\t \n", "b"), (9, "é" * 300 + " x", "b"), (10, LONG[50:900], "c"), (11, "a " * 5000, "a"), (12, "ONE two", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in TEXTS], "doc_id long, text string, source string, n_words int, h string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def removed_bytes(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [None, 2])
def test_suffixes(docs, real, monkeypatch, most):
    """Also with anchors that overflow a block on every level."""
    if most:
        monkeypatch.setattr(suffixes, "most_stretches", lambda size: most)
    for df in (docs, real):
        got = suffixes.suffix_digest(df).collect()
        texts = [r["text"] for r in df.select("text").collect()]
        assert sorted(map(str, [tuple(r)[1:] for r in got])) == sorted(map(str, removed_bytes(texts)))


def test_suffixes_of_regular_texts(spark):
    """Regular strings that a plain polynomial can't tell apart, and texts that repeat within themselves."""
    r = np.random.default_rng(3)
    one = bytes(r.integers(97, 101, 1500, dtype=np.uint8)).decode()
    morse = "0"
    while len(morse) < 2048:
        morse += morse.translate({48: "1", 49: "0"})
    texts = [one + "x" + one[200:900], one[100:700], morse, morse.translate({48: "1", 49: "0"}), "aé" * 700]
    got = suffixes.suffix_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(str, [tuple(r)[1:] for r in got])) == sorted(map(str, removed_bytes(texts)))
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in texts[2:4])
    at = np.array([0]), np.array([2048])
    assert kernels.Spans(a).hashes(*at) != kernels.Spans(b).hashes(*at)


def long_texts():
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    return [words("a", 300), words("b", 50) + "\t " + words("a", 200), "x" * 500 + " " + words("c", 90) + "y" * 900, " " * 700 + "z", "z", None, words("A", 300) + " tail"]


@pytest.mark.parametrize("piece", [60, 400])
def test_long_texts_in_parts(monkeypatch, piece):
    """What is hashed in parts, with words longer than a part among them, is what is hashed whole. (Without Spark: workers have modules of their own.)"""
    texts = long_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    data, off = kernels.buffers(batch.column("text"))
    sets = [s.tolist() for s in jaccard.shingle_sets(batch)]
    unit = pa.RecordBatch.from_arrays([batch.column("text"), pa.array(range(len(texts))), pa.array([False] * len(texts))], names=["text", "k", "twice"])

    def windows():
        names = ["h", "c", "k", "twice", "first", "last"]
        rows = [r for out in suffixes._anchor_rows(50, 10, names)(iter([unit])) for r in out.to_pylist()]
        return sorted((r["k"], w, r["h"]) for r in rows for w in range(r["first"], r["last"] + 1))

    whole = windows()
    assert len(whole) == sum(max(len(t or "") - 49, 0) for t in texts)
    monkeypatch.setattr(kernels, "PIECE", piece)
    assert [s.tolist() for s in jaccard.shingle_sets(batch)] == sets
    assert windows() == whole
    for shared in (0, 4, 12):
        seen = collections.defaultdict(set)
        n_parts = 0
        for part in kernels.parts(data, off, shared):
            n_parts += 1
            w = kernels.words(part.data, part.off)
            for r, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                all_words = WORD.findall(texts[part.a + r] or "")
                mine = [bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(lo, hi)]
                assert mine == all_words[part.word : part.word + len(mine)]
                seen[part.a + r] |= set(range(part.word, part.word + len(mine) - shared))
        assert n_parts > len(texts)
        for i, t in enumerate(texts):
            assert len(seen[i]) == max(len(WORD.findall(t or "")) - shared, 0)


def test_repeated_prefixes():
    text = np.frombuffer(b"abcabcabxabcab", np.uint8).astype(np.uint16) + 1
    for size in (1, 2, 3, 4, 5):
        raw = bytes((text - 1).astype(np.uint8))
        seen = collections.Counter(raw[i : i + size] for i in range(len(raw) - size + 1))
        got = suffixes.repeated_prefixes(np.concatenate((text, [0])), size)[: len(raw) - size + 1]
        assert got.tolist() == [seen[raw[i : i + size]] > 1 for i in range(len(raw) - size + 1)]


def kept_words(rows, size=13):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        yield i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("reads", [200, 1])
def test_phrases(docs, real, monkeypatch, reads):
    monkeypatch.setattr(phrases, "READS", reads)
    for df in (docs, real):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = phrases.passage_digest(df).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, kept_words(rows)))


def test_phrases_of_adjacent_rows(spark):
    """Equal anchors at the end of one row and the start of the next."""
    words = lambda a, n: " ".join(f"q{a}x{i}" for i in range(n))
    texts = [words(n, n) for n in range(13, 20) for _ in range(3)] + ["again " * 30] * 2
    texts += [words("h", 40) + " " + words("p", 13), words("p", 13) + " " + words("t", 40)]
    rows = list(enumerate(texts))
    got = phrases.passage_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, kept_words(rows)))


def test_phrases_of_unlike_rows_with_one_id(spark):
    """Each row loses its own ranges, and none of another row with its doc_id."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("s", 20) + " " + words("t", 30)), (2, words("x", 60)), (2, words("y", 9) + " " + words("s", 20) + " " + words("z", 9)), (2, words("t", 30) + " end"), (2, None)]
    got = phrases.passage_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, kept_words(rows)))


def test_one_of_each_by_rows(spark):
    """One row of each component, whatever doc_ids rows share or lack."""
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("a")), (1, words("b")), (2, words("b")), (3, words("c")), (1, words("c")), (None, words("d")), (None, words("d")), (None, words("a")), (4, words("e")), (None, ""), (None, "")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, words("a")), (1, words("b")), (1, words("c")), (None, words("d")), (4, words("e")), (None, ""), (None, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies():
    """A chain: each is near to some others, few to all."""
    return [(100 + i, " ".join(f"v{k if k % 40 != i % 40 or i == 0 else k * 1000 + i}" for k in range(300))) for i in range(12)] + [
        (200 + i, " ".join(f"u{k if not 20 * i <= k < 20 * i + 40 else k * 1000}" for k in range(300))) for i in range(14)]


def unlike_texts_with_one_id():
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    return [(1, words("x")), (1, words("y")), (5, words("y") + " tail"), (7, words("x") + " tail"), (5, words("z")), (None, words("z"))]


@pytest.mark.parametrize("block", [128, 2])
def test_jaccard(spark, docs, real, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    made = spark.createDataFrame(near_copies() + unlike_texts_with_one_id(), "doc_id long, text string")
    for df in (docs, real, made):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, jaccard.joined(df).collect()))) == sorted(map(str, brute_components(rows)))


def test_quality(docs):
    rows = {r["text"]: r for r in quality.quality_rules(docs).collect()}
    assert rows[None]["base_failed"] and rows[""]["n_words"] == 0 and not rows["\t \n"]["kept"]
    assert rows["a " * 5000]["n_repeat_words"] == 5000 and rows["a " * 5000]["base_failed"]
    assert rows["é" * 300 + " x"]["word_chars"] == 301


def test_mixing(docs, real):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["copies"] <= 2 for r in rows)
    assert {r["doc_id"]: r["taken"] for r in rows}[4] == 0
    by = collections.defaultdict(list)
    for r in mixing.mixed(real).collect():
        by[r["source"]].append(r)
    for part in by.values():
        off = sum(r["taken"] for r in part) - part[0]["target"]
        assert abs(off) <= 2 * max(r["size"] for r in part) and abs(off) <= 0.1 * part[0]["target"]


def test_sharding(docs, real):
    for df in (docs, real):
        rows = sharding.sharded(df).collect()
        texts = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        for part in by.values():
            assert sorted(r["slot"] for r in part) == list(range(len(part)))
    fair, most = sum(r["size"] for r in rows) / 16, max(r["size"] for r in rows)
    most = max(most, sharding.FULL * fair * 16 / min(len(rows), sharding.RANGES))
    assert all(abs(sum(r["size"] for r in part) - fair) <= most for part in by.values())


def plain_shards(rows, n_shards=16):
    """The same law over rows (doc_id, text) with plain sorting and sums."""
    import math

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<q", x), seed) if x is not None else seed
    recs = sorted((zlib.crc32(t), i, len(t) + 1) for i, t in ((i, (t or "").encode()) for i, t in rows))
    total = sum(r[2] for r in recs)
    n_ranges = max(min(len(recs), sharding.RANGES), 1)
    draw = lambda i: signed(xxhash.xxh64_intdigest(b"draw", long(i, 42))) % (1 << 30) / float(1 << 30)
    sample = [c for c, i, size in recs if draw(i) < min(1.0, size * (n_ranges * sharding.OVERSAMPLE / total))]
    bounds = sorted(set(sample[sharding.OVERSAMPLE - 1 :: sharding.OVERSAMPLE]))
    ranges = collections.defaultdict(list)
    for r in recs:
        ranges[sum(b <= r[0] for b in bounds)].append(r)
    most_bytes, most_rows = max(sharding.FULL * total // n_ranges, 1), max(sharding.FULL * len(recs) // n_ranges, 1)
    parts = collections.defaultdict(list)
    for k, rs in ranges.items():
        n_parts = max(math.ceil(sum(r[2] for r in rs) / most_bytes), math.ceil(len(rs) / most_rows))
        for r in rs:
            parts[k, signed(long(r[0], long(r[1], 42))) % n_parts].append(r)
    at, slots = 0, collections.Counter()
    for k in sorted(parts):
        size = sum(r[2] for r in parts[k])
        shard = min(n_shards - 1, (2 * at + size) * n_shards // (2 * total))
        at += size
        for c, i, s in parts[k]:
            yield i, s, c, shard, slots[shard]
            slots[shard] += 1


@pytest.mark.parametrize("ranges", [16_384, 40])
def test_sharding_against_a_plain_version(docs, real, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    for df in (real, docs.where("doc_id IS NOT NULL")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.sharded(df).collect()]
        assert sorted(got) == sorted(plain_shards(rows))


def test_top_k(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (50, [1.0, None]), (2, [inf, 1.0]), (3, [1.0, 0.5]), (3, [1.0, 0.5]), (4, [-1.0, 2.0]), (None, [1.0, 1.0]), (5, [2.0])]
    got = topk.top_k_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 5, 512 * 256), (0, 3, 256 * 256 + 128 * 128), (0, 3, 256 * 256 + 128 * 128), (0, 4, -256 * 256 + 128 * 512)]


def test_top_k_blocks():
    r = np.random.default_rng(0)
    rows, q = r.integers(-9, 9, (24, 3000)), r.integers(-9, 9, (24, 4))
    for (_, ids, scores), j in zip(topk.search_block(np.arange(3000), rows, np.arange(4), q, 5), range(4)):
        s = q[:, j] @ rows
        want = sorted((-int(s[i]), i) for i in range(3000) if i != j)[:5]
        assert [(-int(x), int(i)) for x, i in zip(scores, ids)] == want


def test_top_k_with_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    compare(spark, queries.queries()["op3_exact_top_k"], topk.ORACLE)


def test_top_k_bounds():
    """A bound leaves out what is below it and nothing else."""
    r = np.random.default_rng(1)
    rows, q = r.integers(-9, 9, (24, 500)), r.integers(-9, 9, (24, 3))
    plain = list(topk.search_block(np.arange(500), rows, np.arange(900, 903), q, 5))
    bounds = np.array([s[2] for _, _, s in plain])
    for (_, ids, scores), (_, more, all_scores), b in zip(topk.search_block(np.arange(500), rows, np.arange(900, 903), q, 5, bounds), plain, bounds):
        n = int((all_scores >= b).sum())
        assert ids[:n].tolist() == more[:n].tolist() and scores[:n].tolist() == all_scores[:n].tolist()


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "bb"), (2, 0, "user", None), (4, 0, None, "x"), (5, 0, None, "x"), (None, 0, "user", "x")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[0]["prompt"] == "<|user|>\nhi\n" and got[0]["rejected_completion"] == "<|assistant|>\nbb\n"
    s = got[0]["rejected_masks"][0]
    assert got[0]["rejected_completion"][s["start"] : s["end"]] == "bb\n"
    assert got[1]["rejected_completion"] == "" and got[2]["chosen_completion"] == "" and got[2]["n_prompt_turns"] == 1


def test_prompts_are_shared(spark):
    """The query's pairs have prompts, and callers' columns stay."""
    got = queries.queries()["op6_preference_formatting"](spark, SF).collect()
    assert max(r["n_prompt_turns"] for r in got) > 1 and any(r["chosen_completion"] != r["rejected_completion"] for r in got)
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    row = spark.sql(f"SELECT 1 AS pair_id, CAST(NULL AS {turn}) AS chosen, array(named_struct('turn', 1L, 'role', 'assistant', 'text', 'x')) AS rejected, 7 AS _c, 8 AS prompt_turns, 9 AS PROMPT")
    out = chat.preference_pairs(row).collect()[0]
    assert out["_c"] == 7 and out["prompt_turns"] == 8 and out["prompt"] == "" and out["rejected_completion"] == "<|assistant|>\nx\n"


PAGES = [
    (None, ""), ("", ""),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One, two.<p>Three<br>four <b>f</b>ive</article><footer>c</footer>", "T & U One, two. Three four five"),
    ("<div class=sidebar><p>no no</p></div><div id=main><p>" + "Long text, here. " * 20 + "</p><p>More text, too, of it.</p></div><div class='comments'><p>" + "I say, so. " * 30 + "</p></div>",
     ("Long text, here. " * 20 + "More text, too, of it.").strip()),
    ("<script>var t='<p>x</p>'</script><form>f<input></form>", ""),
]


def test_html(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extraction_digest(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}


def test_html_of_very_deep_nesting():
    page = "<article>" + "<div>" * 20_000 + "<b>" * 20_000 + "x, y" + "<p>z" * 500 + "</article><p>after"
    assert html.main_text(page).split() == ["x,", "y", *["z"] * 500]


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 9, None, "", "é" * 9, "b", "c", "d" * 40])], names=["doc_id", "text"])
    parts = list(kernels.slices(iter([batch.slice(1), batch.slice(0, 1)]), 20))
    assert [i for x in parts for i in x.column("doc_id").to_pylist()] == [1, 2, 3, 4, 5, 6, 0] and len(parts) == 3


@pytest.mark.parametrize("chunk", [1, 3, 400])
def test_mixing_ranks(spark, docs, monkeypatch, chunk):
    """Every row of a source has a rank of its own, however ranks are split: doubling a source takes each row twice."""
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = [(50 * i if i % 7 else None, "w " * (1 + i % 3), "ab"[i % 5 == 0]) for i in range(60)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 60
    for s in "ab":
        part = [r for r in out if r["source"] == s]
        ranks = len(part) * part[0]["target"] / part[0]["source_size"]
        assert abs(sum(r["copies"] for r in part) - ranks) <= 1


def test_mixing_order_whatever_the_chunks(spark, monkeypatch):
    """Which rows of one size the mix takes does not depend on how many there are to a chunk: the order is by the hash at every size."""
    rows = [(i if i % 11 else None, "w w", "a") for i in range(420)] + [(i, "w " * (i % 4), "b") for i in range(40)] + [(5, "w w", "a")] * 2
    taken = []
    for chunk in (1, 7, 400, 10_000):
        monkeypatch.setattr(mixing, "CHUNK", chunk)
        out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        taken.append(sorted((str(r["doc_id"]), r["source"], r["copies"]) for r in out))
    assert len(taken[0]) == len(rows) and all(t == taken[0] for t in taken)


def test_bpe(docs, real):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    odd = ["don't we'll", "ΑΣ Σ", "<|endoftext|>a", "a\x1cb\x85c", "sssss bbbbb", "½²", "😀 中文"]
    texts = [r["text"] for r in docs.collect()] + odd + [r["text"] for r in real.collect()]
    codec = bpe.codec(path)
    for x in texts:
        e = t.encode(x or "", add_special_tokens=False)
        ids = codec.encode(x or "")
        n, text = len(ids) // 4, codec.decode(np.frombuffer(ids, "<u4"))
        assert ids == struct.pack(f"<{len(e.ids)}I", *e.ids) and n == len(e.ids)
        assert text == t.decode(e.ids, skip_special_tokens=False)
    assert len(bpe.encoding_digest(docs, path).collect()) == len(TEXTS)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    empty_pages = spark.createDataFrame([], "page_id long, url string, html string")
    for f in (suffixes.suffix_digest, phrases.passage_digest, jaccard.joined, quality.quality_digest, mixing.mixing_digest, sharding.sharding_digest):
        assert f(none).count() == 0
    assert html.extraction_digest(empty_pages).count() == 0
    assert topk.top_k_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.preference_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert bpe.encoding_digest(none, queries.tokenizer_path()).count() == 0


def test_bpe_against_the_library():
    """Every token is its own encoding; single code points and random strings; arcs against merges replayed over two tokens."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, codec, r = Tokenizer.from_file(path), bpe.codec(path), random.Random(5)
    auto = codec.automaton
    for i, word in r.sample(sorted(auto.label.items()), 5000):
        if word.endswith("</w>") and len(word) > 4:
            assert auto.encode(word[:-4]) == [i]
    texts = [f"a{chr(c)}b{chr(c)}" for c in [*range(1, 0x3200), *range(0xA640, 0xABFF), *range(0x10400, 0x10DFF), 0x1F600] if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(r.randint(1, hi)) for _ in range(r.randint(1, 30))) for hi in (0x80, 0x250, 0x3100) for _ in range(2000)]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(codec.encode(x), "<u4").tolist() == e.ids, ascii(x)


def test_small_automaton():
    """All words over three letters against merging by rank."""
    import itertools

    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("b", "ab"), ("aa", "ab"), ("c", "c"), ("ab", "ab")]
    vocab = {x: i for i, x in enumerate(["a", "b", "c", *("".join(m) for m in merges)])}
    auto = bpe.Automaton(vocab, merges, "")
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            parts = list(word)
            while True:
                pairs = [(merges.index(p), k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
                if not pairs:
                    break
                best = min(pairs)[0]
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == merges[best]:
                        parts[k : k + 2] = [parts[k] + parts[k + 1]]
                    k += 1
            assert [auto.label[i] for i in auto.encode(word)] == parts


class Plain(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """Text within <article>, by the standard library: what the tables' pages have as their main text."""

    def __init__(self):
        super().__init__()
        self.within, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.within += tag == "article"
        self.parts += [" "] if tag not in html.INLINE else []

    def handle_endtag(self, tag):
        self.within -= tag == "article"
        self.parts += [" "] if tag not in html.INLINE else []

    def handle_data(self, data):
        self.parts += [data] if self.within else []


def test_html_against_a_plain_reader(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in pages.join(html.extraction_digest(pages).drop("url"), "page_id").collect():
        plain = Plain()
        plain.feed(r["html"])
        assert r["text"] == " ".join("".join(plain.parts).split()) and r["n_chars"] == len(r["text"])


PARAGRAPHS = "<p>" + "Long words, here and there, in a paragraph. " * 5 + "</p><p>" + "More of the same, so that it is long. " * 5 + "</p>"


@pytest.mark.parametrize("name", ["print-page", "legal-article", "social-study", "side-by-side", "notice-board story", "search-results-story", "post share-story", "related"])
def test_class_names_alone_do_not_empty_a_page(name):
    plain = html.main_text(f"<body><div>{PARAGRAPHS}</div></body>")
    assert plain and html.main_text(f'<body><nav>x</nav><div class="{name}">{PARAGRAPHS}</div></body>') == plain
    other = f'<body><div>{PARAGRAPHS}</div><div class="{name}"><p>Some other text, of thirty characters.</p></div></body>'
    assert html.main_text(other) == plain


def test_broken_markup():
    assert html.main_text("a < b ... <b>x</b><p>block</p>") == "a < b ... x block"
    assert html.main_text('<p title="x>Hello') == "Hello"
    assert html.main_text('<p title="a>b" data-x=\'>\'>Hello <!-- > --> you<!DOCTYPE x></p') == "Hello you"
    assert html.main_text(f"<body>{'Loose text, without a block. ' * 4}<div>{PARAGRAPHS}</div></body>").startswith("Loose text")


@pytest.mark.parametrize("part", ["<a ", '<p title="', "<!--", "<script ", "<script></script ", "</b", "<p>", "&amp", "=' ", '<p title = "'])
def test_hostile_markup(part):
    """Time grows with the page, not with its square."""
    import time

    def took(size):
        began = time.process_time()
        html.main_text(part * (size // len(part)))
        return time.process_time() - began

    assert took(600_000) < 6 * took(150_000) + 0.3
