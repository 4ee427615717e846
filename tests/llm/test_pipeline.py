"""Each stage against a plain version of it."""

import collections

import corpus_pipeline as p
from lexweave.llm import mixing
from oracle import SF
from test_queries import brute_components, kept_words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_rules(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = p.near_duplicates(spark, kept, SF).cache()
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute_components(rows)})
    cut = p.repeated_passages(spark, one, SF).cache()
    words = {i: n - m for i, n, m, _ in kept_words([(r["doc_id"], r["text"]) for r in one.collect()])}
    assert cut.columns == docs.columns and {r["doc_id"]: len(r["text"].split()) for r in cut.collect()} == words
    mix = p.mix_sources(spark, cut, SF).cache()
    assert mix.columns == docs.columns
    assert max(collections.Counter(r["doc_id"] for r in mix.collect()).values()) <= 2
    assert p.encode(spark, mix, SF).count() == mix.count()


def test_mix_of_null_and_repeated_ids(spark):
    """Each row is taken by its own copies."""
    rows = [(None if i % 3 else i // 6, f"t{i} " + "w " * (i % 4), "ab"[i % 5 == 0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = collections.Counter(tuple(r) for r in p.mix_sources(spark, docs, SF).collect())
    assert set(out) <= set(rows) and max(out.values()) <= 2
    words, copies, per_row = collections.Counter(), collections.Counter(), mixing.mixed(docs).collect()
    for (i, text, source), n in out.items():
        words[source] += n * len(text.split())
        copies[i, source] += n
    want = collections.Counter()
    for r in per_row:
        want[r["doc_id"], r["source"]] += r["copies"]
    assert copies == +want
    assert all(abs(words[r["source"]] - r["target"]) <= 8 for r in per_row)


def test_stages_keep_clashing_columns(spark):
    """Columns that bear the names of results or of an operator's own, nulls and repeated rows, through every stage."""
    words = lambda a, n: " ".join(f"the of {a}{i} and" for i in range(n))
    names = "kept N_WORDS n_words a b k _row _copies _copy words component_id other_0".split()
    rows = [(i % 9 or None, None if i == 5 else words("x" * (1 + i % 4), 20) + " " + words(f"y{i}", 1), "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            at = r[3].removeprefix("kept")
            assert list(r[3:]) == [f"{n}{at}" for n in names], name


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
