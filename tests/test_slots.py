"""Slots and pages of entries whose tags stand under their words."""

import re

from lexweave import catalog
from lexweave.operators import concordance
from oracle import SF, compare, connection

WORDS = "words array<struct<word_index:int,surface_text:string,numbers:array<string>>>"
TEXTS = [(1, "a b a"), (2, "x"), (2, "x"), (2, "x y"), (2, "z"), (3, None), (4, ""), (None, "n"), (None, "n m")]


def entries(spark, texts):
    words = lambda t: None if t is None else [(i, w, [f"H{len(w)}", "G1"]) for i, w in enumerate(t.split())]
    return spark.createDataFrame([(k, words(t)) for k, t in texts], f"entry_id long, {WORDS}")


def shuffled(df):
    """What the plan deals anew, with its columns."""
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\((.*?)\)", df._jdf.queryExecution().executedPlan().toString())


def test_slots_of_entries(spark):
    got = [tuple(r) for r in concordance.slots_of_entries(entries(spark, TEXTS)).collect()]
    want = {(k, i, w, f"H{len(w)} G1") for k, t in TEXTS if t for i, w in enumerate(t.split())}
    assert len(got) == len(set(got)) and set(got) == want


def test_tags_of_a_flat_table_give_the_same(spark):
    """Of entries with ids of their own."""
    own = entries(spark, [(1, "a b a"), (2, "x y")])
    tags = own.selectExpr("entry_id", "inline(words)").selectExpr("entry_id", "word_index", "surface_text", "posexplode(numbers) AS (id, number)")
    assert sorted(map(tuple, concordance.grouped_slots(tags).collect())) == sorted(map(tuple, concordance.slots_of_entries(own).collect()))


def test_pages_of_entries(spark):
    long = [(9, " ".join(f"w{i}" for i in range(10))), (8, " ".join(f"w{i}" for i in range(8)))]
    got = {(k, p): x for k, p, x in concordance.pages_of_entries(entries(spark, [*TEXTS, *long]), 4).collect()}
    slots = sorted({(k or 0, i, f"{w}|H{len(w)} G1") for k, t in [*TEXTS, *long] if t for i, w in enumerate(t.split())})
    want = {}
    for k, i, x in slots:
        want.setdefault((k or None, i // 4), []).append(x)
    assert got == want


def test_words_of_unlike_ids_are_not_shuffled(spark):
    """A shuffle of all tags was some 50 times the documents."""
    for name, of_shared_ids in (("slot_group", 1), ("words_nested", 2)):
        kinds = shuffled(catalog.queries()[name](spark, SF))
        assert len(kinds) <= of_shared_ids, kinds


def test_repeated_ids(spark, tmp_path):
    """Equal slots of documents that share an id are one, unlike ones stay."""
    rows = connection().execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 30").df()
    again = rows.copy()
    again.loc[:9, "doc_id"] = again.loc[10:19, "doc_id"].to_numpy()
    both = spark.createDataFrame(rows).unionByName(spark.createDataFrame(again))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, catalog.queries()["slot_group"], catalog.oracle_sql()["slot_group"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"), f"{tmp_path}")
