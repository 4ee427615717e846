"""Batches that are loaded once, counts of loads, places and pages."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import annotate, places, reader
from lexweave.sources import tables


def test_a_batch_is_there_once(spark, tmp_path):
    """Run again, or killed and run again, a batch leaves the same rows, and those of other batches alone."""
    at = f"{tmp_path}/t"
    one, two = spark.range(100).withColumn("x", F.lit("a")), spark.range(100, 150).withColumn("x", F.lit("b"))
    tables.append(one, at, "1")
    tables.append(two, at, "2")
    tables.append(one, at, "1")
    rows = lambda: sorted(r["id"] for r in tables.appended(spark, at).collect())
    assert rows() == list(range(150))
    killed = two.repartition(4).select((F.col("id") + 1000).alias("id"), F.when(F.col("id") == 149, F.raise_error(F.lit("killed"))).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        tables.append(killed, at, "3")
    assert rows() == list(range(150))
    tables.append(two.select((F.col("id") + 1000).alias("id"), "x"), at, "3")
    assert rows() == [*range(150), *range(1100, 1150)]
    tables.append(two.limit(0), at, "2")
    assert len(rows()) == 200


def test_a_stream_that_is_killed_and_run_again(spark, tmp_path):
    source, at, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.range(10).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    failing = stream().withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        tables.append_stream(failing, at, checkpoint).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        tables.append_stream(stream(), at, checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    tables.append_stream(stream(), at, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in tables.appended(spark, at).collect()) == list(range(15))


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    assert tables.save_counted(df, f"{tmp_path}/c", n=F.count("*"), zeros=F.count_if(F.col("x") == 0)) == {"n": 1000, "zeros": 143}
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1000


def test_a_staged_table_is_owned(spark):
    """It is in parts by its columns, holds an empty table too, and is marked to go with the session."""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "x int, k string")
    out = tables.staged(df, "k")
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect())) and out.columns == df.columns
    assert "PartitionFilters: [isnotnull(k" in out.where("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert tables.staged(df.limit(0), "k").collect() == [] and tables.staged(df).count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(tables.scratch(spark))
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(path)


def test_places(spark):
    """Of all rows, with nulls, ties that the last key tells apart, and a key that has most of them."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 11}", i % 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = places.placed(df, [F.asc_nulls_last("k"), F.desc("v"), "id"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 2001))
    assert places.placed(df.limit(0), ["k"]).collect() == []
    nth = {}
    for k, _, i, n in places.within(df, ["k"], ["id"]).collect():
        nth.setdefault(k, []).append((n, i))
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) and sorted(i for _, i in v) == [i for _, i in sorted(v)] for v in nth.values())
    listed = places.pages(places.within(df, ["k"], ["id"]), ["k"], "nth", F.col("id"), 100).collect()
    assert max(len(r["items"]) for r in listed) == 100
    for k in nth:
        assert [i for r in sorted((r for r in listed if r["k"] == k), key=lambda r: r["page"]) for i in r["items"]] == [i for _, i in sorted(nth[k])]


def test_nested_highlights(spark):
    """A highlighter without highlights, and highlights without one, are left out."""
    marks = spark.createDataFrame([(i, [1, 2, 9][i % 3], f"b{i % 2}") for i in range(10)], "id int, highlighter_id int, book string")
    pens = spark.createDataFrame([(1, "x", "#1", 2), (2, "y", "#2", 1), (3, "z", "#3", 0)], "id int, label string, color string, sort_order int")
    got = annotate.nested_highlights(marks, pens, F.col("id"), ["book", "id"], size=3).collect()
    assert sorted((r["label"], r["page"], r["items"]) for r in got) == [("x", 0, [0, 6, 3]), ("x", 1, [9]), ("y", 0, [4, 1, 7])]


def test_panes(spark):
    """The chapter, else the last before it, else the first; without the book the source's own first chapter; a source without chapters has none."""
    rows = [("a", "Gen", 1), ("a", "Gen", 3), ("a", "Ex", 2), ("b", "Gen", 2), ("b", "Gen", None), ("c", None, None)]
    entries = spark.createDataFrame(rows, "source string, book string, chapter int")
    refs = spark.createDataFrame([("Gen", 1), ("Gen", 2), ("Gen", 9), ("Ex", 1), ("Lev", 4)], "book string, chapter int")
    got = {(r["book"], r["chapter"], r["source"]): (r["shown_book"], r["shown_chapter"]) for r in reader.panes(entries, refs, ["a", "b", "c"]).collect()}
    assert {k[:2]: v for k, v in got.items() if k[2] == "a"} == {("Gen", 1): ("Gen", 1), ("Gen", 2): ("Gen", 1), ("Gen", 9): ("Gen", 3), ("Ex", 1): ("Ex", 2), ("Lev", 4): ("Ex", 2)}
    assert {k[:2]: v for k, v in got.items() if k[2] == "b"} == {("Gen", 1): ("Gen", 2), ("Gen", 2): ("Gen", 2), ("Gen", 9): ("Gen", 2), ("Ex", 1): ("Gen", 2), ("Lev", 4): ("Gen", 2)}
    assert {v for k, v in got.items() if k[2] == "c"} == {(None, None)}
