"""Places and exports over whole tables."""

from pathlib import Path

from lexweave import catalog
from lexweave.operators import annotate
from lexweave.sources import tables
from oracle import SF


def test_no_event_is_left_out(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for name in ("note_order_nulls_last", "notes_export"):
        assert sorted(r["place"] for r in catalog.queries()[name](spark, SF).collect()) == list(range(1, n + 1))


def test_places_need_no_single_task(spark):
    """No window runs over all rows, and no exchange brings all of them together."""
    for name in ("note_order_nulls_last", "notes_export", "highlights_listed", "highlights_nested", "concordance_ranked"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Window [" not in plan, name


def test_places_with_nulls(spark):
    rows = [(i, i % 4 == 0, None if i % 3 == 0 else i % 2, None if i % 5 == 0 else f"2024-01-0{1 + i % 3} 0{i % 9}:00:00") for i in range(60)]
    notes = spark.createDataFrame(rows, "id long, pinned boolean, anchor_verse int, t string").selectExpr("id", "pinned", "anchor_verse", "CAST(t AS timestamp) AS updated_at")
    want = [r["id"] for r in annotate.note_order(notes).collect()]
    assert [r["id"] for r in annotate.note_places(notes).orderBy("place").collect()] == want


def test_saved_document(spark, tmp_path):
    blocks = spark.createDataFrame([(i, f"## {i}\n\nx") for i in range(1, 200)], "place long, block string")
    tables.save_document(blocks.repartition(7), f"{tmp_path}/out")
    got = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/out").glob("part-*")))
    assert got == "\n\n---\n\n".join(f"## {i}\n\nx" for i in range(1, 200)) + "\n"
