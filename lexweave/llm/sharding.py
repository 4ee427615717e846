"""Sharding by sampled splitters.

Records are ordered by (checksum of the text, doc_id), so that equal texts stand together. A sample of keys, drawn with
chances in proportion to size, gives quantile boundaries, and records are dealt into the ranges between them. Ranges that
turn out overfull, such as one with a large group of equal texts, are subdivided by a hash. Each range or part of one goes whole
to the shard in which the middle of its bytes lies. The law is ``bytes``: shards differ from an equal part by no more than a range,
which is a fourth of a thousandth of the bytes, or one document if that is larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Ranges, at most: they and their boundaries are broadcast and counted by one task, whatever the input. Sampled keys for each.
RANGES, OVERSAMPLE = 16_384, 4
#: Times its fair part that a range may have before it is subdivided.
FULL = 4
#: Boundaries are looked up by the leading bits of the key.
PREFIX_BITS = 12


def sharded(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): size, text_crc32, shard, slot.

    Null text counts as empty (size 1). Equal texts stand together in slot order except where their range was subdivided.
    Repeated rows, and rows with null doc_ids, get slots each. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    )
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    n_ranges = max(min(n, RANGES), 1)

    # Size-weighted sample of keys; every OVERSAMPLE-th in order is a boundary.
    chance = F.least(F.lit(1.0), F.col("size") * (n_ranges * OVERSAMPLE / total))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    bounds = (
        base.where(draw < chance)
        .withColumn("nth", F.row_number().over(Window.orderBy("text_crc32", "doc_id")))
        .where(F.col("nth") % OVERSAMPLE == 0)
        .select("text_crc32")
        .distinct()
    )
    prefix = F.shiftright("text_crc32", 32 - PREFIX_BITS)
    table = (
        base.sparkSession.range(1 << PREFIX_BITS, numPartitions=1)
        .withColumnRenamed("id", "prefix")
        .join(bounds.groupBy(prefix.alias("prefix")).agg(F.collect_list("text_crc32").alias("bounds")), "prefix", "left")
        .withColumn("bounds", F.coalesce("bounds", F.array().cast("array<bigint>")))
        .withColumn("first", F.sum(F.size("bounds")).over(Window.orderBy("prefix")) - F.size("bounds"))
    )
    ranged = (
        base.withColumn("prefix", prefix)
        .join(F.broadcast(table), "prefix")  # about RANGES boundaries
        .withColumn("range", F.col("first") + F.size(F.filter("bounds", lambda b: b <= F.col("text_crc32"))))
        .select("doc_id", "size", "text_crc32", "row", "range")
    )
    most_bytes, most_rows = max(FULL * total // n_ranges, 1), max(FULL * n // n_ranges, 1)
    parts = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    parts = parts.select("range", F.greatest(F.ceil(F.col("b") / most_bytes), F.ceil(F.col("r") / most_rows)).cast("long").alias("n_parts"))
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    parted = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(hashed, F.col("n_parts")))

    # One row per range or part: at most RANGES + RANGES / FULL * 2 of them.
    sums = parted.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    in_order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(in_order), F.lit(0)).cast("long")
    middle = (2 * F.col("bytes_before") + F.col("b")).cast("decimal(38,0)") * n_shards / (2 * total)
    dealt = (
        sums.select("range", "part", "b", before("b").alias("bytes_before"), before("r").alias("rows_before"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle)).cast("int"))
        .withColumn("first", F.col("rows_before") - F.min("rows_before").over(Window.partitionBy("shard")))
        .select("range", "part", "shard", "first")
    )
    within = Window.partitionBy("range", "part").orderBy("text_crc32", "doc_id", "size", "row")
    return (
        parted.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(dealt), ["range", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
    )


def sharding_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, as :func:`sharded`, under the law ``bytes``."""
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
