"""Parsed entries as stored tables, and how tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def stored(parsed: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(books, entries) of parsed entries (source, n, book, ...): a book's place is that of its first entry among the source's books, an entry's
    its place in the book, both from 0. Ids are made of the source's name and the places."""
    books = parsed.groupBy(F.col(source).alias("source"), F.col("book").alias("name")).agg(F.min("n").alias("first"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("first")) - 1
    books = books.select(F.xxhash64("source", "name").alias("id"), "source", "name", place.alias("sort_order"))
    within = F.row_number().over(Window.partitionBy(source, "book").orderBy("n")) - 1
    entries = parsed.withColumn("sort_order", within)
    key = F.xxhash64(F.col(source), F.col("book"))
    return books, entries.select(F.xxhash64(F.col(source), "book", "sort_order").alias("id"), key.alias("book_id"), "chapter", "verse", "position_ref", "text", "sort_order")


#: Rows of a partition that are sorted together, and bytes of text whose tokens are, about.
ROWS, BYTES = 50_000, 1 << 24


def n_parts(spark: SparkSession, size: int, each: int) -> int | None:
    """Into how many partitions ``size`` is dealt so that none has more than about ``each``; None where those the session shuffles into are enough. So what
    a task sorts does not grow with the input."""
    n = -(-size // each)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows``, of which there are ``size``, dealt by ``key`` into partitions of about ``ROWS``: what is grouped and numbered by the key later meets there and is
    not dealt again."""
    n = n_parts(rows.sparkSession, size, ROWS)
    return rows.repartition(n, key) if n else rows


def _shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a session on this machine alone gets a folder of its own; on a cluster that is an
    error, as executors would write where nobody reads."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lexweave-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as computed now, kept in the shared folder; Spark's cleaner owns the files."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """The path of a new table in the shared folder, to be overwritten. It goes when the session's file system is closed."""
    at = f"{_shared(spark)}/staged-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def staged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in parts ``by`` columns, so that a filter on these reads its own part alone."""
    at = scratch(df.sparkSession)
    save(df, at, [*by])
    return df.sparkSession.read.schema(df.schema).parquet(at).select(*df.columns)


def by_repeats(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` no other row has, all others); null is a key. Only keys are shuffled. Those that repeat become a table of their own, so that Spark
    knows its size: few are sent to the rows, many are joined with them."""
    again = staged(rows.groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces a table. A job that fails leaves no half-written one: Spark commits output when all tasks are done."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_counted(df: DataFrame, path: str, by: list[str] | None = None, **counts: Column) -> dict[str, int]:
    """:func:`save`, and what ``counts`` (aggregates) are over the rows written, taken in the pass that writes them."""
    seen = Observation()
    save(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), path, by)
    return seen.get


#: The column that tells batches of a table apart.
BATCH = "batch_id"


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds the rows of a batch to a table, once however often it is run: a batch is a part of the table of its own, which a rerun replaces. A run
    that fails leaves the table as it was, as Spark commits a part when all its tasks are done. A batch without rows adds and replaces nothing.
    Without a name for the batch rows are added to a table that has no batches, and again by a rerun."""
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """A table of batches, without their names."""
    return spark.read.option("basePath", path).parquet(path).drop(BATCH)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream's micro-batches added to a table: one that is run again after a failure replaces what it had written."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append(df, path, f"{n:012d}"))


def save_tokens(tokens: DataFrame, path: str, size: int | None = None) -> None:
    """A token table (entry_id, place, token) in the order of tokens, in ranges, with Parquet's Bloom filters on them: a reader that asks for some
    tokens passes over the row groups without them. There are as many ranges as ``size``, the bytes of the texts, asks for; without it the tokens' own bytes
    are added up first."""
    if size is None:
        size = tokens.agg(F.sum(F.octet_length("token").cast("long") + 1)).first()[0] or 0
    n = n_parts(tokens.sparkSession, size, BYTES)
    in_order = tokens.repartitionByRange(*[n] if n else [], "token", "entry_id").sortWithinPartitions("token", "entry_id", "place")
    in_order.write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(path)


def save_document(blocks: DataFrame, path: str) -> None:
    """Writes (place, block) as text files whose names are in the order of places; they make one document with a rule between blocks."""
    text = F.when(F.col("place") > 1, F.concat(F.lit("\n---\n\n"), "block")).otherwise(F.col("block"))
    blocks.repartitionByRange("place").sortWithinPartitions("place").select(text.alias("value")).write.mode("overwrite").text(path)
