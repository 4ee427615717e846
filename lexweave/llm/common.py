"""What the operators of this subpackage share: reading, words, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; of null, none. Splitting takes time in proportion to the text; extracting each match takes the square of it."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none there is a folder of this machine for a session on this machine,
    as in tests; on a cluster that is an error, as executors would write where nobody reads."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-lexweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Spark's setting by which the shuffles of a query go when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later stages read it instead of computing it again, also after
    an executor is lost. The shuffles that it took are of no use then and go at once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lexweave-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def shielded(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with all columns but ``used`` named by their places (other_0, ...), so that no name meets one that an operator adds.
    ``toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[c if c in used else f"other_{i}" for i, c in enumerate(df.columns)])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number of its own for each row as ``_row``, written so that the number stays."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose hashes meet in one bucket, about.
BUCKET = 1 << 27


def n_buckets(docs: DataFrame) -> int:
    """Into how many buckets the hashes of ``docs`` (text) are dealt: as many as the session shuffles into, more where that would
    leave buckets above ``BUCKET``. So what a task holds does not grow with the input."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(n_partitions(docs.sparkSession), -(-size // BUCKET))
