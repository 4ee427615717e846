"""A training corpus from ``documents``: quality rules, one document of each near-duplicate group, repeated passages cut out,
sources mixed to their targets, and the rest encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, jaccard, mixing, phrases, quality
from lexweave.llm.common import numbered, read, shielded, written
from lexweave.llm.queries import tokenizer_path

#: No SQL expresses the encoding; the stages are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, with all their columns, whatever their names. Rows with null or empty texts go."""
    rows = shielded(docs, "text")
    return quality.quality_rules(rows).where("kept").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: of the least doc_id, null last. Of repeated rows one stays. Rows without words all
    stay, as they link with nothing."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has; n_chars follows. Rows with null doc_ids or texts stay as
    they are; unlike rows with one doc_id take nothing from each other."""
    out = shielded(phrases.without_passages(docs), "text", "n_chars")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also where doc_ids are null or repeated. A null source is a source of its own; rows
    without words fall out."""
    rows = numbered(shielded(docs, "doc_id", "text", "source"))
    copies = mixing.mixed(rows, key="_row").where("copies > 0").select("_row", F.col("copies").cast("int").alias("_copies"))
    taken = rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.drop("_row", "_copies", "_copy").toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null text has no ids."""
    return bpe.encoded(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over a written table of what the one before left."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
