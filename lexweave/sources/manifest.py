"""The catalogue of texts that can be installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Texts by id, title and language, and what needs one of them to be there.
TEXTS = (
    ("en_kjv", "King James Version", "English"),
    ("en_bbe", "Bible in Basic English", "English"),
    ("ar_svd", "Van Dyck Arabic Bible (سميث و فانديك)", "Arabic"),
    ("ru_synodal", "Russian Synodal Bible", "Russian"),
    ("zh_cuv", "Chinese Union Version (和合本)", "Chinese"),
    ("en_asv", "American Standard Version", "English"),
    ("en_bsb", "Berean Standard Bible", "English"),
    ("en_ylt", "Young’s Literal Translation", "English"),
    ("en_darby", "Darby Translation", "English"),
    ("en_drc", "Douay-Rheims (Challoner Revision)", "English"),
    ("en_geneva", "Geneva Bible (1599)", "English"),
    ("en_jps", "JPS Tanakh (1917)", "English"),
)
ADDONS = (("kjv_strongs", "KJV — add Strong’s numbers", "King James Version"),)


def manifest(spark: SparkSession) -> DataFrame:
    """id, title, language, requires of all texts and of what is added to one."""
    rows = [(*t, None) for t in TEXTS] + [(i, title, None, requires) for i, title, requires in ADDONS]
    return spark.createDataFrame(rows, "id string, title string, language string, requires string")
