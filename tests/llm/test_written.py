"""Written tables leave no shuffles behind."""

import time

from pyspark.sql import functions as F

from lexweave.llm import common


def test_shuffles_go_when_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, conf = disk.getAllFiles().size(), spark.conf.get(common.CLEANUP, None)
    rows = common.written(spark.range(100_000).withColumn("x", F.rand(7)).repartition(4, "id"))
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.2)
    assert disk.getAllFiles().size() <= before and spark.conf.get(common.CLEANUP, None) == conf
    assert rows.count() == 100_000
