"""Work tables: written once, and nothing of their making stays."""

import time

from pyspark.sql import functions as F

from docloom import session


def test_shuffle_files_go_when_a_work_table_is_written(spark, tmp_path):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}

    old, setting = files(), spark.conf.get(session.SHUFFLE_CLEANUP)
    df = spark.range(20_000).groupBy(F.xxhash64("id").alias("k")).count()
    path = session.write_work(df)
    ends = time.time() + 20
    while files() - old and time.time() < ends:
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(session.SHUFFLE_CLEANUP) == setting
    assert spark.read.parquet(path).count() == df.count() == 20_000
    session.remove_work(spark, path)
