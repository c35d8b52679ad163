"""Written tables: their shuffle files and their own lifetime."""
import os

from pyspark.sql import functions as F

from merchantry.session import SHUFFLE_CLEANUP, discard, materialize


def _shuffle_files(spark):
    """Shuffle files that the session's block manager still holds."""
    ids = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {ids.apply(i).name() for i in range(ids.size()) if ids.apply(i).isShuffle()}


def test_a_write_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    counts = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = materialize(counts.join(counts.withColumnRenamed("n", "m"), "k"), "lifetime")
    assert not _shuffle_files(spark) - before
    assert table.agg(F.sum("n")).first()[0] == 10_000 and table.count() == 997
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    # the frame that was written still gives its rows, and so does a second write of it
    assert counts.count() == 997 and materialize(counts, "lifetime").count() == 997


def test_discard_deletes_own_tables_only(spark, tmp_path):
    table = materialize(spark.range(5), "lifetime")
    folder = table._own_folder
    other = str(tmp_path / "given")
    spark.range(3).write.parquet(other)
    given = spark.read.parquet(other)
    discard(table, given, table.filter("id > 2"))
    assert not os.path.exists(folder.removeprefix("file:")) and given.count() == 3
