"""Session helpers: when inputs are re-partitioned, and filter placement."""

from pyspark.sql import functions as F

from tracekit.session import SPREAD_KEY, checkpoint_root, filter_here, spread

from .conftest import SF_SMALL


def test_spread_is_off_unless_asked_for(spark):
    one = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert spread(one, "doc_id") is one
    spark.conf.set(SPREAD_KEY, "12")
    try:
        assert spread(one, "doc_id").rdd.getNumPartitions() == 12
    finally:
        spark.conf.unset(SPREAD_KEY)


def test_filter_here_equals_where(spark):
    df = spark.range(200).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    cond = F.col("t").rlike("[37]$")
    assert sorted(r.id for r in filter_here(df, cond).collect()) == sorted(r.id for r in df.where(cond).collect())
    assert filter_here(df, cond).columns == df.columns


def test_checkpoint_root_uses_session_setting(spark):
    root = checkpoint_root(spark)
    assert root and spark.sparkContext.getCheckpointDir()
