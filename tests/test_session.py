"""Session helpers: shared folder and shuffle sizing."""

import os

from tests.conftest import SF_CHECK
from tickwise.session import input_bytes, shared_dir, size_shuffles


def test_shared_dir_is_below_checkpoint_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a.startswith(base.rstrip("/") + "/tickwise/x/") and a != b


def test_size_shuffles_from_input_bytes(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    old_adv = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        total = input_bytes(spark, [f"{SF_CHECK}/lineitem.parquet", f"{SF_CHECK}/orders.parquet"])
        assert total == os.path.getsize(f"{SF_CHECK}/lineitem.parquet") + os.path.getsize(f"{SF_CHECK}/orders.parquet")
        n = size_shuffles(spark, [SF_CHECK], target_bytes=256 * 1024, min_partitions=2)
        assert n == max(2, -(-input_bytes(spark, [SF_CHECK]) // (256 * 1024)))
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old_adv)
