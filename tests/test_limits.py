"""What a step holds or sends must not grow faster than its table."""

import hashlib

from pyspark.sql import functions as F

from evidentia.operators import attachments as A
from evidentia.session import configure


def test_python_batches_are_bounded(spark):
    configure(spark)
    held = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    assert spark.range(0, 5000, 1, 1).select(held("id").alias("n")).agg(F.max("n")).first()[0] == 1000


def test_variants_are_joined_by_one_short_key(spark):
    md5 = hashlib.md5(b"room").hexdigest()
    messages = spark.createDataFrame([(1, "room", "a/b", 0), (2, "room", "b", 0), (3, "room", None, 0), (4, None, "a/b", 0)], "k long, chat string, resource_key string, create_time long")
    files = spark.createDataFrame(
        [(md5, "a/b", "1970-01", "thumbnail", "t"), (md5, "a/b", "1970-01", "full", "f"), (md5 + "a/", "b", "1970-01", "full", "wrong"), (md5, None, "1970-01", "full", "none")],
        "chat_md5 string, resource_key string, month string, variant string, path string",
    )
    out = A.pick_variant(messages, files)
    assert sorted((r["k"], r["variant"], r["body_path"]) for r in out.collect()) == [(1, "full", "f"), (2, None, None), (3, None, None), (4, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (_key" in plan
