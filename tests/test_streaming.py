from pyspark.sql import functions as F

from merchantry.operators import windows as WN
from merchantry.streaming import cache as SC


def _feed(spark):
    rows = []
    descs = ["A", "B", "A", "C", "B", "B", "D", "A"]
    for i, d in enumerate(descs):
        rows.append((f"T{i:03d}", d, f"2024-01-{1 + i // 2:02d}", "C1", -1.0 - i))
    return spark.createDataFrame(rows, "txn_id string, description string, posted_date string, customer_id string, "
                                       "amount double").withColumn("posted_date", F.to_date("posted_date"))


def test_new_flags_batch_golden(spark):
    df = spark.createDataFrame([(f"T{i}", d, "2024-01-01") for i, d in enumerate("ABACBB")],
                               "txn_id string, description string, posted_date string")
    got = [r["is_new"] for r in WN.running_new_flags(df).orderBy("txn_id").collect()]
    assert got == [True, True, False, True, False, False]


def test_descriptor_cache_stream_equals_batch(spark):
    feed = _feed(spark)
    src = SC.write_stream_source(feed)
    out = SC.descriptor_cache_stream(spark, src, feed.schema)
    got = {r["txn_id"]: r["is_new"] for r in out.collect()}
    want = {r["txn_id"]: r["is_new"] for r in WN.running_new_flags(feed).collect()}
    assert got == want
    rates = {str(r["window_start"]): r["hit_rate"] for r in SC.hit_rate_windows(out).collect()}
    assert rates["2024-01-01"] == 0.0 and rates["2024-01-03"] == 1.0 and rates["2024-01-04"] == 0.5


def test_spend_rollup_stream_equals_batch(spark):
    feed = _feed(spark).withColumn("canonical_merchant", F.col("description"))
    src = SC.write_stream_source(feed)
    out = SC.spend_rollup_stream(spark, src, feed.schema, lambda s: s)
    got = {(str(r["day"]), r["canonical_merchant"]): r["total_spend"] for r in out.collect()}
    want = {(str(r["posted_date"]), r["canonical_merchant"]): r["s"] for r in
            feed.groupBy("posted_date", "canonical_merchant").agg(F.round(F.sum(F.abs("amount")), 2).alias("s")).collect()}
    assert got == want


def test_descriptor_cache_ttl(spark):
    rows = [("T1", "A", "2024-01-01"), ("T2", "A", "2024-01-03"), ("T3", "A", "2024-01-20"), ("T4", "B", "2024-01-20")]
    feed = spark.createDataFrame(rows, "txn_id string, description string, posted_date string").withColumn(
        "posted_date", F.to_date("posted_date"))
    src = SC.write_stream_source(feed)
    out = {r["txn_id"]: r["is_new"] for r in SC.descriptor_cache_stream(spark, src, feed.schema, ttl_days=10).collect()}
    assert out == {"T1": True, "T2": False, "T3": True, "T4": True}
    out = {r["txn_id"]: r["is_new"] for r in SC.descriptor_cache_stream(spark, src, feed.schema).collect()}
    assert out == {"T1": True, "T2": False, "T3": False, "T4": True}


def test_stream_enrichment_equals_batch(spark):
    from merchantry.operators.routes import RulesRoute
    train_feed = spark.createDataFrame([("T1", "McDonald's #111", 5814, -10.0), ("T2", "BP on Buford Hwy", None, -40.0),
                                        ("T3", "Wage", None, 2000.0)], "txn_id string, description string, mcc int, amount double")
    train_gold = spark.createDataFrame([("T1", "Food & Dining", "McDonald's"), ("T2", "Transportation", "BP"),
                                        ("T3", "Income", "Wage")], "txn_id string, category string, canonical_merchant string")
    route = RulesRoute().fit(train_feed, train_gold)
    rows = [(f"X{i}", d, m, a, f"2024-01-0{1 + i % 3}") for i, (d, m, a) in enumerate(
        [("MCDONALDS #999 ATLANTA", None, -3.0), ("BP F1234", 9999, -30.0), ("Unknown Shop", None, -5.0),
         ("WAGE", None, 2000.0), ("Some Diner", 5814, -12.0), ("BP #5", None, -1.0)])]
    feed = spark.createDataFrame(rows, "txn_id string, description string, mcc int, amount double, posted_date string") \
        .withColumn("posted_date", F.to_date("posted_date"))
    src = SC.write_stream_source(feed)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    import uuid
    from merchantry.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark)}/s4test-{uuid.uuid4().hex[:6]}"
    q = (SC.enrich_stream(stream, route).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["txn_id"]: (r["canonical_merchant"], r["category"]) for r in spark.read.parquet(f"{root}/out").collect()}
    want = {r["txn_id"]: (r["canonical_merchant"], r["category"]) for r in route.transform(feed).collect()}
    assert got == want


def test_descriptor_cache_does_not_depend_on_files_a_batch(spark):
    feed = _feed(spark)
    src = SC.write_stream_source(feed)
    a = {r["txn_id"]: r["is_new"] for r in SC.descriptor_cache_stream(spark, src, feed.schema, max_files=1).collect()}
    b = {r["txn_id"]: r["is_new"] for r in SC.descriptor_cache_stream(spark, src, feed.schema, max_files=3).collect()}
    assert a == b == {r["txn_id"]: r["is_new"] for r in WN.running_new_flags(feed).collect()}
