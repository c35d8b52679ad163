"""State over time: TTL, restart, late rows, bounded logs."""
import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from merchantry.operators import windows as WN
from merchantry.session import ensure_checkpoint_dir
from merchantry.streaming import cache as SC

FEED = "txn_id string, description string, posted_date date, customer_id string, amount double"


def feed(spark, n=200, days=20, seed=1):
    rng = random.Random(seed)
    names = ["hot"] * 6 + [f"d{i}" for i in range(40)] + [None]
    rows = sorted((dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(days)), i) for i in range(n))
    return spark.createDataFrame([(f"T{k:05d}", rng.choice(names), day, f"C{k % 3}", float(k)) for k, (day, _) in enumerate(rows)], FEED)


def root(spark):
    return f"{ensure_checkpoint_dir(spark)}/streams/test-{uuid.uuid4().hex[:8]}"


def flags(df):
    return {r["txn_id"]: r["is_new"] for r in df.collect()}


def expected_with_ttl(rows, ttl):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["posted_date"], r["txn_id"])):
        seen = last.get(r["description"])
        out[r["txn_id"]] = seen is None or (r["posted_date"] - seen).days > ttl
        last[r["description"]] = r["posted_date"]
    return out


def test_ttl_does_not_depend_on_the_batches(spark):
    f = feed(spark)
    f = f.filter("posted_date < '2024-01-13'")
    src = SC.write_stream_source(f)
    want = expected_with_ttl(f.collect(), 3)
    assert sum(want.values()) > 50          # many come back after a gap
    for max_files in (1, 5):
        assert flags(SC.descriptor_cache_stream(spark, src, f.schema, max_files=max_files, ttl_days=3)) == want


def test_a_restarted_cache_goes_on(spark):
    f = feed(spark)
    first, second = f.filter("posted_date < '2024-01-12'"), f.filter("posted_date >= '2024-01-12'")
    at, src = root(spark), SC.write_stream_source(first)
    assert flags(SC.descriptor_cache_stream(spark, src, f.schema, max_files=3, root=at)) == flags(WN.running_new_flags(first))
    SC.write_stream_source(second, path=src)
    assert flags(SC.descriptor_cache_stream(spark, src, f.schema, max_files=3, root=at)) == flags(WN.running_new_flags(f))
    again = SC.descriptor_cache_stream(spark, src, f.schema, max_files=3, root=at)        # nothing came since
    assert flags(again) == flags(WN.running_new_flags(f))


def test_hit_rate_on_a_stream_drops_late_rows(spark):
    rows = [("2024-01-01", True), ("2024-01-01", False), ("2024-01-02", False), ("2024-01-09", True), ("2024-01-10", False)]
    late = [("2024-01-01", False), ("2024-01-09", False)]
    make = lambda part: spark.createDataFrame(part, "posted_date string, is_new boolean").withColumn(
        "posted_date", F.to_date("posted_date"))
    on_time, at = make(rows), root(spark)
    src = SC.write_stream_source(on_time)
    got = {str(r.window_start): (r.hit_rate, r.n) for r in SC.hit_rate_stream(spark, src, on_time.schema, root=at).collect()}
    assert got == {"2024-01-01": (0.5, 2), "2024-01-02": (1.0, 1)}                        # the last windows are open
    SC.write_stream_source(make(late), path=src)
    SC.end_source(src, on_time, after_days=4)
    got = {str(r.window_start): (r.hit_rate, r.n) for r in SC.hit_rate_stream(spark, src, on_time.schema, root=at).collect()}
    assert got == {"2024-01-01": (0.5, 2), "2024-01-02": (1.0, 1), "2024-01-09": (0.5, 2), "2024-01-10": (1.0, 1)}


def test_rollup_log_is_bounded_and_restarts(spark):
    f = feed(spark).withColumn("canonical_merchant", F.col("description"))
    at, src = root(spark), SC.write_stream_source(f.filter("posted_date < '2024-01-15'"))
    run = lambda: SC.spend_rollup_stream(spark, src, f.schema, lambda s: s, compact_every=3, root=at)
    run()
    SC.write_stream_source(f.filter("posted_date >= '2024-01-15'"), path=src)
    got = {(r.day, r.customer_id, r.canonical_merchant): (r.total_spend, r.txn_count) for r in run().collect()}
    want = {(r.posted_date, r.customer_id, r.canonical_merchant): (r.s, r.n) for r in
            f.groupBy("posted_date", "customer_id", "canonical_merchant").agg(F.sum("amount").alias("s"), F.count("amount").alias("n")).collect()}
    assert got == want
    assert len(SC._numbered(spark, f"{at}/log", "b")) <= 6 and len(SC._numbered(spark, f"{at}/open", "upto")) <= 2
    last = SC._numbered(spark, f"{at}/open", "upto")[-1]
    still_open = spark.read.parquet(f"{at}/open/upto={last}").select("w").distinct().count()
    assert still_open <= 4 and len(SC._numbered(spark, f"{at}/closed", "upto")) > 5


def test_a_repeated_batch_changes_nothing(spark):
    f = feed(spark, 60, 6).withColumn("w", F.window(F.col("posted_date").cast("timestamp"), "1 day"))
    f = f.groupBy("w", "customer_id", F.col("description").alias("canonical_merchant")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("spend"), F.count(F.lit(1)).alias("txn_count"))
    table = SC.RollupTable(spark, root(spark), f.withColumn("batch", F.lit(0).cast("long")).schema, "2 days", 2)
    for batch_id in (0, 1, 1, 2, 3, 3):
        table.write(f.filter(F.dayofmonth("w.start") == batch_id + 1), batch_id)
    want = f.filter(F.dayofmonth("w.start") <= 4)
    assert sorted(map(str, table.rows().drop("batch").collect())) == sorted(map(str, want.collect()))


def test_enrich_batches_equals_batch(spark):
    from merchantry.operators.routes import CleanerRoute
    f = feed(spark, 50, 5)
    src = SC.write_stream_source(f)
    got = SC.enrich_batches(spark, src, f.schema, CleanerRoute(), max_files=2)
    want = CleanerRoute().transform(f)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_files_and_state_follow_the_rows_not_the_shuffle_partitions(spark):
    """200 partitions made a small source hundreds of files and every batch hundreds of state tasks."""
    rows = [(f"T{i:05d}", f"shop {i % 7}", f"2024-01-{i % 3 + 1:02d}") for i in range(300)]
    f = spark.createDataFrame(rows, "txn_id string, description string, d string").selectExpr(
        "txn_id", "description", "cast(d as date) as posted_date")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        at, src = root(spark), SC.write_stream_source(f)
        assert sum(n.endswith(".parquet") for d in SC._names(spark, src) if "=" in d for n in SC._names(spark, f"{src}/{d}")) == 3
        got = SC.descriptor_cache_stream(spark, src, f.schema, root=at)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
        kept = [n for n in SC._names(spark, f"{at}/_ckpt/state/0") if n.isdigit()]
        assert len(kept) == min(200, 2 * spark.sparkContext.defaultParallelism)
        assert {r.txn_id for r in got.filter("is_new").collect()} == {r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))
                                                                      if r[0] == min((x[2], x[0]) for x in rows if x[1] == r[1])[1]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_enrich_batches_matches_a_text_once(spark):
    """Texts that an earlier batch had are not matched again; a later call with another route matches anew."""
    from merchantry.operators.routes import RulesRoute
    gold = "txn_id string, category string, canonical_merchant string"
    train = spark.createDataFrame([("T1", "Corner Bakery #11", 5814, -10.0), ("T2", "BP on Buford Hwy", None, -40.0)],
                                  "txn_id string, description string, mcc int, amount double")
    route = RulesRoute().fit(train, spark.createDataFrame([("T1", "Food", "Corner Bakery"), ("T2", "Travel", "BP")], gold))
    other = RulesRoute().fit(train, spark.createDataFrame([("T1", "Food", "Corner"), ("T2", "Travel", "Buford Hwy")], gold))
    names = ["Corner Bakery", "BP #5", "Unknown Shop", None, "corner bakery #7", ""]
    rows = [(f"X{day}{i}", names[(i + day) % 6], None if i % 2 else 5814, -1.0 * i, f"2024-01-0{1 + day}")
            for day in range(4) for i in range(6)] + [("X9", "Late Cafe", None, 2.0, "2024-01-04")]
    feed = spark.createDataFrame(rows, "txn_id string, description string, mcc int, amount double, posted_date string") \
        .withColumn("posted_date", F.to_date("posted_date"))
    src = SC.write_stream_source(feed)
    seen, match = [], route.match_texts

    def counting(texts):
        seen.append([r["_fallback"] for r in texts.collect()])
        return match(texts)
    route.match_texts = counting
    root = SC._root(spark, "s4-once")
    got = SC.enrich_batches(spark, src, feed.schema, route, max_files=1, root=root)
    assert len(seen) == 4
    every = [x for batch in seen for x in batch]
    assert len(every) == len(set(every)) and seen[1:3] == [[], []] and seen[3] == ["Late Cafe"]
    del route.match_texts
    assert sorted(map(str, got.collect())) == sorted(map(str, route.transform(feed).select(got.columns).collect()))
    more = feed.filter("txn_id like 'X0%'").withColumn("txn_id", F.concat(F.lit("Y"), "txn_id")).withColumn(
        "posted_date", F.to_date(F.lit("2024-02-01")))
    SC.write_stream_source(more, path=src)
    again = SC.enrich_batches(spark, src, feed.schema, other, max_files=1, root=root).filter("txn_id like 'Y%'")
    assert sorted(map(str, again.collect())) == sorted(map(str, other.transform(more).select(got.columns).collect()))
