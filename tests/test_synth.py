"""Feed synthesis invariants on the 10-description fixture cycled to 300 rows."""
import re

import pytest
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.operators.synth import GOLD_COLUMNS, build_feed, local_merchants

DATA = [
    ("McDonald's #111", "Food & Dining", "USA", "USD"),
    ("McDonald's #121", "Food & Dining", "USA", "USD"),
    ("BP on Buford Hwy", "Transportation", "USA", "USD"),
    ("BP @ Pleasant Hills", "Transportation", "USA", "USD"),
    ("Amazon - AUSTRALIA", "Shopping & Retail", "AUSTRALIA", "AUD"),
    ("Walgreens #8780", "Healthcare & Medical", "UK", "GBP"),
    ("Wage", "Income", "USA", "USD"),
    ("Salary - Rush Hour", "Income", "CANADA", "CAD"),
    ("Starbucks - AUSTRALIA Store", "Food & Dining", "AUSTRALIA", "AUD"),
    ("Disney+ #2115", "Entertainment & Recreation", "INDIA", "INR"),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(i, *DATA[i % 10], i % 37, 10.0 + i % 13) for i in range(300)]
    raw = spark.createDataFrame(rows, "row_id long, transaction_description string, category string, country string, "
                                      "currency string, customer_no long, amount_abs double").withColumn(
        "posted_date", F.to_date(F.lit("2026-01-15")))
    hf, hg = build_feed(spark, raw, hard=True)
    cf, cg = build_feed(spark, raw, hard=False)
    return [x.cache() for x in (hf, hg, cf, cg)]


def test_columns_and_leak_guard(built):
    hf, hg, _, _ = built
    assert not {"category", "canonical_merchant", "txn_type", "origin"} & set(hf.columns)
    assert hg.columns == GOLD_COLUMNS
    g = hg.collect()
    assert all((r["canonical_merchant"] is None) != (r["txn_type"] is None) for r in g)
    assert all((r["origin"] is None) == (r["canonical_merchant"] is None) for r in g)
    assert all(re.match(r"^[IO]-[A-Z]+$", r["transaction_type_code"]) for r in hf.collect())


def test_labels_identical_with_and_without_noise(built):
    hf, hg, cf, cg = built
    labels = ["txn_id", "category", "canonical_merchant", "txn_type", "direction", "origin"]
    assert sorted(map(tuple, hg.select(labels).collect())) == sorted(map(tuple, cg.select(labels).collect()))
    cols = ["txn_id", "customer_id", "amount", "mcc", "posted_date", "payment_method"]
    assert sorted(map(tuple, hf.select(cols).collect())) == sorted(map(tuple, cf.select(cols).collect()))
    assert {r[0] for r in hf.select("description").collect()} != {r[0] for r in cf.select("description").collect()}


def test_locals_share_category_and_first_rows(built):
    _, hg, cf, cg = built
    g = cg.collect()
    merchant = [r for r in g if r["canonical_merchant"] is not None]
    local = [r for r in merchant if r["origin"] == "local"]
    assert 0.15 < len(local) / len(merchant) < 0.35
    assert not {r["category"] for r in local} & {"Income", "Financial Services"}
    head = [r for r in g if r["txn_id"] < "T00000010" and r["origin"] is not None]
    assert all(r["origin"] == "source" for r in head)
    assert {r["canonical_merchant"] for r in merchant if r["origin"] == "source"} == {
        "McDonald's", "BP on Buford Hwy", "BP @ Pleasant Hills", "Amazon", "Walgreens", "Starbucks", "Disney+"}
    j = cf.join(cg, "txn_id").filter(F.col("origin") == "local")
    assert j.filter(F.col("description") != F.col("canonical_merchant")).count() == 0


def test_hard_mode_repeats_descriptors(built):
    hf, hg, _, _ = built
    assert hf.select("description").distinct().count() < 0.6 * hf.count()
    # every (name, location) has one descriptor: at most min(200, ceil(n/3)) per name
    j = hf.join(hg, "txn_id").withColumn("name", F.coalesce("canonical_merchant", "txn_type"))
    per = j.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("description").alias("d")).collect()
    for r in per:
        assert r["d"] <= min(K.LOCATIONS_CAP, -(-r["n"] // K.LOCATIONS_ROWS_PER))


def test_deterministic(built, spark):
    hf = built[0]
    rows = [(i, *DATA[i % 10], i % 37, 10.0 + i % 13) for i in range(300)]
    raw = spark.createDataFrame(rows, "row_id long, transaction_description string, category string, country string, "
                                      "currency string, customer_no long, amount_abs double").withColumn(
        "posted_date", F.to_date(F.lit("2026-01-15"))).repartition(3)
    again, _ = build_feed(spark, raw, hard=True)
    assert sorted(map(tuple, hf.collect())) == sorted(map(tuple, again.collect()))


SOURCE = ["McDonald's", "Walmart", "Walmart Pharmacy", "Family Dental", "Blue Bottle", "Nordstrom",
          "Nordstrom Rack", "Pharmacy", "Kroger Pharmacy", "Safeway Pharmacy", "Fox Theater", "Pizza Hut",
          "Grill House"]


def test_local_merchants_properties(spark):
    from merchantry.functions.text import name_tokens
    src = spark.createDataFrame([(s,) for s in SOURCE], "label string")
    a = local_merchants(spark, src).collect()
    b = local_merchants(spark, src).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 800 and len({r["name"] for r in a}) == 800
    assert {r["category"] for r in a} == set(K.LOCAL_NOUNS)
    banned = {t for r in src.select(name_tokens("label")).collect() for t in r[0]}
    toks = spark.createDataFrame([(r["name"],) for r in a], "n string").select(name_tokens("n")).collect()
    assert not any(set(t[0]) & banned for t in toks)
    other = local_merchants(spark, src, seed=7).collect()
    assert {r["name"] for r in other} != {r["name"] for r in a}


def test_build_feed_from_bare_labelled_set(spark):
    raw = spark.createDataFrame([DATA[i % 10] for i in range(300)],
                                "transaction_description string, category string, country string, currency string")
    feed, gold = build_feed(spark, raw.coalesce(1), hard=True)
    f = feed.collect()
    assert len(f) == 300 and len({r["txn_id"] for r in f}) == 300
    assert all(r["amount"] != 0 and r["posted_date"].year == 2026 for r in f)
    assert len({r["customer_id"] for r in f}) > 50
    assert gold.filter("canonical_merchant IS NULL AND txn_type IS NULL").count() == 0


def test_merged_labels_share_location_descriptors(spark):
    rows = [(i, "Cane's #12" if i % 2 else "Raising Cane's - USA", "Food & Dining", "USA", "USD", 1, 5.0)
            for i in range(120)]
    raw = spark.createDataFrame(rows, "row_id long, transaction_description string, category string, country string, "
                                      "currency string, customer_no long, amount_abs double").withColumn(
        "posted_date", F.to_date(F.lit("2026-01-15")))
    feed, gold = build_feed(spark, raw, hard=True)
    j = feed.join(gold, "txn_id").filter(F.col("canonical_merchant") == "Raising Cane's")
    n = j.count()
    assert n > 0
    assert j.select("description").distinct().count() <= min(K.LOCATIONS_CAP, -(-n // K.LOCATIONS_ROWS_PER))


def test_sample_then_synthesise_then_roundtrip(spark):
    """A2 -> H4 -> A3 -> A1: stratified sample of a bare labelled set, feed synthesis,
    Parquet write and schema-checked read back."""
    import os
    import tempfile
    from merchantry.sources import io as IO
    d = tempfile.mkdtemp(prefix="merchantry-test-", dir="/tmp")
    spark.createDataFrame([DATA[i % 10] for i in range(400)], IO.RAW_SCHEMA).write.parquet(os.path.join(d, "raw"))
    sample = IO.load_sample(spark, os.path.join(d, "raw"), n=200)
    assert sample.count() == 200
    feed, gold = build_feed(spark, sample, hard=True)
    IO.write_feed_gold(feed, gold, os.path.join(d, "out"))
    f2, g2 = IO.read_feed_gold(spark, os.path.join(d, "out", "bank_feed"), os.path.join(d, "out", "gold"))
    assert f2.count() == g2.count() == 200
    assert sorted(map(tuple, f2.select("txn_id", "description").collect())) == \
        sorted(map(tuple, feed.select("txn_id", "description").collect()))


def test_costly_rows_are_dealt_to_several_tasks(spark, tmp_path):
    """one file of one row group left all draws and texts to one task."""
    from merchantry.plans.testdata import raw_labelled
    spark.range(0, 9000).selectExpr("id as event_id", "timestamp'2024-01-01 00:00:00' as ts", "id % 50 as user_id", "'view' as event_type",
                                    "1.5d as value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0, 40).selectExpr("id as p_partkey", "concat('red ring ', id) as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    raw = raw_labelled(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() >= min(5, 2 * spark.sparkContext.defaultParallelism)
    assert raw.select("row_id").distinct().count() == 9000


def test_codes_and_first_text_of_a_location(spark):
    from pyspark.sql import functions as F
    from merchantry.functions import synth as S
    n = spark.createDataFrame([(0, None), (1, -7), (2, 0), (3, 99999), (4, 123456789012)], "i int, n long")
    got = n.select(S.customer_code(F.col("n")), F.format_string("C%05d", "n"), S.txn_code(F.col("n")), F.format_string("T%08d", "n")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
