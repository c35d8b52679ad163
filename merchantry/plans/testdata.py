"""How the supplied tables stand in for bank data (Spark side).

``raw``  : one labelled row per ``events`` row. The merchant is the ``part`` row whose
           key is a hash of the event id (an equi join, no skew: the key is a hash);
           ``signup`` events are merchant-less money movements (a type label).
           The raw description decorates the label the way the source dataset does
           (store id, country, format word, time phrase, payment hint).
``feed`` / ``gold``: ``build_feed`` (H4) over ``raw``.

Every draw is a hash uniform of a key, so the DuckDB twin in ``plans/oracle.py``
computes the very same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions import synth as S
from merchantry.functions.hashing import hkey, int_between, pick, uniform
from merchantry.operators.synth import build_feed, build_feed_wide
from merchantry.session import spread

# Test-data mapping choices (ours, not fixed values of the reference).
TYPE_CATEGORY = {
    "Salary": "Income", "Payroll": "Income", "Refund": "Income", "Dividend": "Income",
    "Interest": "Income", "Holiday Pay": "Income", "Pension": "Income",
    "Transfer": "Financial Services", "ATM": "Financial Services", "Loan": "Financial Services",
}
TYPE_LABELS = list(TYPE_CATEGORY)
MERCHANT_CATEGORIES = [c for c in K.CATEGORIES if c not in ("Income", "Financial Services")]
CURRENCY = {"USA": "USD", "UK": "GBP", "CANADA": "CAD", "AUSTRALIA": "AUD", "INDIA": "INR"}
PAREN_HINTS = list(K.PAREN_PAYMENT_HINTS)
DECOR_P = {"store": 0.35, "country": 0.3, "format": 0.5, "time": 0.3, "paren": 0.2}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_parts = part.count()                      # one scalar; part keys are 0..n-1
    eid = F.col("event_id")
    ev = ev.withColumn("_pk", pick(hkey("part", eid), n_parts))
    d = ev.join(part, ev["_pk"] == part["p_partkey"], "inner").select(
        "event_id", "ts", "user_id", "event_type", "value", "p_name")
    d = spread(d, ev.count())                   # before the draws and the texts
    name = F.initcap(F.col("p_name"))
    is_type = F.col("event_type") == "signup"
    tlabel = S.choose(TYPE_LABELS, pick(hkey("type", eid), len(TYPE_LABELS)))
    tcat = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_CATEGORY.items() for x in kv]),
                        tlabel)
    mcat = S.choose(MERCHANT_CATEGORIES, pick(hkey("category", name), len(MERCHANT_CATEGORIES)))
    d = (d.withColumn("label", F.when(is_type, tlabel).otherwise(name))
         .withColumn("category", F.when(is_type, tcat).otherwise(mcat))
         .withColumn("country", S.choose(K.COUNTRIES, pick(hkey("country", eid), len(K.COUNTRIES)))))
    u = lambda tag: uniform(hkey("decor", tag, eid))
    desc = F.concat(
        F.col("label"),
        F.when(u("store") < DECOR_P["store"],
               F.concat(F.lit(" #"), int_between(hkey("storeno", eid), 100, 9999).cast("string")))
         .otherwise(F.lit("")),
        F.when(u("country") < DECOR_P["country"], F.concat(F.lit(" - "), F.col("country")))
         .otherwise(F.lit("")),
        F.when(u("format") < DECOR_P["format"], F.concat(F.lit(" "), S.choose(
            K.FORMAT_WORDS, pick(hkey("formatword", eid), len(K.FORMAT_WORDS))))).otherwise(F.lit("")),
        F.when(u("time") < DECOR_P["time"], F.concat(F.lit(" - "), S.choose(
            K.TIME_PHRASES, pick(hkey("timeword", eid), len(K.TIME_PHRASES))))).otherwise(F.lit("")),
        F.when(u("paren") < DECOR_P["paren"], F.concat(F.lit(" ("), S.choose(
            PAREN_HINTS, pick(hkey("parenword", eid), len(PAREN_HINTS))), F.lit(")")))
         .otherwise(F.lit("")))
    cur = F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]),
                       F.col("country"))
    return d.select(
        eid.alias("row_id"), desc.alias("transaction_description"), "category", "country",
        cur.alias("currency"), F.col("user_id").alias("customer_no"),
        F.col("value").alias("amount_abs"), F.to_date("ts").alias("posted_date"))


def feed_gold(spark: SparkSession, sf_dir: str, hard: bool = True) -> tuple[DataFrame, DataFrame]:
    return build_feed(spark, raw_labelled(spark, sf_dir), hard=hard)


def feed_gold_wide(spark: SparkSession, sf_dir: str, hard: bool = True) -> DataFrame:
    return build_feed_wide(spark, raw_labelled(spark, sf_dir), hard=hard)
