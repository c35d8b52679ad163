"""Scans and sinks (A1-A4, A10-A12) with explicit schemas (no inference)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.dates import parse_dmy

FEED_SCHEMA = ("txn_id string, customer_id string, description string, transaction_type_code string, "
               "mcc int, amount double, payment_method string, posted_date date, country string, "
               "currency string")
GOLD_SCHEMA = ("txn_id string, category string, canonical_merchant string, txn_type string, "
               "direction string, origin string, noise_abbrev boolean, noise_trunc boolean")
RAW_SCHEMA = "transaction_description string, category string, country string, currency string"
LABELS_SCHEMA = "description string, n int, canonical_merchant string, confidence string, literal boolean"
ALIASES_SCHEMA = "canonical_merchant string, aliases string"
STATEMENT_COLUMNS = ["Transaction Date", "Transaction Type", "Transaction Description",
                     "Debit Amount", "Credit Amount", "Balance"]


def read_feed_gold(spark: SparkSession, feed_path: str, gold_path: str) -> tuple[DataFrame, DataFrame]:
    """A1: the feed and gold Parquet tables."""
    return spark.read.schema(FEED_SCHEMA).parquet(feed_path), spark.read.schema(GOLD_SCHEMA).parquet(gold_path)


def write_feed_gold(feed: DataFrame, gold: DataFrame, out: str, mode: str = "overwrite") -> None:
    """A3: feed and gold as Parquet under ``out``."""
    feed.write.mode(mode).parquet(f"{out}/bank_feed")
    gold.write.mode(mode).parquet(f"{out}/gold")


def load_sample(spark: SparkSession, path: str, n: int = 100_000, seed: int = K.SEED,
                by=("category", "country")) -> DataFrame:
    """A2: the raw labelled set, stratified-sampled (F4) by category x country."""
    from merchantry.functions.hashing import hkey, uniform
    from merchantry.operators.synth import stratified_sample
    raw = spark.read.schema(RAW_SCHEMA).parquet(path)
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns])
    u = uniform(hkey(str(seed), "sample", F.xxhash64(key).cast("string")))
    return stratified_sample(raw, n, list(by), u)


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: the labels CSV (description, n, canonical_merchant, confidence, literal)."""
    return spark.read.schema(LABELS_SCHEMA).option("header", True).csv(path)


def read_aliases_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: aliases CSV; the pipe-separated aliases become an array."""
    df = spark.read.schema(ALIASES_SCHEMA).option("header", True).csv(path)
    return df.withColumn("aliases", F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"),
                                                         lambda a: F.trim(a)), lambda a: a != ""))


def read_statement_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: a real bank statement; dates are dd/MM/yyyy; ``row_no`` follows file order
    (partition index, then position), which is stable for a given file layout."""
    schema = ", ".join(f"`{c}` {'double' if 'Amount' in c or c == 'Balance' else 'string'}"
                       for c in STATEMENT_COLUMNS)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(
        parse_dmy(F.col("Transaction Date")).alias("date"),
        F.col("Transaction Type").alias("type"), F.col("Transaction Description").alias("description"),
        F.col("Debit Amount").alias("debit"), F.col("Credit Amount").alias("credit"),
        F.col("Balance").alias("balance"),
        F.monotonically_increasing_id().alias("row_no"))


def export_chat_jsonl(feed: DataFrame, gold: DataFrame, out: str, categories=None,
                      valid_frac: float = 0.1, seed: int = K.SEED) -> None:
    """A10: chat-format training records (B23) split into train / valid, cut exactly (F9), and written
    as JSON lines, one directory per split. Without ``categories`` the prompts offer the sorted gold labels."""
    if categories is None:      # a label set
        rows = gold.select("category").filter("category is not null").distinct().orderBy("category").collect()
        categories = [r[0] for r in rows]
    from merchantry.functions.prompts import to_example
    from merchantry.operators.splits import valid_split
    j = feed.select("txn_id", "description").join(gold, "txn_id")
    if "txn_type" in j.columns:
        j = j.withColumn("canonical_merchant", F.coalesce("canonical_merchant", "txn_type"))
    rec = valid_split(j, valid_frac, seed, exact=True).select(
        "split", to_example(F.col("description"), F.col("canonical_merchant"), F.col("category"),
                            categories).alias("value"))
    rec.write.mode("overwrite").partitionBy("split").text(out)


def write_json(df: DataFrame, path: str) -> None:
    """A result table (leaderboard, stats, summaries) as JSON lines."""
    df.write.mode("overwrite").json(path)


def extract_rows(df: DataFrame, condition, path: str) -> DataFrame:
    """The rows of one dataset written to their own Parquet file set."""
    sub = df.filter(condition)
    sub.write.mode("overwrite").parquet(path)
    return sub.sparkSession.read.parquet(path)
