"""Group-by operators.

All are hash aggregates with map-side partial aggregation, so a hot key (one merchant
or customer holding a third of the rows) is pre-combined in every task before the
shuffle and costs one row per task downstream. Ties are broken by explicit keys
(``min_by``/``max_by`` on a struct), never by row order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.text import clean_description, conflict_key

MONEY = "decimal(18,2)"


def money_sum(c) -> Column:
    """Exact, order-independent money sum (doubles summed in any order can differ)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY))


def rollup_by_merchant(df: DataFrame, merchant: str = "canonical_merchant",
                       ordered: bool = True) -> DataFrame:
    """Per (customer_id, merchant) total absolute spend (2 dp) and row count,
    ordered by customer then spend descending."""
    out = (df.groupBy("customer_id", merchant)
           .agg(F.round(money_sum(F.abs("amount")), 2).cast("double").alias("total_spend"),
                F.count(F.lit(1)).alias("txn_count")))
    return out.orderBy("customer_id", F.desc("total_spend")) if ordered else out


def labelled(feed: DataFrame, gold: DataFrame | None, cols: list[str]) -> DataFrame:
    """Feed rows with gold columns. ``gold=None`` means the feed already carries them
    (one table holding both), which saves a join on txn_id."""
    if gold is None:
        return feed
    return feed.join(gold.select("txn_id", *[c for c in cols if c != "txn_id"]), "txn_id")


def conflicting_descriptors(feed: DataFrame, gold: DataFrame | None) -> DataFrame:
    """Descriptors carrying more than one distinct (merchant, txn_type), with rows."""
    j = labelled(feed, gold, ["canonical_merchant", "txn_type"]).select(
        "description", conflict_key("canonical_merchant", "txn_type").alias("key"))
    return (j.groupBy("description")
            .agg(F.countDistinct("key").alias("k"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("k") > 1))


def composition(gold: DataFrame) -> DataFrame:
    """D3: long table (dimension, value, n): rows, distinct merchants, rows per category
    and per origin (null origin reported as ``none``)."""
    g = gold.select("category", F.coalesce("origin", F.lit("none")).alias("origin"),
                    "canonical_merchant")
    by_cat = g.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("category").alias("dimension"), F.col("category").alias("value"), "n")
    by_org = g.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("origin").alias("dimension"), F.col("origin").alias("value"), "n")
    tot = g.agg(F.count(F.lit(1)).alias("rows"),
                F.countDistinct("canonical_merchant").alias("merchants"))
    tot = tot.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("dimension"), F.lit(None).cast("string").alias("value"),
                 F.col("rows").alias("n")),
        F.struct(F.lit("merchants").alias("dimension"), F.lit(None).cast("string").alias("value"),
                 F.col("merchants").alias("n")))).alias("s")).select("s.*")
    return by_cat.unionByName(by_org).unionByName(tot)


def majority_category(df: DataFrame, key: str, order: str = "txn_id",
                      category: str = "category") -> DataFrame:
    """Per key the most frequent category; ties go to the category seen first
    (smallest ``order``). Two aggregations, no window over a hot key."""
    counts = (df.filter(F.col(key).isNotNull())
              .groupBy(key, category)
              .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")))
    return counts.groupBy(key).agg(
        F.min_by(category, F.struct((-F.col("_n")).alias("a"), F.col("_first").alias("b")))
        .alias(category))


def global_majority(df: DataFrame, category: str = "category") -> DataFrame:
    """The most frequent category (ties: smallest name); one row."""
    return (df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.min_by(category, F.struct((-F.col("_n")).alias("a"),
                                             F.col(category).alias("b"))).alias(category)))


def known_list(train: DataFrame) -> DataFrame:
    """The learned list ``(key, name, kind, ord)`` from train rows with
    (txn_id, canonical_merchant, txn_type). ``key`` = cleaned label; the last row's
    name wins a key; merchants and types are kept apart and a merchant wins a key
    it shares with a type, at the type's position. ``ord`` orders types first, then
    merchants, each by first appearance (txn_id)."""
    lab = train.select(
        "txn_id",
        F.when(F.col("canonical_merchant").isNotNull(), "merchant")
         .when(F.col("txn_type").isNotNull(), "type").alias("kind"),
        F.coalesce("canonical_merchant", "txn_type").alias("name")).filter(F.col("kind").isNotNull())
    per = (lab.withColumn("key", clean_description("name"))
           .groupBy("key", "kind")
           .agg(F.max_by("name", "txn_id").alias("name"), F.min("txn_id").alias("first")))
    return (per.groupBy("key").agg(
        F.max_by("name", F.col("kind") == "merchant").alias("name"),
        F.max_by("kind", F.col("kind") == "merchant").alias("kind"),
        F.min(F.struct(F.when(F.col("kind") == "type", 0).otherwise(1).alias("k"),
                       F.col("first").alias("f"))).alias("ord")))


def one_per_descriptor(feed: DataFrame) -> DataFrame:
    """The smallest txn_id of every description."""
    return feed.groupBy("description").agg(F.min("txn_id").alias("txn_id"))


def first_per_group(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """The row with the smallest ``order`` in every group (keep-first distinct)."""
    s = F.min_by(F.struct(*[F.col(c) for c in [order] + cols]), order).alias("_r")
    return df.groupBy(key).agg(s).select(key, "_r.*")


def spend_by_descriptor(statement: DataFrame, types=("DEB", "DD")) -> DataFrame:
    """Debit rows of the given types: per description the absolute debit sum
    (null = 0), the row count and the count of null debits."""
    return (statement.filter(F.col("type").isin(*types))
            .groupBy("description")
            .agg(F.round(money_sum(F.abs(F.coalesce("debit", F.lit(0.0)))), 2).cast("double")
                 .alias("spend"),
                 F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("debit").isNull()).alias("n_null_debit")))


def seen_at_least(df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """Keys seen at least ``k`` times (the realistic known list)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)


def busiest(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """The most frequent key, smallest on ties; one row."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.min_by(key, F.struct((-F.col("_n")).alias("a"), F.col(key).alias("b"))).alias(key),
                 F.max("_n").alias("n")))


def synth_stats(gold: DataFrame, feed: DataFrame) -> DataFrame:
    """Per origin (``all`` for the total) merchants, rows and distinct descriptors
    per row."""
    j = gold.join(feed.select("txn_id", "description"), "txn_id")
    j = j.withColumn("origin", F.coalesce("origin", F.lit("none")))
    per = j.groupBy("origin").agg(
        F.countDistinct("canonical_merchant").alias("merchants"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("description").alias("descriptors"))
    tot = j.agg(F.countDistinct("canonical_merchant").alias("merchants"),
                F.count(F.lit(1)).alias("rows"),
                F.countDistinct("description").alias("descriptors")).withColumn("origin", F.lit("all"))
    out = per.unionByName(tot)
    return out.withColumn("descriptors_per_row",
                          F.round(F.col("descriptors") / F.col("rows"), 6))


def customer_spend_compare(feed: DataFrame, gold: DataFrame, pred: DataFrame,
                           customer: str) -> DataFrame:
    """Gold and predicted spend per gold merchant of one customer (missing = 0)."""
    base = feed.filter(F.col("customer_id") == customer).select("txn_id", "customer_id", "amount")
    g = rollup_by_merchant(base.join(gold.select("txn_id", "canonical_merchant"), "txn_id")
                           .filter(F.col("canonical_merchant").isNotNull()), ordered=False)
    p = rollup_by_merchant(base.join(pred.select("txn_id", "canonical_merchant"), "txn_id"),
                           ordered=False).withColumnRenamed("total_spend", "pred_spend")
    return (g.join(p.drop("txn_count"), ["customer_id", "canonical_merchant"], "left")
            .select("canonical_merchant", F.col("total_spend").alias("gold_spend"),
                    F.coalesce("pred_spend", F.lit(0.0)).alias("pred_spend")))
