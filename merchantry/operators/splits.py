"""Sampling and evaluation splits.

Splits are membership tables ``(txn_id, is_eval)`` decided per key by a hash, so a
row's side never depends on which other rows exist and no id set passes through the
driver. Seeded caps keep the rows with the smallest seeded hash (a top-k, not a sort
of everything).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.hashing import hkey, in_eval, uniform
from merchantry.operators.families import brand_families


def seeded_order(seed: int, key: str = "txn_id") -> Column:
    return uniform(hkey(str(seed), "order", F.col(key)))


def seeded_cap(df: DataFrame, n: int, seed: int = K.SEED, key: str = "txn_id") -> DataFrame:
    """exactly ``n`` rows (or all), the smallest by a seeded hash of ``key`` — stable
    across runs and partitionings, unlike ``DataFrame.sample``. Runs as a per-partition
    top-n merged on the driver side of the plan (TakeOrderedAndProject)."""
    return df.orderBy(seeded_order(seed, key), F.col(key)).limit(n)


def first_n(df: DataFrame, n: int, key: str = "txn_id") -> DataFrame:
    """the first ``n`` rows in ``key`` order."""
    return df.orderBy(key).limit(n)


def split_random(df: DataFrame, seed: int = K.SEED, frac: float = 0.2, key: str = "txn_id",
                 exact: bool = False, rows_per_bucket: int = 500_000) -> DataFrame:
    """``(key, is_eval)``. The rows are permuted by a seeded hash ``u`` of the key.

    ``exact=False``: a row is held out when ``u`` falls in the top ``frac`` (per-key
    stable, ``frac`` in expectation). ``exact=True``: the permutation is cut exactly at
    ``int((1 - frac) * n)``. The global rank comes from range buckets of ``u`` (uniform,
    so balanced; about ``rows_per_bucket`` rows each), a rank inside each bucket and
    bucket offsets from a running sum over the bucket counts, so no task sorts
    everything."""
    u = seeded_order(seed, key)
    if not exact:
        return df.select(key, (u >= F.lit(1.0 - frac)).alias("is_eval"))
    n = df.count()
    cut = int((1.0 - frac) * n)
    buckets = max(64, -(-n // rows_per_bucket))
    d = df.select(key, u.alias("_u")).withColumn("_b", F.floor(F.col("_u") * buckets).cast("bigint"))
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_sz"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (d.join(F.broadcast(sizes.select("_b", "_off")), "_b")   # <= buckets rows
              .withColumn("_rank", F.col("_off") - 1 + F.row_number().over(
                  Window.partitionBy("_b").orderBy("_u", key))))
    return ranked.select(key, (F.col("_rank") >= F.lit(cut)).alias("is_eval"))


def split_unseen(gold: DataFrame, frac: float = 0.2) -> DataFrame:
    """brand-disjoint split ``(txn_id, is_eval)``. Every merchant of a brand family
    goes to the side its family key hashes to (B12 on the key); merchant-less rows hash
    by their own txn_id."""
    merchants = gold.select(F.col("canonical_merchant").alias("name")).filter(
        F.col("name").isNotNull()).distinct()
    fam = brand_families(merchants).select(
        F.col("name").alias("canonical_merchant"), in_eval("family", frac).alias("_fam_eval"))
    g = gold.select("txn_id", "canonical_merchant").join(fam, "canonical_merchant", "left")
    return g.select("txn_id", F.when(F.col("canonical_merchant").isNull(), in_eval("txn_id", frac))
                    .otherwise(F.col("_fam_eval")).alias("is_eval"))


def apply_split(feed: DataFrame, gold: DataFrame, membership: DataFrame):
    """(train_feed, train_gold, eval_feed, eval_gold) from a membership table."""
    ev = membership.filter("is_eval").select("txn_id")
    return (feed.join(ev, "txn_id", "left_anti"), gold.join(ev, "txn_id", "left_anti"),
            feed.join(ev, "txn_id", "left_semi"), gold.join(ev, "txn_id", "left_semi"))


def valid_split(df: DataFrame, frac: float = 0.1, seed: int = K.SEED, key: str = "txn_id", exact: bool = False
                ) -> DataFrame:
    """adds ``split`` = ``train`` / ``valid`` by a seeded hash: ``frac`` in expectation, or with ``exact`` cut
    at ``int((1 - frac) * n)`` of the seeded permutation (``key`` is unique then)."""
    if exact:
        held = split_random(df, seed, frac, key, exact=True).filter("is_eval").select(key, F.lit("valid").alias("split"))
        return df.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))
    return df.withColumn("split", F.when(uniform(hkey(str(seed), "valid", F.col(key))) < frac,
                                         "valid").otherwise("train"))


def known_heldout(df: DataFrame, key: str, k: int = 2):
    """(known, held_out) rows by whether ``key`` is seen at least ``k`` times."""
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(key)
    return df.join(seen, key, "left_semi"), df.join(seen, key, "left_anti")
