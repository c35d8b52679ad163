"""Evaluation views and the descriptor cache (F7, F8, C12, C13, D2, D36 counters).

Everything is a semi/anti/equi join on ``description`` or ``txn_id``; no id or
descriptor set is materialised on the driver. Joins on ``description`` are shuffle
joins whose hot keys (one descriptor repeated by a third of the rows) are split by
AQE's skew-join handling; the right side is always pre-aggregated to one row per key,
so a hot key never multiplies rows.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.operators.aggregates import conflicting_descriptors
from merchantry.operators.splits import seeded_order


class Views(NamedTuple):
    train_feed: DataFrame
    train_gold: DataFrame
    eval_feed: DataFrame
    model_feed: DataFrame
    model_gold: DataFrame
    cache: DataFrame
    ideal_feed: DataFrame
    ideal_gold: DataFrame
    stats: DataFrame


def build_views(feed: DataFrame, gold: DataFrame, membership: DataFrame, cap: int | None = None,
                seed: int = K.SEED, labelled_feed: DataFrame | None = None, write=None) -> Views:
    """F7 + F8 for one split. ``membership`` is (txn_id, is_eval). ``labelled_feed``
    (feed rows already carrying gold columns) spares the feed/gold join for the
    conflict set; ``write`` (a table, a name) then keeps its rows of each side, so that what is derived from
    a side does not look up its ids again. Without ``cap`` the model view has every descriptor; with it, the rows of
    the others are missing from the views too (``stats``: model_view_n against capped_n)."""
    ev = membership.filter("is_eval").select("txn_id")
    tf = feed.join(ev, "txn_id", "left_anti")
    tg = gold.join(ev, "txn_id", "left_anti")
    ef = feed.join(ev, "txn_id", "left_semi")
    eg = gold.join(ev, "txn_id", "left_semi")
    kept = None
    if write is not None and labelled_feed is not None:
        kept = write(labelled_feed.join(ev, "txn_id", "left_anti").select(*labelled_feed.columns), "train_rows")
        held = write(labelled_feed.join(ev, "txn_id", "left_semi").select(*labelled_feed.columns), "eval_rows")
        tf, tg, ef, eg = (side.select(*table.columns) for side in (kept, held) for table in (feed, gold))
    conflicts = (conflicting_descriptors(labelled_feed, None) if labelled_feed is not None
                 else conflicting_descriptors(feed, gold)).select("description")
    conflicts = write(conflicts, "conflicts") if kept is not None else conflicts
    train_desc = tf.select("description").distinct()

    # misses only, one row (smallest txn_id) per descriptor, capped by seeded hash.
    miss = (ef.join(train_desc, "description", "left_anti")
            .join(conflicts, "description", "left_anti"))
    reps = miss.groupBy("description").agg(F.min("txn_id").alias("txn_id"))
    pool = miss.join(reps, ["description", "txn_id"], "left_semi")
    model_feed = (pool.orderBy(seeded_order(seed), "txn_id").limit(cap) if cap else pool)
    model_gold = eg.join(model_feed.select("txn_id"), "txn_id", "left_semi")

    # F8 + C12: hits take the first non-conflicting train row of their descriptor.
    tl = ((labelled_feed.join(ev, "txn_id", "left_anti") if kept is None else kept).select("txn_id", "description", "canonical_merchant",
                                                                "category")
          if labelled_feed is not None else
          tf.select("txn_id", "description").join(tg.select("txn_id", "canonical_merchant", "category"), "txn_id"))
    train_rep = (tl.join(conflicts, "description", "left_anti")
                 .groupBy("description")
                 .agg(F.min_by(F.struct(F.col("txn_id").alias("rep_txn_id"),
                                        F.col("canonical_merchant").alias("cache_merchant"),
                                        F.col("category").alias("cache_category")),
                               "txn_id").alias("r"))
                 .select("description", "r.*"))
    hits = (ef.select("txn_id", "description").join(conflicts, "description", "left_anti")
            .join(train_rep, "description")
            .select("txn_id", F.lit(True).alias("cache_hit"), "rep_txn_id", "cache_merchant",
                    "cache_category"))
    # Misses of a capped model-view descriptor point at its representative row.
    model_rep = model_feed.select("description", F.col("txn_id").alias("rep_txn_id"))
    misses = (ef.select("txn_id", "description").join(model_rep, "description")
              .select("txn_id", F.lit(False).alias("cache_hit"), "rep_txn_id",
                      F.lit(None).cast("string").alias("cache_merchant"),
                      F.lit(None).cast("string").alias("cache_category")))
    cache = hits.unionByName(misses)
    ideal_feed = ef.join(cache.select("txn_id"), "txn_id", "left_semi")
    ideal_gold = eg.join(cache.select("txn_id"), "txn_id", "left_semi")

    stats = view_stats(ef, train_desc, conflicts, pool, model_feed, hits)
    return Views(tf, tg, ef, model_feed, model_gold, cache, ideal_feed, ideal_gold, stats)


def view_stats(ef: DataFrame, train_desc: DataFrame, conflicts: DataFrame, pool: DataFrame,
               model_feed: DataFrame, hits: DataFrame) -> DataFrame:
    """D36 counters of a split as one row, from one pass over the eval rows."""
    flags = (ef.select("txn_id", "description")
             .join(train_desc.withColumn("_in_train", F.lit(True)), "description", "left")
             .join(conflicts.withColumn("_conflict", F.lit(True)), "description", "left")
             .join(hits.select("txn_id", F.lit(True).alias("_hit")), "txn_id", "left")
             .join(pool.select("txn_id", F.lit(True).alias("_pool")), "txn_id", "left")
             .join(model_feed.select("txn_id", F.lit(True).alias("_capped")), "txn_id", "left"))
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flags.agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.count_if(t("_in_train")).alias("removed_verbatim"),
        F.round(F.count_if(t("_hit")) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("cache_hit_rate"),
        F.count_if(t("_conflict")).alias("conflict_eval_rows"),
        F.count_if(t("_pool")).alias("model_view_n"),
        F.count_if(t("_capped")).alias("capped_n"))


def ideal_preds(model_preds: DataFrame, cache: DataFrame) -> DataFrame:
    """Ideal-cache predictions — a hit takes the cached train label, a miss the
    model-view prediction of its representative row."""
    mp = model_preds.select(F.col("txn_id").alias("rep_txn_id"),
                            F.col("canonical_merchant").alias("_pm"), F.col("category").alias("_pc"))
    j = cache.join(mp, "rep_txn_id", "left")
    return j.select("txn_id", "cache_hit",
                    F.when(F.col("cache_hit"), F.col("cache_merchant")).otherwise(F.col("_pm"))
                    .alias("canonical_merchant"),
                    F.when(F.col("cache_hit"), F.col("cache_category")).otherwise(F.col("_pc"))
                    .alias("category"))
