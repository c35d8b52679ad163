"""Composite evaluation reports.

Each report is one or two aggregations over a paired-prediction frame; a report that
needs several thresholds or gates computes them as conditional sums in one pass and
stacks them into long form.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.operators import stats as ST


def pair_routes(first: DataFrame, second: DataFrame, key: str = "txn_id") -> DataFrame:
    """C14: inner join of two routes' rows; refuses to shrink the row count."""
    j = first.join(second, key)
    missing = first.select(key).join(second.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("paired join does not cover every row of the first route")
    return j


def confidence_summary(rows: DataFrame, group=("dataset", "setting")) -> DataFrame:
    """Per group rows, share with gold in the list, share answered none, accepted
    right / wrong counts (D28-D30 are separate frames over the same rows)."""
    g = list(group)
    none = F.col("choice") == K.NONE_OPTION
    return rows.groupBy(*g).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.col("gold_in_list").cast("double")), 3).alias("gold_in_list"),
        F.round(F.avg(none.cast("double")), 3).alias("picked_none"),
        F.count_if(~none & F.col("correct")).alias("accepted_right"),
        F.count_if(~none & ~F.col("correct")).alias("accepted_wrong"))


def cascade_sweep(df: DataFrame, is_ok: Callable[[Column], Column], thresholds=K.CASCADE_THRESHOLDS,
                  weight: str | None = None, in_list: str | None = None) -> DataFrame:
    """Per threshold (and ``generator_only``), accept the choice when it is not none and
    its confidence reaches the threshold, else take the fallback; report accuracy,
    row-weighted accuracy, accuracy on rows whose gold is not in the list, and the
    escalated share. ``df`` has choice, confidence, fallback; ``is_ok(pred)`` is the
    correctness Column (U6)."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    off = ~F.coalesce(F.col(in_list), F.lit(True)) if in_list else F.lit(False)
    aggs, tags = [], [("generator_only", None)] + [(str(t), t) for t in thresholds]
    for i, (_, t) in enumerate(tags):
        acc = (F.lit(False) if t is None else
               (F.col("choice") != K.NONE_OPTION) & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= t))
        ok = F.coalesce(is_ok(F.when(acc, F.col("choice")).otherwise(F.col("fallback"))), F.lit(False))
        aggs += [F.avg(ok.cast("double")).alias(f"a{i}"),
                 (F.sum(ok.cast("double") * w) / F.sum(w)).alias(f"w{i}"),
                 F.avg(F.when(off, ok.cast("double"))).alias(f"o{i}"),
                 (1 - F.avg(acc.cast("double"))).alias(f"e{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("threshold"), F.round(F.col(f"a{i}"), 3).alias("merchant_acc"),
                              F.round(F.col(f"w{i}"), 3).alias("row_weighted"),
                              F.round(F.col(f"o{i}"), 3).alias("acc_on_merchants_not_in_list"),
                              F.round(F.col(f"e{i}"), 3).alias("escalated"))
                     for i, (name, _) in enumerate(tags)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def confidence_report(rows: DataFrame, thresholds=K.CONFIDENCE_THRESHOLDS, group=("dataset", "setting")) -> DataFrame:
    """D31 in full: ``confidence_summary`` with the AUROC of right against wrong picks (D28), the confidence
    quantiles of both (D29) and the threshold sweep (D30) as arrays over ``thresholds``, per group."""
    g = list(group)
    picked = rows.filter(F.col("choice") != K.NONE_OPTION)
    auc = ST.auroc(picked, "confidence", F.col("correct"), g).withColumn("auroc", F.round("auroc", 3))
    q = [ST.quantiles(picked.filter(c), "confidence", g).withColumnRenamed("quantiles", name) for c, name in
         ((F.col("correct"), "quantiles_right"), (~F.col("correct"), "quantiles_wrong"))]
    sweep = ST.threshold_sweep(rows, F.col("choice") != K.NONE_OPTION, "confidence", "correct", thresholds, g)
    steps = ["auto_accepted", "precision_of_accepted", "wrong_accepts_of_all_rows", "escalated"]
    # one row per threshold and group
    sweep = sweep.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("threshold", *steps))).alias("_s")).select(
        *g, *[F.col(f"_s.{c}").alias(c) for c in steps])
    out = confidence_summary(rows, g)
    for part in (auc, *q, sweep):
        out = out.join(part, g, "left")
    return out


def cascade_summary(df: DataFrame, policies: dict[str, Column], matched: Column | None, cluster: Column, weight: Column | None = None,
                    compare: list[tuple[str, str]] = (), n_boot: int = K.BOOTSTRAP_N, seed: int = 0) -> DataFrame:
    """One row per policy (``policies``: name -> correctness Column): accuracy, row-weighted accuracy, rows and
    the share of rows the first stage matched; then one row per pair in ``compare``: the difference of the two
    with its paired-bootstrap interval (D19), plain and, with a weight, row-weighted."""
    d = df.select(cluster.alias("cluster"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
                  (matched if matched is not None else F.lit(None).cast("boolean")).alias("m"),
                  *[F.coalesce(ok, F.lit(False)).alias(f"ok{i}") for i, ok in enumerate(policies.values())])
    wide = d.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("m").cast("double")), 3).alias("matched_share"), *[
        c for i in range(len(policies)) for c in (
            F.round(F.avg(F.col(f"ok{i}").cast("double")), 3).alias(f"a{i}"),
            F.round(F.sum(F.col(f"ok{i}").cast("double") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0)), 3).alias(f"w{i}"))])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"a{i}").alias("accuracy"), F.col(f"w{i}").alias("row_weighted"))
                     for i, name in enumerate(policies)])
    out = wide.select(F.explode(rows).alias("r"), "rows", "matched_share").select("r.*", "rows", "matched_share")
    at = {name: f"ok{i}" for i, name in enumerate(policies)}
    for a, b in compare:
        for weights, tag in ((None, ""), ("w", "_row_weighted")) if weight is not None else ((None, ""),):
            diff = ST.paired_bootstrap(d, at[a], at[b], "cluster", weights, n_boot, seed)
            out = out.unionByName(diff.select(F.lit(f"{a}_minus_{b}{tag}").alias("name"), "diff", "lo", "hi",
                                              F.col("n_clusters").cast("long").alias("n_clusters"),
                                              F.col("n_rows").cast("long").alias("rows")), allowMissingColumns=True)
    return out


def routing_differences(df: DataFrame, pairs: list[tuple[str, str]], gold: str, none: Column, cluster: Column,
                        n_boot: int = K.BOOTSTRAP_N, seed: int = 0) -> DataFrame:
    """The paired bootstrap (D19) of policy columns against each other, clustered by merchant or type, and
    the share of rows answered none."""
    right = lambda c: F.coalesce(F.col(c) == F.col(gold), F.lit(False))
    d = df.withColumn("_none", none)
    share = d.agg(F.round(F.avg(F.col("_none").cast("double")), 3).alias("none_share"))
    out = None
    for a, b in pairs:
        row = ST.paired_bootstrap(d, right(a), right(b), cluster, None, n_boot, seed).select(
            F.lit(f"{a}_minus_{b}").alias("comparison"), "diff", "lo", "hi", F.col("n_clusters").cast("long").alias("n_clusters"),
            F.col("n_rows").cast("long").alias("n_rows")).crossJoin(share)                     # one row each
        out = row if out is None else out.unionByName(row)
    return out


def routing_summary(df: DataFrame, policies: list[str], gold: str, by: list[str]) -> DataFrame:
    """Accuracy of each policy column overall and by each column in ``by`` (one
    grouping set per dimension, as a union of partial aggregations)."""
    def agg(d, dim, val):
        return d.agg(*[F.round(F.avg((F.col(p) == F.col(gold)).cast("double")), 3).alias(p) for p in policies],
                     F.count(F.lit(1)).alias("rows")).select(F.lit(dim).alias("dimension"), val, "*")
    out = agg(df, "all", F.lit(None).cast("string").alias("value"))
    for b in by:
        g = df.groupBy(F.col(b).cast("string").alias("value")).agg(
            *[F.round(F.avg((F.col(p) == F.col(gold)).cast("double")), 3).alias(p) for p in policies],
            F.count(F.lit(1)).alias("rows")).select(F.lit(b).alias("dimension"), "value", *policies, "rows")
        out = out.unionByName(g)
    return out


def gate_separation(df: DataFrame, gates: dict[str, Column], off_list: Column, fallback_ok: Column) -> DataFrame:
    """Per gate, share of off-list and on-list rows it sends to the fallback, and
    the fallback's accuracy on the on-list rows it sent."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("sent"))
                                            for k, v in gates.items()])).alias("g"),
                        off_list.alias("off"), fallback_ok.alias("fok"))
    return stacked.groupBy("g.gate").agg(
        F.round(F.avg(F.when(F.col("off"), F.col("g.sent").cast("double"))), 3).alias("off_list_sent"),
        F.round(F.avg(F.when(~F.col("off"), F.col("g.sent").cast("double"))), 3).alias("on_list_sent"),
        F.round(F.avg(F.when(~F.col("off") & F.col("g.sent"), F.col("fok").cast("double"))), 3)
        .alias("fallback_correct_on_on_list_sent"),
        F.count_if(F.col("off")).alias("off_list_rows"), F.count_if(~F.col("off")).alias("on_list_rows"))


def significance_report(comparisons: list[dict], n_boot: int = K.BOOTSTRAP_N, seed: int = 0) -> DataFrame:
    """One row per comparison {name, df, a, b, cluster, weight?}: D19 diff and
    interval plus the D20 leave-one-cluster-out range; a comparison whose frame is None
    is reported as skipped."""
    spark = next((c["df"].sparkSession for c in comparisons if c.get("df") is not None), None)
    out = None
    for c in comparisons:
        if c.get("df") is None:
            if spark is None:
                continue
            row = spark.createDataFrame(
                [(c["name"], None, None, None, None, None, None, None, True)],
                "comparison string, diff double, lo double, hi double, n_clusters bigint, n_rows bigint, "
                "loo_lo double, loo_hi double, skipped boolean")
        else:
            boot = ST.paired_bootstrap(c["df"], c["a"], c["b"], c["cluster"], c.get("weight"), n_boot, seed)
            loo = ST.leave_one_cluster_out(c["df"], c["a"], c["b"], c["cluster"], c.get("weight")).first()
            row = boot.select(F.lit(c["name"]).alias("comparison"), "diff", "lo", "hi",
                              F.col("n_clusters").cast("bigint").alias("n_clusters"),
                              F.col("n_rows").cast("bigint").alias("n_rows"),
                              F.lit(loo["lo"]).cast("double").alias("loo_lo"),
                              F.lit(loo["hi"]).cast("double").alias("loo_hi"), F.lit(False).alias("skipped"))
        out = row if out is None else out.unionByName(row)
    return out
