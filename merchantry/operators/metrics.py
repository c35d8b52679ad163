"""Evaluation metrics as single aggregations.

Predictions and gold are DataFrames keyed by ``txn_id``; every metric is one join and
one ``agg`` (partial aggregation, no driver loop); results are one-row DataFrames so
they compose (union into a leaderboard) without leaving the cluster.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions.labels import category_ok, cluster_key, headline_keep, merchant_ok
from merchantry.functions.text import norm_merchant, relative_error
from merchantry.operators.aggregates import rollup_by_merchant
from merchantry.operators.stats import cluster_bootstrap_ci


def _j(pred: DataFrame, gold: DataFrame, cols: list[str]) -> DataFrame:
    p = pred.select("txn_id", *[F.col(c).alias(f"p_{c}") for c in cols if c in pred.columns])
    g = gold.select("txn_id", *[F.col(c).alias(f"g_{c}") for c in gold.columns if c != "txn_id"])
    return p.join(g, "txn_id")


def accuracy_col(pred: DataFrame, gold: DataFrame, col: str):
    """D10 as a Column pair (numerator avg over rows with a gold value)."""
    j = _j(pred, gold, [col]).filter(F.col(f"g_{col}").isNotNull())
    return j, F.coalesce(F.avg(F.coalesce(F.col(f"p_{col}") == F.col(f"g_{col}"), F.lit(False))
                               .cast("double")), F.lit(0.0))


def accuracy(pred: DataFrame, gold: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """Exact accuracy of ``col``; null gold rows unscored, null prediction wrong,
    0.0 when nothing is scored."""
    j, a = accuracy_col(pred, gold, col)
    return j.agg(a.alias(alias or f"{col}_accuracy"))


def _ok_cols(pred: DataFrame) -> tuple:
    has_cat = "category" in pred.columns
    cat_ok = category_ok(F.col("p_category"), F.col("g_category")) if has_cat else None
    m_ok = merchant_ok(F.col("p_canonical_merchant"), F.col("g_canonical_merchant"), cat_ok)
    return cat_ok, m_ok


def merchant_norm_accuracy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """B7 averaged over rows with a gold merchant."""
    j = _j(pred, gold, ["canonical_merchant", "category"]).filter(
        F.col("g_canonical_merchant").isNotNull())
    _, m_ok = _ok_cols(pred)
    return j.agg(F.coalesce(F.avg(m_ok.cast("double")), F.lit(0.0)).alias("merchant_norm"))


def macro_f1(pred: DataFrame, gold: DataFrame, col: str = "category") -> DataFrame:
    """Unweighted mean of per-label F1 over labels in gold or prediction; a null
    prediction is a miss for the gold label; 0 on zero division."""
    j = _j(pred, gold, [col])
    p, g = F.col(f"p_{col}"), F.col(f"g_{col}")
    hit = F.coalesce(p == g, F.lit(False))
    contrib = F.array(
        F.struct(g.alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"),
                 (~hit).cast("int").alias("fn")),
        F.struct(p.alias("label"), F.lit(0).alias("tp"), (~hit & p.isNotNull()).cast("int").alias("fp"),
                 F.lit(0).alias("fn")))
    per = (j.select(F.explode(contrib).alias("c")).select("c.*").filter(F.col("label").isNotNull())
           .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                 F.sum("fn").alias("fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return per.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias(f"{col}_macro_f1"))


def dedup_ratio(df: DataFrame, merchant: str = "canonical_merchant",
                description: str = "description") -> DataFrame:
    """Distinct predicted merchants (null counts as one value) / distinct raw
    descriptors of the same rows; 0 when there are none."""
    d = (F.countDistinct(merchant) + F.coalesce(F.max(F.col(merchant).isNull().cast("int")), F.lit(0)))
    n = F.countDistinct(description)
    return df.agg(F.when(n == 0, F.lit(0.0)).otherwise(d / n).alias("dedup_ratio"))


def spend_kpi(feed: DataFrame, pred: DataFrame, gold: DataFrame, tol: float = 0.01) -> DataFrame:
    """Per (customer, normalised merchant) spend of gold vs prediction on rows
    whose gold has a merchant; mean absolute error, share of gold buckets within
    ``tol`` (relative) and the count of predicted-only buckets (not scored)."""
    g = gold.filter(F.col("canonical_merchant").isNotNull())
    base = feed.select("txn_id", "customer_id", "amount").join(g.select("txn_id"), "txn_id", "left_semi")
    groll = rollup_by_merchant(base.join(g.select("txn_id", norm_merchant("canonical_merchant")
                                                  .alias("m")), "txn_id"), "m", ordered=False)
    proll = rollup_by_merchant(base.join(pred.select("txn_id", norm_merchant("canonical_merchant")
                                                     .alias("m")), "txn_id"), "m", ordered=False)
    proll = proll.select("customer_id", "m", F.col("total_spend").alias("pred_spend"))
    merged = groll.join(proll, ["customer_id", "m"], "full")
    diff = F.abs(F.col("total_spend") - F.coalesce("pred_spend", F.lit(0.0)))
    scored = F.col("total_spend").isNotNull()
    rel = relative_error(F.col("total_spend"), F.coalesce("pred_spend", F.lit(0.0)))
    return merged.agg(
        F.coalesce(F.avg(F.when(scored, diff)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.avg(F.when(scored, (rel <= tol).cast("double"))), F.lit(0.0)).alias("within_tolerance"),
        F.count_if(~scored).alias("pred_only_buckets"))


def merchant_subsets(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """B7 accuracy on recoverable / abbreviated / truncated rows (overlapping) and per
    origin, in one pass; null where a subset is empty. Long form (subset, accuracy, n)."""
    j = _j(pred, gold, ["canonical_merchant", "category"]).filter(
        F.col("g_canonical_merchant").isNotNull())
    _, m_ok = _ok_cols(pred)
    ab = F.coalesce(F.col("g_noise_abbrev"), F.lit(False))
    tr = F.coalesce(F.col("g_noise_trunc"), F.lit(False))
    tags = F.array(
        F.when(~ab & ~tr, F.lit("recoverable")), F.when(ab, F.lit("abbreviated")),
        F.when(tr, F.lit("truncated")),
        F.when(F.col("g_origin").isNotNull(), F.concat(F.lit("origin:"), F.col("g_origin"))))
    return (j.select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("subset"),
                     m_ok.cast("double").alias("ok"))
            .groupBy("subset").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n")))


def retrieval_recall(df: DataFrame, gold: str = "gold", cands: str = "candidates") -> DataFrame:
    """Share of rows whose normalised gold is in the row's normalised candidates."""
    hit = F.array_contains(F.transform(F.coalesce(F.col(cands), F.array().cast("array<string>")),
                                       lambda c: norm_merchant(c)), norm_merchant(gold))
    return df.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("retrieval_recall"))


def weighted_scores(df: DataFrame, ok: str = "ok", n: str = "n", spend: str = "spend",
                    merchant: str = "canonical_merchant", group: list[str] | None = None) -> DataFrame:
    """Per-descriptor correctness weighted five ways: distinct, by rows, macro by
    merchant (mean of merchant means), by spend, by spend without the largest
    descriptor; null where the weight is zero; per ``group`` if given. Two aggregation levels (merchant, then
    global) carry every partial sum, so there is no join and no driver step."""
    x = F.col(ok).cast("double")
    group = group or []
    per = df.groupBy(*group, merchant).agg(
        F.sum(x).alias("_sx"), F.count(F.lit(1)).alias("_c"),
        F.sum(x * F.col(n)).alias("_sxn"), F.sum(n).alias("_sn"),
        F.sum(x * F.col(spend)).alias("_sxs"), F.sum(spend).alias("_ss"),
        F.max_by(F.struct(F.col(spend).alias("s"), x.alias("x")), F.col(spend)).alias("_top"))
    g = per.groupBy(*group).agg(
        (F.sum("_sx") / F.sum("_c")).alias("distinct"),
        (F.sum("_sxn") / F.nullif(F.sum("_sn"), F.lit(0))).alias("row_weighted"),
        F.avg(F.col("_sx") / F.col("_c")).alias("macro_merchant"),
        F.sum("_sxs").alias("_sxs"), F.sum("_ss").alias("_ss"),
        F.max_by("_top", "_top.s").alias("_top"))
    return g.select(
        *group, "distinct", "row_weighted", "macro_merchant",
        (F.col("_sxs") / F.nullif(F.col("_ss"), F.lit(0.0))).alias("spend_weighted"),
        ((F.col("_sxs") - F.col("_top.x") * F.col("_top.s"))
         / F.nullif(F.col("_ss") - F.col("_top.s"), F.lit(0.0))).alias("spend_weighted_no_top"))


def leaderboard_row(pred: DataFrame, gold: DataFrame, route: str, split: str, view: str
                    ) -> DataFrame:
    """One row of metrics for (route, split, view): category / direction / exact
    merchant accuracy, normalised merchant accuracy and macro-F1 from one joined pass.
    A metric the route cannot produce (no category column) is null."""
    has_cat = "category" in pred.columns and pred.schema["category"].dataType.simpleString() != "void"
    j = _j(pred, gold, ["canonical_merchant", "category", "direction"])
    cat_ok, m_ok = _ok_cols(pred)
    gm = F.col("g_canonical_merchant").isNotNull()
    has_m = F.count("p_canonical_merchant") > 0   # a route that never names a merchant gets null
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.when(has_m, F.avg(F.when(gm, m_ok.cast("double")))).alias("merchant_norm"),
        F.when(has_m, F.avg(F.when(gm, F.coalesce(F.col("p_canonical_merchant") == F.col("g_canonical_merchant"),
                                                  F.lit(False)).cast("double")))).alias("merchant_exact"),
        F.avg(F.coalesce(F.col("p_direction") == F.col("g_direction"), F.lit(False)).cast("double"))
        .alias("direction_accuracy"),
    ]
    # a route that predicts no category at all gets null, not 0
    aggs.append((F.when(F.count("p_category") > 0, F.avg(cat_ok.cast("double"))) if has_cat
                 else F.lit(None).cast("double")).alias("category_accuracy"))
    return j.agg(*aggs).select(F.lit(route).alias("route"), F.lit(split).alias("split"),
                               F.lit(view).alias("view"), "*")


SUBSETS = ("recoverable", "abbreviated", "truncated", "source", "local")


def leaderboard_scores(pred: DataFrame, gold: DataFrame, feed: DataFrame, route: str, split: str, view: str,
                       n_boot: int | None = None, seed: int = 0) -> DataFrame:
    """The full leaderboard row of (route, split, view). The headline merchant scores (exact,
    normalised, dedup ratios, interval) leave out local rows whose name was abbreviated (B30) on the model
    view; subsets, no-match, recall and escalation are over all rows with a gold merchant. A metric the
    route cannot produce is null. Everything but macro-F1 and, with ``n_boot``, the half-widths (D18) is one
    aggregate over one joined pass."""
    cols = set(pred.columns)
    p = pred.withColumns({c: F.lit(None).cast("string") for c in ("category", "direction") if c not in cols})
    extra = [c for c in ("no_match", "none", "escalated", "candidates", "choice_confidence", "choice_input_tokens") if c in cols]
    j = _j(p, gold, ["canonical_merchant", "category", "direction"] + extra).join(feed.select("txn_id", "description"), "txn_id")
    cat_ok, m_ok = _ok_cols(p)
    named = F.col("g_canonical_merchant").isNotNull()
    keep = F.coalesce(headline_keep(F.col("g_origin"), F.col("g_noise_abbrev")), F.lit(True)) if view == "model" else F.lit(True)
    j = j.withColumns({"head": named & keep, "ok": m_ok, "cat_ok": cat_ok})
    head, pm, gm = F.col("head"), F.col("p_canonical_merchant"), F.col("g_canonical_merchant")
    abbrev, trunc = (F.coalesce(F.col(f"g_{c}"), F.lit(False)) for c in ("noise_abbrev", "noise_trunc"))
    subset = dict(zip(SUBSETS, (~abbrev & ~trunc, abbrev, trunc, F.col("g_origin") == "source", F.col("g_origin") == "local")))
    names = (F.count(pm) > 0) & (F.count_if(head) > 0)       # a route that never names a merchant gets null
    if_named = lambda c: F.when(names, c)
    share = lambda rows, flag: F.avg(F.when(rows, flag.cast("double")))
    texts = F.countDistinct(F.when(head, F.col("description")))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(head).alias("merchant_rows"),
        F.count_if(named & ~F.col("head")).alias("headline_excluded"),
        F.when(F.count("p_category") > 0, F.avg(F.col("cat_ok").cast("double"))).alias("category_accuracy"),
        if_named(share(head, F.coalesce(pm == gm, F.lit(False)))).alias("merchant_exact"),
        if_named(share(head, F.col("ok"))).alias("merchant_norm"),
        if_named((F.countDistinct(F.when(head, pm)) + F.max((head & pm.isNull()).cast("int"))) / texts).alias("dedup_ratio"),
        if_named(F.countDistinct(F.when(head, gm)) / texts).alias("gold_dedup_ratio"),
        *[if_named(share(named & rows, F.col("ok"))).alias(f"subset_{k}") for k, rows in subset.items()],
        F.avg(F.coalesce(F.col("p_direction") == F.col("g_direction"), F.lit(False)).cast("double")).alias("direction_accuracy")]
    if view == "model":
        flag = "no_match" if "no_match" in cols else "none"
        hit = F.array_contains(F.transform("p_candidates", lambda c: norm_merchant(c)), norm_merchant(gm)) if "candidates" in cols else None
        aggs += [F.round(share(named, F.col(f"p_{flag}")), 4).alias("no_match_rate")] * (flag in cols)
        aggs += [F.round(share(named, F.coalesce(hit, F.lit(False))), 4).alias("retrieval_recall")] if "candidates" in cols else []
        aggs += [F.round(share(named, F.col("p_escalated")), 3).alias("escalated")] * ("escalated" in cols)
        aggs += [F.avg("p_choice_confidence").alias("mean_confidence")] * ("choice_confidence" in cols)
        aggs += [F.sum("p_choice_input_tokens").alias("input_tokens")] * ("choice_input_tokens" in cols)
    key = [F.lit(route).alias("route"), F.lit(split).alias("split"), F.lit(view).alias("view")]
    f1 = macro_f1(p.withColumn("category", F.coalesce("category", F.lit(""))), gold)
    row = j.agg(*aggs).crossJoin(f1).withColumnRenamed("category_macro_f1", "macro_f1")      # one row each
    row = row.withColumn("macro_f1", F.when(F.col("category_accuracy").isNotNull(), F.col("macro_f1")))
    if n_boot:
        cluster = cluster_key(gm, F.col("g_txn_type") if "txn_type" in gold.columns else F.lit(None).cast("string"))
        wide = cluster_bootstrap_ci(j, F.col("cat_ok"), F.col("ok"), head, cluster, n_boot, seed).select("category")
        names_only = cluster_bootstrap_ci(j.filter("head"), F.col("cat_ok"), F.col("ok"), head, cluster, n_boot, seed)
        row = row.crossJoin(wide.select(F.col("category").alias("_c"))).crossJoin(
            names_only.select(F.col("merchant_norm").alias("_m"))).withColumns(
            {"category_ci": F.when(F.col("category_accuracy").isNotNull(), F.col("_c")),
             "merchant_norm_ci": F.when(F.col("merchant_norm").isNotNull(), F.col("_m"))}).drop("_c", "_m")
    return row.select(*key, "*")
