"""Significance and confidence statistics.

Rows are first reduced to per-cluster sums (D17, partial aggregation); resampling then
works on the k cluster rows only. A bootstrap replicate draws k cluster indices with
replacement from a hash of (seed, replicate, draw) — an exact multinomial resample,
reproducible on any cluster layout and in SQL — and the percentiles of the replicate
ratios are Spark's exact ``percentile`` (linear interpolation). Above MULTINOMIAL_UP_TO clusters there
is no table of draws: every cluster gets a Poisson(1) weight per replicate, its number of draws in the
limit of many clusters, and one aggregate adds the replicates up.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.hashing import hash52, hkey


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cluster_sums(df: DataFrame, a_ok, b_ok, cluster, weight=None) -> DataFrame:
    """Per cluster Σ (a-b)·w, Σ w and the row count."""
    w = F.lit(1.0) if weight is None else _c(weight).cast("double")
    d = _c(a_ok).cast("double") - _c(b_ok).cast("double")
    return (df.groupBy(_c(cluster).alias("cluster"))
            .agg(F.sum(d * w).alias("num"), F.sum(w).alias("den"), F.count(F.lit(1)).alias("rows")))


CLUSTER_BUCKETS = 64
MULTINOMIAL_UP_TO = 10_000


def number_clusters(sums: DataFrame, buckets: int = CLUSTER_BUCKETS) -> DataFrame:
    """A dense 0..k-1 index over the clusters, deterministic and layout-free: clusters
    are spread over hash buckets, ranked by name inside their bucket, and offset by the
    sizes of the lower buckets (a running sum over ``buckets`` rows), so no task orders
    all k clusters."""
    b = F.pmod(hash52(hkey("bucket", F.col("cluster"))), F.lit(buckets))
    d = sums.withColumn("_bk", b)
    d = d.withColumn("_within", F.row_number().over(Window.partitionBy("_bk").orderBy("cluster")) - 1)
    sizes = d.groupBy("_bk").agg(F.count(F.lit(1)).alias("_sz"))
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (d.join(F.broadcast(sizes.select("_bk", "_off")), "_bk")
            .withColumn("idx", F.col("_off") + F.col("_within")).drop("_bk", "_within", "_off"))


def draw_counts(spark, k: int, n_boot: int, seed: int) -> DataFrame:
    """(b, idx, cnt): how often cluster ``idx`` is drawn in replicate ``b`` when k
    indices are drawn uniformly with replacement."""
    draws = spark.range(0, n_boot * k).select(
        (F.col("id") / k).cast("bigint").alias("b"),
        F.pmod(hash52(hkey(str(seed), "boot", F.col("id"))), F.lit(k)).alias("idx"))
    return draws.groupBy("b", "idx").agg(F.count(F.lit(1)).alias("cnt"))


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) number from a uniform one in [0, 1): how many steps of the distribution lie at or below it."""
    out, share, below = F.lit(0), math.exp(-1), 0.0
    for n in range(1, 19):
        below += share
        share /= n
        out = out + (u >= below).cast("int")
    return out


def replicates(sums: DataFrame, k: int, n_boot: int, seed: int, multinomial_up_to: int = MULTINOMIAL_UP_TO) -> DataFrame:
    """The rows of ``sums`` (one per ``cluster``) per replicate ``b`` with their number of draws ``cnt``."""
    if k <= multinomial_up_to:
        return draw_counts(sums.sparkSession, k, n_boot, seed).join(number_clusters(sums), "idx")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "b", "cluster"), 11) / F.lit(2.0 ** 53)
    return (sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
            .withColumn("cnt", poisson_weight(u)).filter(F.col("cnt") > 0))


def _replicate_ratios(sums: DataFrame, k: int, n_boot: int, seed: int, pairs: dict,
                      multinomial_up_to: int = MULTINOMIAL_UP_TO) -> DataFrame:
    """Per replicate b, for each name -> (num_col, den_col): Σ cnt·num / Σ cnt·den (0 on 0)."""
    aggs = []
    for name, (num, den) in pairs.items():
        aggs += [F.sum(F.col("cnt") * F.col(num)).alias(f"_{name}_n"),
                 F.sum(F.col("cnt") * F.col(den)).alias(f"_{name}_d")]
    rep = replicates(sums, k, n_boot, seed, multinomial_up_to).groupBy("b").agg(*aggs)
    return rep.select("b", *[F.when(F.col(f"_{n}_d") != 0, F.col(f"_{n}_n") / F.col(f"_{n}_d"))
                             .otherwise(0.0).alias(n) for n in pairs])


def paired_bootstrap(df: DataFrame, a_ok, b_ok, cluster, weight=None, n_boot: int = K.BOOTSTRAP_N,
                     seed: int = 0, multinomial_up_to: int = MULTINOMIAL_UP_TO) -> DataFrame:
    """diff = Σ(a-b)w / Σw with a 95% cluster-bootstrap interval (the same resample
    for both routes). One row: diff, lo, hi, n_clusters, n_rows."""
    sums = cluster_sums(df, a_ok, b_ok, cluster, weight).cache()
    k = sums.count()
    if k == 0:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0, 0)],
                                               "diff double, lo double, hi double, n_clusters bigint, n_rows bigint")
    rep = _replicate_ratios(sums, k, n_boot, seed, {"r": ("num", "den")}, multinomial_up_to)
    ci = rep.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    tot = sums.agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("diff"),
                   F.count(F.lit(1)).alias("n_clusters"), F.sum("rows").alias("n_rows"))
    qrow = ci.first()["q"]
    return tot.select(F.coalesce("diff", F.lit(0.0)).alias("diff"), F.lit(qrow[0]).alias("lo"),
                      F.lit(qrow[1]).alias("hi"), "n_clusters", "n_rows")


def cluster_bootstrap_ci(joined: DataFrame, cat_ok, m_ok, has_merchant, cluster,
                         n_boot: int = K.BOOTSTRAP_N, seed: int = 0,
                         multinomial_up_to: int = MULTINOMIAL_UP_TO) -> DataFrame:
    """95% half-widths (3 dp) of category and normalised-merchant accuracy,
    resampling whole clusters."""
    sums = (joined.groupBy(_c(cluster).alias("cluster"))
            .agg(F.sum(_c(cat_ok).cast("double")).alias("cat_sum"),
                 F.count(F.lit(1)).cast("double").alias("n_all"),
                 F.sum((_c(m_ok) & _c(has_merchant)).cast("double")).alias("m_sum"),
                 F.sum(_c(has_merchant).cast("double")).alias("n_m"))).cache()
    k = sums.count()
    rep = (replicates(sums, k, n_boot, seed, multinomial_up_to).groupBy("b").agg(
        (F.sum(F.col("cnt") * F.col("cat_sum")) / F.greatest(F.lit(1.0), F.sum(F.col("cnt") * F.col("n_all"))))
        .alias("cat"),
        (F.sum(F.col("cnt") * F.col("m_sum")) / F.greatest(F.lit(1.0), F.sum(F.col("cnt") * F.col("n_m"))))
        .alias("m")))
    qa = F.array(F.lit(0.025), F.lit(0.975))
    return rep.agg(F.percentile("cat", qa).alias("qc"), F.percentile("m", qa).alias("qm")).select(
        F.round((F.col("qc")[1] - F.col("qc")[0]) / 2, 3).alias("category"),
        F.round((F.col("qm")[1] - F.col("qm")[0]) / 2, 3).alias("merchant_norm"))


def leave_one_cluster_out(df: DataFrame, a_ok, b_ok, cluster, weight=None) -> DataFrame:
    """(min, max) over clusters of the diff recomputed without that cluster;
    clusters whose removal leaves no weight are skipped."""
    sums = cluster_sums(df, a_ok, b_ok, cluster, weight).cache()
    tot = sums.agg(F.sum("num").alias("N"), F.sum("den").alias("D")).first()
    n_tot, d_tot = (tot["N"] or 0.0), (tot["D"] or 0.0)
    rest = F.lit(d_tot) - F.col("den")
    v = F.when(rest != 0, (F.lit(n_tot) - F.col("num")) / rest)
    return sums.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def _log_gamma(z: Column) -> Column:
    """ln Γ(z) for z >= 1: Stirling's series at z + 9."""
    x = z.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return series - sum((F.log(z + i) for i in range(1, 9)), F.log(z.cast("double")))


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact p of ``only_a`` against ``only_b`` under equal odds (1.0 when they are equal). The terms
    C(n, i) / 2^n fall from i = m, the smaller count, down; those that a double can still add to the
    first lie within a few square roots of n."""
    n, m = only_a + only_b, F.least(only_a, only_b)
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(m, F.ceil(6 * F.sqrt(n)).cast("bigint") + 64))
    first = F.exp(_log_gamma(n + 1) - _log_gamma(m + 1) - _log_gamma(n - m + 1) - n * F.log(F.lit(2.0)))
    tail = first * F.aggregate(
        steps, F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: F.struct((acc["t"] * (m - j) / (n - m + j + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"])
    return F.when(only_a == only_b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(df: DataFrame, a_ok, b_ok) -> DataFrame:
    """Exact two-sided McNemar: only-A, only-B and p (1.0 when they are equal)."""
    a, b = _c(a_ok), _c(b_ok)
    c = df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return c.select("only_a", "only_b", mcnemar_p(F.col("only_a"), F.col("only_b")).alias("p_value"))


def binomial_halfwidth(p, n) -> Column:
    """1.96 * sqrt(p (1 - p) / n)."""
    return F.lit(1.96) * F.sqrt(_c(p) * (1 - _c(p)) / _c(n))


def invalid_answers(df: DataFrame, col: str, allowed) -> DataFrame:
    """Predictions outside the label set."""
    return df.agg(F.count_if(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))).alias("invalid"))


def auroc(df: DataFrame, score: str, positive, group: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """P(score of a positive > score of a negative) + 1/2 P(tie), per group; null
    when a class is empty. Rows collapse to one row per distinct score; the count of
    negatives below each score is then (negatives in lower score buckets) + (negatives
    below it inside its bucket). Buckets come from approximate quantiles, so no task
    orders more than one bucket's distinct scores; the result is exact whatever the
    bucket edges are."""
    g = list(group) if group else ["_all"]
    if not group:
        df = df.withColumn("_all", F.lit(0))
    per = (df.groupBy(*g, F.col(score).alias("_s"))
           .agg(F.count_if(_c(positive)).alias("_p"), F.count_if(~_c(positive)).alias("_n")))
    qs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = per.groupBy(*g).agg(F.percentile_approx("_s", qs, 10000).alias("_edges"))
    per = per.join(edges, g, "left")
    per = per.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_s")))).drop("_edges")
    btot = per.groupBy(*g, "_b").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    btot = btot.withColumn("_lower", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    ws = Window.partitionBy(*g, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.join(btot, g + ["_b"])
           .withColumn("_below", F.col("_lower") + F.coalesce(F.sum("_n").over(ws), F.lit(0))))
    agg = per.groupBy(*g).agg(F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_n"))).alias("_num"),
                              F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    return agg.select(*(group or []), F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                             F.col("_num") / (F.col("_P") * F.col("_N"))).alias("auroc"))


def quantiles(df: DataFrame, col: str, group: list[str] | None = None, qs=K.QUANTILES, buckets: int = 64) -> DataFrame:
    """Linear-interpolation quantiles of ``col`` (3 dp) per group; null for a group without values. Rows
    collapse to one per distinct value; bucket counts (edges as in ``auroc``) tell in which bucket
    a wanted rank lies, and only those buckets are ordered, so no task holds a group."""
    keys = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("_all"))
    d = df.select(keys.alias("_g"), F.col(col).cast("double").alias("_s"))
    per = d.filter(F.col("_s").isNotNull()).groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_c"))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = per.groupBy("_g").agg(F.percentile_approx("_s", cuts, 10000).alias("_edges"))
    per = per.join(edges, "_g").withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_s")))).drop("_edges")
    # one row per group and bucket from here on
    of_group = Window.partitionBy("_g")
    tot = per.groupBy("_g", "_b").agg(F.sum("_c").alias("_bn"))
    tot = (tot.withColumn("_n", F.sum("_bn").over(of_group))
           .withColumn("_lower", F.sum("_bn").over(of_group.orderBy("_b")) - F.col("_bn")))
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array(*[f(p).cast("bigint") for p in place for f in (F.floor, F.ceil)])
    tot = tot.withColumn("_want", F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_lower")) & (
        r < F.col("_lower") + F.col("_bn")))).filter(F.size("_want") > 0)
    inside = Window.partitionBy("_g", "_b").orderBy("_s")
    hit = per.join(tot, ["_g", "_b"]).withColumn("_end", F.col("_lower") + F.sum("_c").over(inside))
    found = hit.select("_g", "_n", "_s", F.explode(F.filter("_want", lambda r: (r < F.col("_end")) & (
        r >= F.col("_end") - F.col("_c")))).alias("_r"))
    at = found.groupBy("_g", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_s"))).alias("_at"))

    def value(p):
        lo, hi = F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")
        mixed = (hi - p) * F.element_at("_at", lo) + (p - lo) * F.element_at("_at", hi)
        return F.round(F.when(lo == hi, F.element_at("_at", lo)).otherwise(mixed), 3)
    out = at.select("_g", F.array(*[value(p) for p in place]).alias("quantiles"))
    return d.select("_g").distinct().join(out, "_g", "left").select(*[F.col(f"_g.{c}").alias(c) for c in group or []], "quantiles")


def threshold_sweep(df: DataFrame, accepted_base, conf: str, correct: str, thresholds=K.CONFIDENCE_THRESHOLDS,
                    group: list[str] | None = None) -> DataFrame:
    """Per threshold t: share auto-accepted (``accepted_base`` and conf >= t),
    precision of the accepted, wrong accepts over all rows, escalated share.
    The thresholds are a fixed list, so each becomes conditional sums in ONE pass;
    the result is stacked to long form (no join)."""
    g = group or []
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, t in enumerate(thresholds):
        acc = F.coalesce(_c(accepted_base), F.lit(False)) & (F.col(conf) >= t)
        aggs += [F.count_if(acc).alias(f"_a{i}"), F.count_if(acc & F.col(correct)).alias(f"_r{i}")]
    wide = df.groupBy(*g).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_a{i}").alias("a"),
                              F.col(f"_r{i}").alias("r")) for i, t in enumerate(thresholds)])
    long = wide.select(*g, "_rows", F.explode(rows).alias("x"))
    return long.select(
        *g, "x.threshold",
        F.round(F.col("x.a") / F.col("_rows"), 3).alias("auto_accepted"),
        F.when(F.col("x.a") > 0, F.round(F.col("x.r") / F.col("x.a"), 3)).alias("precision_of_accepted"),
        F.round((F.col("x.a") - F.col("x.r")) / F.col("_rows"), 3).alias("wrong_accepts_of_all_rows"),
        F.round(1 - F.col("x.a") / F.col("_rows"), 3).alias("escalated"))
