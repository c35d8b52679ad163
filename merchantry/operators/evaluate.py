"""Evaluate a set of routes over splits and views into one leaderboard.

Per split: views are built once (F7/F8); every route is fitted on the split's train
rows and predicts the model view once. That prediction is written (it feeds several
metrics) and reused for the ideal-cache view through the cache (C13). Metric rows are
one-row aggregates stacked with ``unionByName(allowMissingColumns=True)`` and folded per
(route, split, view); nothing is joined on a constant key and only the final rows
reach the driver.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.operators import metrics as M
from merchantry.operators.routes import Route
from merchantry.operators.views import Views, ideal_preds


def _key(route: str, split: str, view: str):
    return [F.lit(route).alias("route"), F.lit(split).alias("split"), F.lit(view).alias("view")]


def evaluate(views: dict[str, Views], routes: dict[str, Callable[[], Route]],
             write: Callable[[DataFrame, str], DataFrame] | None = None,
             preds: dict | None = None, n_boot: int | None = None) -> DataFrame:
    """Leaderboard over ``views`` (split -> Views) and ``routes`` (name -> route factory).
    ``write(df, name)`` persists a prediction frame (e.g. ``session.materialize``);
    ``preds`` may hold precomputed model-view predictions keyed by (route, split). With ``n_boot``, half-widths
    of the cluster bootstrap are added (they run jobs while the plan is built)."""
    parts = []
    for split, v in views.items():
        for name, make in routes.items():
            mp = (preds or {}).get((name, split))
            if mp is None:
                mp = make().fit(v.train_feed, v.train_gold).transform(v.model_feed)
                if write is not None:
                    mp = write(mp, f"preds_{name}_{split}")
            parts.append(M.leaderboard_scores(mp, v.model_gold, v.model_feed, name, split, "model", n_boot))
            ip = ideal_preds(mp, v.cache).join(v.ideal_feed.select("txn_id", "amount"), "txn_id").withColumn(
                "direction", F.when(F.col("amount") > 0, "incoming").otherwise("outgoing"))
            parts.append(M.leaderboard_scores(ip, v.ideal_gold, v.ideal_feed, name, split, "ideal_cache", n_boot))
            named = mp.agg((F.count("canonical_merchant") > 0).alias("_named"))
            kpi = M.spend_kpi(v.ideal_feed, ip, v.ideal_gold).crossJoin(named)               # one row each
            parts.append(kpi.select(
                *_key(name, split, "ideal_cache"), F.when(F.col("_named"), F.col("mae")).alias("kpi_mae"),
                F.when(F.col("_named"), F.col("within_tolerance")).alias("kpi_within_1pct")))
            parts.append(v.cache.agg(F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"))
                         .select(*_key(name, split, "ideal_cache"), "cache_hit_rate"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    metrics = [c for c in out.columns if c not in ("route", "split", "view")]
    return out.groupBy("route", "split", "view").agg(*[F.first(c, ignorenulls=True).alias(c) for c in metrics])


def best_route(leaderboard: DataFrame, metric: str = "merchant_norm") -> DataFrame:
    """Per split, the route with the highest model-view ``metric`` among those that have it."""
    lb = leaderboard.filter((F.col("view") == "model") & F.col(metric).isNotNull())
    return lb.groupBy("split").agg(F.max_by("route", F.struct(metric, "route")).alias("best_route"),
                                   F.max(metric).alias(metric))
