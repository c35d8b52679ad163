"""View invariants on a toy feed: 200 rows, 40 repeating descriptors, one-offs, one
conflicting descriptor and merchant-less rows."""
import pytest
from pyspark.sql import functions as F

from merchantry.operators import metrics as M
from merchantry.operators.splits import split_random
from merchantry.operators.views import build_views


def _toy(spark):
    rows_f, rows_g = [], []
    for i in range(200):
        tid, k = f"T{i:08d}", i % 40
        if i % 50 == 7:
            d, m, t = "SHARED DESC", ("Alpha" if i < 100 else "Beta"), None
        elif i >= 120 and i % 2 == 0:
            d, m, t = f"SHOP {k} STORE {i}", f"Shop {k}", None
        elif k < 5:
            d, m, t = f"SALARY {k}", None, "Salary"
        else:
            d, m, t = f"SHOP {k}", f"Shop {k}", None
        rows_f.append((tid, d, -1.0, f"C{i % 7}"))
        rows_g.append((tid, f"C{k % 3}", m, t, "outgoing", None if m is None else "source", False, False))
    feed = spark.createDataFrame(rows_f, "txn_id string, description string, amount double, customer_id string")
    gold = spark.createDataFrame(rows_g, "txn_id string, category string, canonical_merchant string, txn_type string, "
                                         "direction string, origin string, noise_abbrev boolean, noise_trunc boolean")
    return feed, gold


def test_view_invariants(spark):
    feed, gold = _toy(spark)
    mem = split_random(feed, seed=42).cache()
    v = build_views(feed, gold, mem, cap=1000)
    train_desc = {r[0] for r in v.train_feed.select("description").collect()}
    ef = {r["txn_id"]: r["description"] for r in v.eval_feed.collect()}
    model = {r["txn_id"]: r["description"] for r in v.model_feed.collect()}
    st = v.stats.first()
    # model view: misses only, conflicts removed, one row per descriptor (smallest txn_id)
    assert not set(model.values()) & train_desc
    assert "SHARED DESC" not in set(model.values())
    assert len(set(model.values())) == len(model)
    for tid, d in model.items():
        assert tid == min(t for t, dd in ef.items() if dd == d)
    assert st["removed_verbatim"] == sum(d in train_desc for d in ef.values()) > 0
    assert st["n_eval"] == len(ef)
    # ideal cache: hits take the first non-conflicting train row of their descriptor
    train = sorted((r["txn_id"], r["description"], r["canonical_merchant"], r["category"])
                   for r in v.train_feed.join(v.train_gold, "txn_id").collect())
    cache = v.cache.collect()
    hits = [r for r in cache if r["cache_hit"]]
    assert hits and st["cache_hit_rate"] == round(len(hits) / len(ef), 4)
    for r in hits:
        first = next(t for t in train if t[1] == ef[r["txn_id"]])
        assert (r["rep_txn_id"], r["cache_merchant"], r["cache_category"]) == (first[0], first[2], first[3])
    assert {r["rep_txn_id"] for r in cache if not r["cache_hit"]} <= set(model)
    assert all(ef[r["txn_id"]] != "SHARED DESC" for r in cache)


def test_capped_view_is_deterministic(spark):
    feed, gold = _toy(spark)
    mem = split_random(feed, seed=42).cache()
    a = [r[0] for r in build_views(feed, gold, mem, cap=3).model_feed.orderBy("txn_id").collect()]
    b = [r[0] for r in build_views(feed, gold, mem.repartition(5), cap=3).model_feed.orderBy("txn_id").collect()]
    assert a == b and len(a) == 3


def test_weighted_scores_spend(spark):
    df = spark.createDataFrame([("Amazon", True, 1, 10.0), ("Amazon2", True, 1, 5.0), ("Lidl", False, 1, 100.0)],
                               "canonical_merchant string, ok boolean, n int, spend double")
    r = M.weighted_scores(df).first()
    assert round(r["spend_weighted"], 3) == round(15.0 / 115.0, 3)
    df2 = spark.createDataFrame([("A", True, 1, 10.0), ("B", False, 1, 80.0), ("C", True, 1, 10.0)],
                                "canonical_merchant string, ok boolean, n int, spend double")
    r2 = M.weighted_scores(df2).first()
    assert r2["spend_weighted"] == pytest.approx(0.2) and r2["spend_weighted_no_top"] == pytest.approx(1.0)


def test_cascade_sweep_golden(spark):
    from merchantry.functions.labels import merchant_ok
    from merchantry.operators.reports import cascade_sweep
    df = spark.createDataFrame([("A", 0.9, "x", "A"), ("B", 0.6, "B", "B"), ("none_of_these", 0.99, "C", "C")],
                               "choice string, confidence double, fallback string, gold string")
    rows = {r["threshold"]: r for r in cascade_sweep(df, lambda p: merchant_ok(p, F.col("gold")),
                                                     thresholds=[0.5, 0.95]).collect()}
    assert rows["0.5"]["escalated"] == pytest.approx(0.333) and rows["0.5"]["merchant_acc"] == 1.0
    assert rows["0.95"]["escalated"] == 1.0 and rows["0.95"]["merchant_acc"] == pytest.approx(0.667)


def test_evaluate_leaderboard(spark):
    from merchantry.operators.evaluate import best_route, evaluate
    from merchantry.operators.routes import CleanerRoute
    feed, gold = _toy(spark)
    mem = split_random(feed, seed=42).cache()
    v = build_views(feed, gold, mem, cap=1000)
    lb = {(r["route"], r["view"]): r for r in evaluate({"random": v}, {"cleaner": CleanerRoute}).collect()}
    assert set(lb) == {("cleaner", "model"), ("cleaner", "ideal_cache")}
    assert lb[("cleaner", "model")]["category_accuracy"] is None
    assert lb[("cleaner", "ideal_cache")]["cache_hit_rate"] > 0
    assert lb[("cleaner", "ideal_cache")]["kpi_within_1pct"] is not None
    assert best_route(evaluate({"random": v}, {"cleaner": CleanerRoute})).first()["best_route"] == "cleaner"
