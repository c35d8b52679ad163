"""Full reports against plain Python."""
import pytest
from pyspark.sql import functions as F

from merchantry.operators import metrics as M
from merchantry.operators import reports as RP

GOLD = "txn_id string, canonical_merchant string, category string, direction string, txn_type string, origin string, noise_abbrev boolean, noise_trunc boolean"
PRED = "txn_id string, canonical_merchant string, category string, direction string, no_match boolean, candidates array<string>"


@pytest.fixture(scope="module")
def rows(spark):
    gold = spark.createDataFrame([
        ("1", "Alpha", "Food", "outgoing", None, "source", False, False), ("2", "Beta", "Food", "outgoing", None, "source", False, True),
        ("3", "Gamma", "Travel", "outgoing", None, "local", True, False), ("4", "Delta", "Travel", "outgoing", None, "local", None, None),
        ("5", None, "Income", "incoming", "Wage", None, False, False)], GOLD)
    pred = spark.createDataFrame([
        ("1", "ALPHA!", "Food", "outgoing", False, ["Alpha"]), ("2", None, "Travel", "outgoing", True, ["Alpha", "Beta"]),
        ("3", "Gamma", None, "outgoing", False, []), ("4", "Delta", "Travel", "incoming", False, None), ("5", "Wage", "Income", "incoming", True, [])], PRED)
    feed = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "a"), ("5", "e")], "txn_id string, description string")
    return pred, gold, feed


def test_leaderboard_scores(rows):
    pred, gold, feed = rows
    r = M.leaderboard_scores(pred, gold, feed, "x", "random", "model", n_boot=50).first()
    assert (r["n"], r["merchant_rows"], r["headline_excluded"]) == (5, 3, 1)         # the abbreviated local row is out
    assert r["merchant_norm"] == pytest.approx(2 / 3) and r["merchant_exact"] == pytest.approx(1 / 3)
    assert r["category_accuracy"] == pytest.approx(3 / 5)
    # labels Food, Travel, Income and '' for the missing one: 2/3, 2/4, 1 and 0
    assert r["macro_f1"] == pytest.approx((2 / 3 + 2 / 4 + 1 + 0) / 4)
    assert r["dedup_ratio"] == pytest.approx(3 / 2) and r["gold_dedup_ratio"] == pytest.approx(3 / 2)
    assert r["subset_abbreviated"] == 1.0 and r["subset_truncated"] == 0.0 and r["subset_local"] == 1.0 and r["subset_source"] == 0.5
    assert r["no_match_rate"] == 0.25 and r["retrieval_recall"] == 0.5               # over the four rows with a merchant
    assert r["merchant_norm_ci"] > 0 and r["category_ci"] > 0
    ideal = M.leaderboard_scores(pred, gold, feed, "x", "random", "ideal_cache").first()
    assert (ideal["merchant_rows"], ideal["headline_excluded"]) == (4, 0) and "no_match_rate" not in ideal.__fields__


def test_leaderboard_scores_of_a_route_without_names(rows):
    pred, gold, feed = rows
    none = pred.withColumn("canonical_merchant", F.lit(None).cast("string")).drop("no_match", "candidates")
    r = M.leaderboard_scores(none, gold, feed, "x", "random", "model").first()
    assert r["merchant_norm"] is None and r["dedup_ratio"] is None and r["subset_local"] is None and r["category_accuracy"] is not None
    r = M.leaderboard_scores(pred.drop("category"), gold, feed, "x", "random", "model").first()
    assert r["category_accuracy"] is None and r["macro_f1"] is None and r["merchant_norm"] is not None


def test_cascade_summary(spark):
    df = spark.createDataFrame([("A", True, False, True, 3), ("B", False, True, False, 1), ("C", True, True, True, 1), ("C", False, None, False, 5)],
                               "c string, a boolean, b boolean, m boolean, n int")
    out = {r["name"]: r for r in RP.cascade_summary(df, {"a": F.col("a"), "b": F.col("b")}, F.col("m"), F.col("c"), F.col("n"),
                                                    [("a", "b")], n_boot=200).collect()}
    assert out["a"]["accuracy"] == 0.5 and out["a"]["row_weighted"] == 0.4 and out["b"]["row_weighted"] == 0.2
    assert out["a"]["matched_share"] == 0.5 and out["a"]["rows"] == 4
    assert out["a_minus_b"]["diff"] == 0.0 and out["a_minus_b"]["n_clusters"] == 3
    assert out["a_minus_b_row_weighted"]["diff"] == pytest.approx(0.2) and out["a_minus_b_row_weighted"]["lo"] <= 0.2


def test_routing_differences(spark):
    df = spark.createDataFrame([("x", "x", "y", "k1", True), ("y", "x", "y", "k2", False), ("z", "z", "z", "k3", False)],
                               "gold string, p string, q string, c string, none boolean")
    r = RP.routing_differences(df, [("p", "q")], "gold", F.col("none"), F.col("c"), n_boot=50).first()
    assert r["comparison"] == "p_minus_q" and r["diff"] == 0.0 and r["n_rows"] == 3 and r["none_share"] == 0.333
