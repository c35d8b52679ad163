import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from merchantry.sources import contracts as C
from merchantry.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="merchantry-test-", dir="/tmp")


def test_statement_csv_and_spend(spark):
    d = _tmp()
    with open(os.path.join(d, "s.csv"), "w") as f:
        f.write(",".join(IO.STATEMENT_COLUMNS) + "\n")
        f.write("01/02/2016,DEB,TESCO STORES,15.0,,100.0\n")
        f.write("02/02/2016,DD,NETFLIX,,,\n")
        f.write("03/02/2016,CR,SALARY,,2000.0,2100.0\n")
    st = IO.read_statement_csv(spark, d)
    from merchantry.operators.aggregates import spend_by_descriptor
    got = {r["description"]: (r["spend"], r["n"], r["n_null_debit"]) for r in spend_by_descriptor(st).collect()}
    assert got == {"TESCO STORES": (15.0, 1, 0), "NETFLIX": (0.0, 1, 1)}
    assert str(st.filter(F.col("type") == "DEB").first()["date"]) == "2016-02-01"


def test_aliases_csv(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('canonical_merchant,aliases\nTesco,"Tesco Stores|TESCO EXPRESS"\nAldi,\n')
    got = {r[0]: r[1] for r in IO.read_aliases_csv(spark, d).collect()}
    assert got == {"Tesco": ["Tesco Stores", "TESCO EXPRESS"], "Aldi": []}


def test_chat_export(spark):
    feed = spark.createDataFrame([(f"T{i}", f"SHOP {i}") for i in range(30)], "txn_id string, description string")
    gold = spark.createDataFrame([(f"T{i}", None if i % 3 == 0 else "Shop", "Salary" if i % 3 == 0 else None,
                                   "Income") for i in range(30)],
                                 "txn_id string, canonical_merchant string, txn_type string, category string")
    out = os.path.join(_tmp(), "chat")
    IO.export_chat_jsonl(feed, gold, out)
    lines = spark.read.text(out).collect()
    assert len(lines) == 30
    rec = json.loads(lines[0]["value"])
    assert [m["role"] for m in rec["messages"]] == ["user", "assistant"]
    ans = json.loads(rec["messages"][1]["content"])
    assert ans["canonical_merchant"] in ("Shop", "Salary") and ans["category"] == "Income"


def test_manifest_and_preds_refusals(spark):
    m = C.build_manifest(seed=42, feed="fp")
    assert m["manifest_hash"] == C.manifest_hash(m)
    ids = spark.createDataFrame([("T1",), ("T2",)], "txn_id string")
    preds = spark.createDataFrame([("T1", "A"), ("T2", "B")], "txn_id string, canonical_merchant string")
    path = os.path.join(_tmp(), "preds")
    C.save_preds(preds, path, m["manifest_hash"], "random", "model", "rules")
    assert C.load_preds(spark, path, "random", "model", "rules", m, ids).count() == 2
    with pytest.raises(C.ManifestError):
        C.load_preds(spark, path, "random", "model", "rules", {**m, "seed": 1}, ids)
    more = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "txn_id string")
    with pytest.raises(C.ManifestError):
        C.load_preds(spark, path, "random", "model", "rules", m, more)
    dup = preds.unionByName(preds.limit(1))
    C.save_preds(dup, path, m["manifest_hash"], "random", "model", "dup")
    v = C.check_preds(spark.read.parquet(path).filter("route = 'dup'"), ids, m["manifest_hash"]).first()
    assert v["duplicate_ids"] == 1 and v["missing_ids"] == 0


def test_fingerprint_is_order_insensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string").repartition(3)
    assert C.fingerprint_str(a) == C.fingerprint_str(b)
    c = spark.createDataFrame([(2, "y"), (1, "z")], "a int, b string")
    assert C.fingerprint_str(a) != C.fingerprint_str(c)


def test_load_sample_stratified(spark):
    rows = [("McDonald's #1", "Food & Dining", "USA", "USD")] * 60 + [("Wage", "Income", "UK", "GBP")] * 30 + \
           [("BP", "Transportation", "USA", "USD")] * 10
    path = os.path.join(_tmp(), "raw")
    spark.createDataFrame(rows, IO.RAW_SCHEMA).write.parquet(path)
    s = IO.load_sample(spark, path, n=20)
    got = {r["category"]: r["count"] for r in s.groupBy("category").count().collect()}
    assert got == {"Food & Dining": 12, "Income": 6, "Transportation": 2}
    assert IO.load_sample(spark, path, n=1000).count() == 100
