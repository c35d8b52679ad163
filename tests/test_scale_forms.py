"""Forms that hold at scale give the plain forms' values."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from merchantry.operators import families as FM
from merchantry.operators import stats as ST
from merchantry.operators import synth as SY
from merchantry.operators import vectors as V


def test_quantiles_equal_percentile(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0, 5), 2)) for _ in range(5000)] + [("hot", 1.5)] * 3000 + [("one", 4.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows + [("none", None), ("hot", None)], "g string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in ST.quantiles(df, "x", ["g"], qs).collect()}
    want = {r["g"]: r["q"] and [round(v, 3) for v in r["q"]] for r in df.groupBy("g").agg(
        F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("q")).collect()}
    assert got.keys() == want.keys() and got["none"] is None
    assert all(np.allclose(got[g], want[g], atol=1.1e-3) for g in ("hot", "one", None))
    assert len(ST.quantiles(df, "x").columns) == 1
    plan = ST.quantiles(df, "x", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_poisson_bootstrap_has_the_multinomial_width(spark):
    rng = random.Random(2)
    rows = [(f"c{i % 300}", rng.random() < 0.7, rng.random() < 0.6) for i in range(3000)]
    df = spark.createDataFrame(rows, "c string, a boolean, b boolean")
    exact = ST.paired_bootstrap(df, "a", "b", "c", n_boot=600).first()
    free = ST.paired_bootstrap(df, "a", "b", "c", n_boot=600, multinomial_up_to=0).first()
    assert abs(exact["diff"] - free["diff"]) < 1e-12 and free["n_clusters"] == 300
    assert 0.85 < (free["hi"] - free["lo"]) / (exact["hi"] - exact["lo"]) < 1.15
    w = spark.range(40000).select(ST.poisson_weight(F.col("id") / 40000).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 40000 for r in w}
    assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 1e-3 for k in range(5))


def test_mcnemar_counts_of_any_size(spark):
    def p(a, b):
        n, m = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2 ** n) if a != b else 1.0
    counts = [(0, 0), (0, 1), (3, 9), (1, 40), (250, 300), (900, 1100), (5, 4)]
    for a, b in counts:
        c = spark.range(a + b).select((F.col("id") < a).alias("x"))
        got = ST.mcnemar(c, F.col("x"), ~F.col("x")).first()
        assert (got["only_a"], got["only_b"]) == (a, b) and math.isclose(got["p_value"], p(a, b), rel_tol=1e-9)
    # 1e8 against 1e8 + 20000: a normal distribution, two standard deviations of sqrt(n) / 2 away from its middle
    wide = spark.createDataFrame([(100_000_000, 100_020_000)], "only_a long, only_b long")
    got = wide.select(ST.mcnemar_p(F.col("only_a"), F.col("only_b")).alias("p")).first()["p"]
    z = (20000 - 1) / math.sqrt(200_020_000)
    assert math.isclose(got, math.erfc(z / math.sqrt(2)), rel_tol=1e-4)


def test_nearest_vector_tiles(spark):
    rng = np.random.default_rng(1)
    q, w = rng.normal(size=(300, 8)), rng.normal(size=(50, 8))
    w[40] = w[7]                                   # a tie: the first name wins
    q[5] = w[7]
    for tile in (1, 64, 1 << 20):
        best, top = V.best_in_tiles(q, w, tile)
        assert (best == (q @ w.T).argmax(axis=1)).all() and np.allclose(top, (q @ w.T).max(axis=1))
    qd = spark.createDataFrame([(i % 200, v.tolist()) for i, v in enumerate(q)], "id long, vec array<double>")
    wd = spark.createDataFrame([(f"n{i:02d}", v.tolist()) for i, v in enumerate(w)], "name string, vec array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i % 200, f"n{k:02d}") for i, k in enumerate((unit(q) @ unit(w).T).argmax(axis=1)))
    for cell in (50, 7):
        got = sorted((r["id"], r["name"]) for r in V.nearest_vector(qd, wd, max_broadcast=cell).collect())
        assert got == want
    assert {r["name"] for r in V.nearest_vector(qd, wd.limit(0)).collect()} == {None}


def test_containment_with_a_token_in_a_third_of_all_names(spark):
    rng = random.Random(6)
    names = {" ".join(rng.sample([f"w{i}" for i in range(60)], rng.randint(1, 4)) + (["hot"] if i % 3 == 0 else [])) for i in range(900)}
    names |= {"hot hotter", "hot hotter hottest", "hot", ""}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["a"], r["b"]) for r in FM.containment_edges(df, posting_rows=50).collect()}
    toks = {n: set(n.split()) for n in names}
    tokens_of = [t for s in toks.values() for t in s]
    hubs = {n for n, s in toks.items() if len(s) == 1 and tokens_of.count(next(iter(s))) - 1 >= 3}
    real = [n for n in names if toks[n] and n not in hubs]
    assert got == {(a, b) for a in real for b in real if a != b and toks[a] <= toks[b]}


def test_zipf_bisection_equals_the_table(spark):
    table = {r["n"]: r["cdf"] for r in SY.zipf_table(spark, 200, 1.5).collect()}
    assert len(table) == 200 and all(len(c) == n for n, c in table.items())
    df = spark.range(3000).select("id", (F.col("id") % 203).alias("n"))
    got = SY.zipf_pick(df, "n", F.col("id").cast("string"), "rank", SY.zipf_table(spark, 200, 1.5))
    from merchantry.functions.hashing import hash52
    rows = got.withColumn("h", hash52(F.col("id").cast("string"))).collect()
    for r in rows:
        cdf = table.get(r["n"])
        assert r["rank"] == (None if cdf is None else int(np.searchsorted(cdf, r["h"] % cdf[-1], side="right")))


def test_row_numbers_are_dense_and_do_not_depend_on_files(spark):
    df = spark.createDataFrame([(f"d{i % 700}", None if i % 7 else i % 3) for i in range(4000)], "d string, c int").unionByName(
        spark.range(200_000).select(F.lit("same").alias("d"), F.lit(None).cast("int").alias("c")))
    runs = []
    for n in (1, 8):
        got = SY.number_rows(df.repartition(n), bucket_rows=100, copy_rows=30_000)
        stats = got.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()
        assert tuple(stats) == (204_000, 204_000, 0, 203_999)
        runs.append(got.groupBy("d", "c").agg(F.min("row_id"), F.max("row_id"), F.count("*")))
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))


def _labelled_rows(spark, copies=5):
    """(feed, gold) of 40 texts, each of them ``copies`` times."""
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"T{i * copies + j}", f"{words[i % 4]} shop {'xyz'[i % 3] * (i // 4 + 1)}", "O-1" if i % 3 else "I-2", 5000 + i % 4,
             float(10 * i + 1), ["Food", "Travel", "Health"][i % 3], f"{words[i % 4]} shop") for i in range(40) for j in range(copies)]
    d = spark.createDataFrame(rows, "txn_id string, description string, transaction_type_code string, mcc int, amount double, "
                                    "category string, canonical_merchant string")
    return (d.drop("category", "canonical_merchant"),
            d.select("txn_id", "category", "canonical_merchant", F.lit(None).cast("string").alias("txn_type")))


def _written(monkeypatch, module):
    tables, write = {}, module.materialize
    def kept(df, name, *more):
        tables[name] = write(df, name, *more)
        return tables[name]
    monkeypatch.setattr(module, "materialize", kept)
    return tables


def test_equal_rows_are_one_weighted_row_of_a_regression(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector
    from merchantry.functions.text import letter_counts
    from merchantry.operators import routes
    feed, gold = _labelled_rows(spark)
    tables = _written(monkeypatch, routes)
    routes.MetadataRoute().fit(feed, gold)
    route = routes.EmbeddingRoute().fit(feed, gold)
    for name in ("metadata_weights", "embedding_weights"):
        assert tables[name].agg(F.count(F.lit(1)), F.sum("weight")).first()[:] == (40, 200.0)
    x = feed.join(gold, "txn_id").withColumn("features", array_to_vector(letter_counts("description")))
    plain = Pipeline(stages=[StringIndexer(inputCol="category", outputCol="label_idx"), routes._logreg(x.count())]).fit(x)
    assert plain.stages[0].labels == route.labels
    answers = [{r.txn_id: r.prediction for r in m.transform(x).select("txn_id", "prediction").collect()} for m in (plain, route.clf)]
    assert answers[0] == answers[1]


def test_candidates_are_scored_once_and_by_several_tasks(spark, monkeypatch):
    from merchantry.operators import fuzzy, routes
    from merchantry.plans.stand_in_models import first_candidate_chooser
    feed, gold = _labelled_rows(spark)
    calls, scan = [], fuzzy._scan
    def counted(*args):
        out = scan(*args)
        calls.append(out.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(fuzzy, "_scan", counted)
    tables = _written(monkeypatch, routes)
    route = routes.ChoiceRoute(first_candidate_chooser).fit(feed, gold)
    assert route.transform(feed).count() == 200 and tables["candidates"].count() == 200 and len(calls) == 1
    many = spark.range(300).select(F.concat(F.lit("alpha shop "), F.col("id").cast("string")).alias("query"))
    names = spark.createDataFrame([("alpha shop", "Alpha Shop", 0)], "key string, name string, ord long")
    assert fuzzy.fuzzy_topk(many, names, 1).count() == 300 and calls[-1] > 1


def test_views_write_the_rows_of_each_side_once(spark):
    from merchantry.operators import views
    from merchantry.session import materialize
    feed, gold = _labelled_rows(spark)
    member = feed.select("txn_id", (F.pmod(F.xxhash64("description"), F.lit(3)) == 0).alias("is_eval"))
    labelled, names = feed.join(gold, "txn_id"), []
    def write(df, name):
        names.append(name)
        return materialize(df, name)
    plain = views.build_views(feed, gold, member, labelled_feed=labelled)
    kept = views.build_views(feed, gold, member, labelled_feed=labelled, write=write)
    assert names == ["train_rows", "eval_rows", "conflicts"]
    for a, b in zip(plain, kept):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
