"""Registered queries over the supplied tables (see plans/testdata.py for the mapping)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.plans import oracle as O
from merchantry.plans.catalog import register
from merchantry.plans.testdata import raw_labelled
from merchantry.session import materialize

_CACHE: dict = {}


def _sid(spark: SparkSession) -> str:
    """Identity of a running session (unique per application, never reused)."""
    return f"{spark.sparkContext.applicationId}:{spark.sparkContext.startTime}"


def fg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feed and gold for one directory: synthesised once per session and written as one
    Parquet table under the checkpoint directory (small plans for every later query,
    nothing lost with an executor)."""
    key = (_sid(spark), sf_dir)
    if key not in _CACHE:
        from merchantry.operators.synth import split_feed_gold
        from merchantry.plans.testdata import feed_gold_wide
        # one synthesis job writes feed and gold together; later queries read small plans
        wide = materialize(feed_gold_wide(spark, sf_dir), "feed_gold")
        _CACHE[("wide", _sid(spark), sf_dir)] = wide
        feed, gold = split_feed_gold(wide)
        _CACHE[key] = (feed, gold)
    return _CACHE[key]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed and gold columns in one table (both are projections of it)."""
    fg(spark, sf_dir)
    return _CACHE[("wide", _sid(spark), sf_dir)]


# ------------------------------------------------------------------ synthesis (H4, A1)
@register("synth_raw", O.with_feed(
    "SELECT row_id, transaction_description, category, country, currency, customer_no, "
    "amount_abs, posted_date FROM raw"))
def q_synth_raw(spark, sf_dir):
    return raw_labelled(spark, sf_dir)


@register("synth_feed", O.with_feed("SELECT * FROM feed"))
def q_synth_feed(spark, sf_dir):
    return fg(spark, sf_dir)[0]


@register("synth_gold", O.with_feed("SELECT * FROM gold"))
def q_synth_gold(spark, sf_dir):
    return fg(spark, sf_dir)[1]


# ------------------------------------------------------------------ imports for queries
from merchantry import constants as K  # noqa: E402
from merchantry.functions import text as TX  # noqa: E402
from merchantry.functions.hashing import hkey, in_eval, uniform  # noqa: E402
from merchantry.functions.labels import merchant_ok  # noqa: E402
from merchantry.operators import aggregates as AG  # noqa: E402
from merchantry.operators import metrics as M  # noqa: E402
from merchantry.operators.routes import CleanerRoute  # noqa: E402
from merchantry.plans import sql as Q  # noqa: E402
from merchantry.plans.sql import Sql  # noqa: E402

W = O.with_feed


def _round6(df: DataFrame, cols: list[str]) -> DataFrame:
    """Doubles built from sums of non-integers are compared across engines at 6 dp."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ scalar functions (B)
@register("b1_strip_prefix", W(f"SELECT txn_id, {Q.strip_processor_prefix('description')} AS stripped FROM feed"))
def q_b1(spark, sf_dir):
    return fg(spark, sf_dir)[0].select("txn_id", TX.strip_processor_prefix("description").alias("stripped"))


@register("b2_clean_description", W(f"SELECT txn_id, {Q.clean_description('description')} AS cleaned FROM feed"))
def q_b2(spark, sf_dir):
    return fg(spark, sf_dir)[0].select("txn_id", TX.clean_description("description").alias("cleaned"))


@register("b3_canonical", W(
    f"SELECT txn_id, {Q.derive_canonical(Q.strip_processor_prefix('description'))} AS canonical FROM feed"))
def q_b3(spark, sf_dir):
    return fg(spark, sf_dir)[0].select(
        "txn_id", TX.derive_canonical(TX.strip_processor_prefix("description")).alias("canonical"))


@register("b5_strip_coverage", W(
    "SELECT coalesce(avg(CASE WHEN c <> '' AND NOT (regexp_matches(c, " + Q.q(TX.IDS) + ") OR "
    "regexp_matches(c, " + Q.q(TX.PAREN) + ") OR regexp_matches(c, " + Q.q(TX.COUNTRY_RE) + ")) "
    "THEN 1.0 ELSE 0.0 END), 0.0) AS strip_coverage FROM (SELECT "
    + Q.derive_canonical("transaction_description") + " AS c FROM raw)"))
def q_b5(spark, sf_dir):
    raw = raw_labelled(spark, sf_dir).select(TX.derive_canonical("transaction_description").alias("c"))
    ok = (F.col("c") != "") & ~TX.residual_noise("c")
    return raw.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("strip_coverage"))


@register("b6_b11_merchant_norm_tokens", W(
    f"SELECT canonical_merchant, {Q.norm_merchant('canonical_merchant')} AS norm, "
    f"{Q.name_tokens_sorted('canonical_merchant')} AS tokens "
    "FROM (SELECT DISTINCT canonical_merchant FROM gold WHERE canonical_merchant IS NOT NULL)"))
def q_b6(spark, sf_dir):
    g = fg(spark, sf_dir)[1].select("canonical_merchant").filter(F.col("canonical_merchant").isNotNull()).distinct()
    return g.select("canonical_merchant", TX.norm_merchant("canonical_merchant").alias("norm"),
                    F.array_sort(TX.name_tokens("canonical_merchant")).alias("tokens"))


@register("b12_in_eval", W(f"SELECT txn_id, {Q.in_eval('txn_id', 0.2)} AS is_eval FROM feed"))
def q_b12(spark, sf_dir):
    return fg(spark, sf_dir)[0].select("txn_id", in_eval("txn_id", 0.2).alias("is_eval"))


@register("b13_abbreviate", W(
    f"SELECT canonical_merchant, {Q.abbreviate('upper(canonical_merchant)')} AS abbreviated "
    "FROM (SELECT DISTINCT canonical_merchant FROM gold WHERE canonical_merchant IS NOT NULL)"))
def q_b13(spark, sf_dir):
    g = fg(spark, sf_dir)[1].select("canonical_merchant").filter(F.col("canonical_merchant").isNotNull()).distinct()
    return g.select("canonical_merchant", TX.abbreviate(F.upper("canonical_merchant")).alias("abbreviated"))


@register("b7_b8_merchant_ok", W(
    "SELECT f.txn_id, " + Q.merchant_ok(Q.derive_canonical(Q.strip_processor_prefix("f.description")),
                                         "g.canonical_merchant", "FALSE") + " AS merchant_ok, "
    + Q.category_ok("NULL", "g.category") + " AS category_ok "
    "FROM feed f JOIN gold g ON f.txn_id = g.txn_id"))
def q_b7(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    j = feed.join(gold, "txn_id")
    pred = TX.derive_canonical(TX.strip_processor_prefix("description"))
    from merchantry.functions.labels import category_ok
    return j.select("txn_id", merchant_ok(pred, F.col("canonical_merchant"), F.lit(False)).alias("merchant_ok"),
                    category_ok(F.lit(None).cast("string"), F.col("category")).alias("category_ok"))


# ------------------------------------------------------------------ aggregates (D)
ROLLUP_SQL = W("""SELECT customer_id, canonical_merchant,
    round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS total_spend, count(*) AS txn_count
  FROM feed JOIN gold USING (txn_id) WHERE canonical_merchant IS NOT NULL
  GROUP BY customer_id, canonical_merchant""")


@register("d1_rollup_gold", ROLLUP_SQL)
def q_d1(spark, sf_dir):
    g = wide(spark, sf_dir).filter(F.col("canonical_merchant").isNotNull())
    return AG.rollup_by_merchant(g)


@register("d2_conflicts", W(f"""SELECT description, count(DISTINCT key) AS k, count(*) AS n FROM
  (SELECT f.description, coalesce(g.canonical_merchant, '') || chr(31) || coalesce(g.txn_type, '') AS key
   FROM feed f JOIN gold g USING (txn_id)) GROUP BY description HAVING count(DISTINCT key) > 1"""))
def q_d2(spark, sf_dir):
    return AG.conflicting_descriptors(wide(spark, sf_dir), None)


@register("d3_composition", W("""
  SELECT 'category' AS dimension, category AS value, count(*) AS n FROM gold GROUP BY category
  UNION ALL SELECT 'origin', coalesce(origin, 'none'), count(*) FROM gold GROUP BY coalesce(origin, 'none')
  UNION ALL SELECT 'rows', NULL, count(*) FROM gold
  UNION ALL SELECT 'merchants', NULL, count(DISTINCT canonical_merchant) FROM gold"""))
def q_d3(spark, sf_dir):
    return AG.composition(fg(spark, sf_dir)[1])


_MAJ_SQL = """SELECT {key}, arg_min(category, (-n, first)) AS category FROM (
    SELECT {key}, category, count(*) AS n, min(txn_id) AS first FROM ({src}) WHERE {key} IS NOT NULL
    GROUP BY {key}, category) GROUP BY {key}"""


@register("d4_mcc_prior", W(_MAJ_SQL.format(
    key="mcc", src="SELECT f.txn_id, f.mcc, g.category FROM feed f JOIN gold g USING (txn_id)")))
def q_d4_mcc(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    return AG.majority_category(feed.select("txn_id", "mcc").join(gold.select("txn_id", "category"), "txn_id"), "mcc")


@register("d4_label_prior", W(_MAJ_SQL.format(
    key="label", src="SELECT txn_id, coalesce(canonical_merchant, txn_type) AS label, category FROM gold")))
def q_d4_label(spark, sf_dir):
    gold = fg(spark, sf_dir)[1]
    return AG.majority_category(gold.withColumn("label", F.coalesce("canonical_merchant", "txn_type")), "label")


@register("d5_global_majority", W(
    "SELECT arg_min(category, (-n, category)) AS category FROM "
    "(SELECT category, count(*) AS n FROM gold GROUP BY category)"))
def q_d5(spark, sf_dir):
    return AG.global_majority(fg(spark, sf_dir)[1])


@register("d6_known_list", W("""
  SELECT key, arg_max(name, kind = 'merchant') AS name, arg_max(kind, kind = 'merchant') AS kind,
         min(CASE WHEN kind = 'type' THEN 0 ELSE 1 END) AS ord_k,
         arg_min(first, (CASE WHEN kind = 'type' THEN 0 ELSE 1 END, first)) AS ord_f
  FROM per GROUP BY key""", [
    """lab AS (SELECT txn_id, CASE WHEN canonical_merchant IS NOT NULL THEN 'merchant'
                 WHEN txn_type IS NOT NULL THEN 'type' END AS kind,
                 coalesce(canonical_merchant, txn_type) AS name FROM gold)""",
    f"""per AS (SELECT {Q.clean_description('name')} AS key, kind, arg_max(name, txn_id) AS name,
                 min(txn_id) AS first FROM lab WHERE kind IS NOT NULL GROUP BY ALL)"""]))
def q_d6(spark, sf_dir):
    kl = AG.known_list(fg(spark, sf_dir)[1])
    return kl.select("key", "name", "kind", F.col("ord.k").alias("ord_k"), F.col("ord.f").alias("ord_f"))


@register("d7_one_per_descriptor", W("SELECT description, min(txn_id) AS txn_id FROM feed GROUP BY description"))
def q_d7(spark, sf_dir):
    return AG.one_per_descriptor(fg(spark, sf_dir)[0])


@register("d8_first_label_per_descriptor", W("""
  SELECT description, txn_id, r.m AS canonical_merchant, r.c AS category FROM (
    SELECT description, min(txn_id) AS txn_id, arg_min({'m': canonical_merchant, 'c': category}, txn_id) AS r
    FROM feed JOIN gold USING (txn_id) GROUP BY description)"""))
def q_d8(spark, sf_dir):
    j = wide(spark, sf_dir).select("txn_id", "description", "canonical_merchant", "category")
    return AG.first_per_group(j, "description", "txn_id", ["canonical_merchant", "category"])


@register("d27_seen_twice", W("SELECT description, count(*) AS n FROM feed GROUP BY description HAVING count(*) >= 2"))
def q_d27(spark, sf_dir):
    return AG.seen_at_least(fg(spark, sf_dir)[0], "description", 2)


@register("d39_synth_stats", W("""
  SELECT org AS origin, count(DISTINCT canonical_merchant) AS merchants, count(*) AS rows,
         count(DISTINCT description) AS descriptors, round(count(DISTINCT description) / count(*), 6) AS descriptors_per_row
  FROM j GROUP BY org
  UNION ALL SELECT 'all', count(DISTINCT canonical_merchant), count(*), count(DISTINCT description),
         round(count(DISTINCT description) / count(*), 6) FROM j""",
    ["j AS (SELECT g.*, f.description, coalesce(g.origin, 'none') AS org FROM gold g JOIN feed f USING (txn_id))"]))
def q_d39(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    return AG.synth_stats(gold, feed)


@register("d40_busiest_customer", W(
    "SELECT arg_min(customer_id, (-n, customer_id)) AS customer_id, max(n) AS n FROM "
    "(SELECT customer_id, count(*) AS n FROM feed GROUP BY customer_id)"))
def q_d40(spark, sf_dir):
    return AG.busiest(fg(spark, sf_dir)[0])


# ------------------------------------------------------------------ cleaner route + metrics
CLEANER_PRED = (f"SELECT txn_id, {Q.derive_canonical(Q.strip_processor_prefix('description'))} AS canonical_merchant, "
                "NULL::VARCHAR AS category, CASE WHEN amount > 0 THEN 'incoming' ELSE 'outgoing' END AS direction FROM feed")


@register("r1_cleaner_preds", W(CLEANER_PRED))
def q_r1(spark, sf_dir):
    return CleanerRoute().transform(fg(spark, sf_dir)[0])


@register("d10_d11_cleaner_scores", W(f"""
  SELECT avg(CASE WHEN g.canonical_merchant IS NOT NULL THEN
             ({Q.merchant_ok('p.canonical_merchant', 'g.canonical_merchant', 'FALSE')})::INT END) AS merchant_norm,
         avg(CASE WHEN g.canonical_merchant IS NOT NULL THEN
             coalesce(p.canonical_merchant = g.canonical_merchant, FALSE)::INT END) AS merchant_exact,
         avg(coalesce(p.direction = g.direction, FALSE)::INT) AS direction_accuracy,
         count(*) AS n
  FROM p JOIN gold g USING (txn_id)""", [f"p AS ({CLEANER_PRED})"]))
def q_d10(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    row = M.leaderboard_row(CleanerRoute().transform(feed).drop("category"), gold, "cleaner", "all", "full")
    return row.select("merchant_norm", "merchant_exact", "direction_accuracy", "n")


@register("d13_dedup_ratio", W(f"""
  SELECT CASE WHEN count(DISTINCT f.description) = 0 THEN 0.0 ELSE
    (count(DISTINCT p.canonical_merchant) + coalesce(max((p.canonical_merchant IS NULL)::INT), 0))
    / count(DISTINCT f.description) END AS dedup_ratio
  FROM p JOIN feed f USING (txn_id)""", [f"p AS ({CLEANER_PRED})"]))
def q_d13(spark, sf_dir):
    feed = fg(spark, sf_dir)[0]
    p = CleanerRoute().transform(feed).join(feed.select("txn_id", "description"), "txn_id")
    return M.dedup_ratio(p)


KPI_SQL = W("""
  SELECT round(coalesce(avg(CASE WHEN total_spend IS NOT NULL THEN abs(total_spend - coalesce(pred_spend, 0.0)) END), 0.0), 6) AS mae,
         round(coalesce(avg(CASE WHEN total_spend IS NOT NULL THEN
           (abs(total_spend - coalesce(pred_spend, 0.0)) / greatest(abs(total_spend), 1e-9) <= 0.01)::INT END), 0.0), 6)
           AS within_tolerance,
         count(*) FILTER (WHERE total_spend IS NULL) AS pred_only_buckets
  FROM merged""", [
    f"p AS ({CLEANER_PRED})",
    f"gm AS (SELECT txn_id, {Q.norm_merchant('canonical_merchant')} AS m FROM gold WHERE canonical_merchant IS NOT NULL)",
    "base AS (SELECT f.txn_id, f.customer_id, f.amount FROM feed f WHERE f.txn_id IN (SELECT txn_id FROM gm))",
    """groll AS (SELECT customer_id, m, round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS total_spend
            FROM base JOIN gm USING (txn_id) GROUP BY ALL)""",
    f"""proll AS (SELECT customer_id, {Q.norm_merchant('p.canonical_merchant')} AS m,
                   round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS pred_spend
            FROM base JOIN p USING (txn_id) GROUP BY ALL)""",
    "merged AS (SELECT * FROM groll FULL OUTER JOIN proll USING (customer_id, m))"])


@register("d14_spend_kpi_cleaner", KPI_SQL)
def q_d14(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    return _round6(M.spend_kpi(feed, CleanerRoute().transform(feed), gold), ["mae", "within_tolerance"])


@register("d15_subsets_cleaner", W(f"""
  SELECT subset, avg(ok) AS accuracy, count(*) AS n FROM (
    SELECT unnest(list_filter([
        CASE WHEN NOT coalesce(g.noise_abbrev, FALSE) AND NOT coalesce(g.noise_trunc, FALSE) THEN 'recoverable' END,
        CASE WHEN coalesce(g.noise_abbrev, FALSE) THEN 'abbreviated' END,
        CASE WHEN coalesce(g.noise_trunc, FALSE) THEN 'truncated' END,
        CASE WHEN g.origin IS NOT NULL THEN 'origin:' || g.origin END], lambda t: t IS NOT NULL)) AS subset,
      ({Q.merchant_ok('p.canonical_merchant', 'g.canonical_merchant', 'FALSE')})::DOUBLE AS ok
    FROM p JOIN gold g USING (txn_id) WHERE g.canonical_merchant IS NOT NULL) GROUP BY subset""",
    [f"p AS ({CLEANER_PRED})"]))
def q_d15(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    return M.merchant_subsets(CleanerRoute().transform(feed).drop("category"), gold)


# ------------------------------------------------------------------ windows (E)
from merchantry.operators import windows as WN  # noqa: E402
from merchantry.operators import splits as SP  # noqa: E402
from merchantry.operators import views as VW  # noqa: E402
from merchantry.operators import families as FM  # noqa: E402
from merchantry.operators import stats as ST  # noqa: E402

NEW_SQL = """SELECT f.txn_id, (f.posted_date, f.txn_id) = (m.d, m.t) AS is_new FROM feed f JOIN
  (SELECT description, arg_min(posted_date, (posted_date, txn_id)) AS d, arg_min(txn_id, (posted_date, txn_id)) AS t
   FROM feed GROUP BY description) m USING (description)"""


@register("e1_new_flags", W(NEW_SQL))
def q_e1(spark, sf_dir):
    return WN.running_new_flags(fg(spark, sf_dir)[0]).select("txn_id", "is_new")


@register("e3_hit_rate_by_month", W(f"""SELECT strftime(f.posted_date, '%Y-%m') AS month,
  round(avg((NOT n.is_new)::INT), 3) AS hit_rate, count(*) AS n
  FROM feed f JOIN ({NEW_SQL}) n USING (txn_id) GROUP BY month"""))
def q_e3(spark, sf_dir):
    return WN.cache_hit_rate_by_month(fg(spark, sf_dir)[0])


@register("e3_hit_rate_by_day", W(f"""SELECT f.posted_date AS day,
  round(avg((NOT n.is_new)::INT), 3) AS hit_rate, count(*) AS n
  FROM feed f JOIN ({NEW_SQL}) n USING (txn_id) GROUP BY day"""))
def q_e3d(spark, sf_dir):
    flagged = WN.running_new_flags(fg(spark, sf_dir)[0]).withColumn("hit", ~F.col("is_new"))
    return WN.rate_by(flagged, "hit", "posted_date", "hit_rate", "day")


def statement(feed: DataFrame) -> DataFrame:
    """The feed as a bank statement: DD for outgoing ACH, DEB for other outgoing, CR for
    incoming; debit / credit amounts; row_no = file order (txn_id)."""
    t = (F.when((F.col("amount") < 0) & (F.col("payment_method") == "ach"), "DD")
         .when(F.col("amount") < 0, "DEB").otherwise("CR"))
    return feed.select(F.col("posted_date").alias("date"), t.alias("type"), "description",
                       F.when(F.col("amount") < 0, -F.col("amount")).alias("debit"),
                       F.when(F.col("amount") > 0, F.col("amount")).alias("credit"),
                       F.col("txn_id").alias("row_no"), "customer_id")


STATEMENT_SQL = """stmt AS (SELECT posted_date AS date,
  CASE WHEN amount < 0 AND payment_method = 'ach' THEN 'DD' WHEN amount < 0 THEN 'DEB' ELSE 'CR' END AS type,
  description, CASE WHEN amount < 0 THEN -amount END AS debit, CASE WHEN amount > 0 THEN amount END AS credit,
  txn_id AS row_no, customer_id FROM feed)"""


@register("e2_new_rate_by_year", W("""SELECT year(s.date)::INTEGER AS year, round(avg(((s.date, s.row_no) = (m.d, m.r))::INT), 3)
  AS new_rate, count(*) AS n FROM (SELECT * FROM stmt WHERE type IN ('DEB', 'DD')) s JOIN
  (SELECT description, arg_min(date, (date, row_no)) AS d, arg_min(row_no, (date, row_no)) AS r
   FROM stmt WHERE type IN ('DEB', 'DD') GROUP BY description) m USING (description) GROUP BY year""",
    [STATEMENT_SQL]))
def q_e2(spark, sf_dir):
    return WN.new_descriptor_rate_by_year(statement(fg(spark, sf_dir)[0]))


@register("d25_spend_by_descriptor", W("""SELECT description,
  round(sum(abs(coalesce(debit, 0.0))::DECIMAL(18,2)), 2)::DOUBLE AS spend, count(*) AS n,
  count(*) FILTER (WHERE debit IS NULL) AS n_null_debit
  FROM stmt WHERE type IN ('DEB', 'DD') GROUP BY description""", [STATEMENT_SQL]))
def q_d25(spark, sf_dir):
    return AG.spend_by_descriptor(statement(fg(spark, sf_dir)[0]))


# ------------------------------------------------------------------ sampling and splits (F)
ORDER_U = Q.uniform(Q.hkey(str(K.SEED), "order", Sql("txn_id")))


@register("f2_seeded_cap", W(f"SELECT txn_id, description FROM feed ORDER BY {ORDER_U}, txn_id LIMIT 500"))
def q_f2(spark, sf_dir):
    return SP.seeded_cap(fg(spark, sf_dir)[0], 500).select("txn_id", "description")


@register("f3_split_random", W(f"SELECT txn_id, {ORDER_U} >= 0.8 AS is_eval FROM feed"))
def q_f3(spark, sf_dir):
    return SP.split_random(fg(spark, sf_dir)[0])


def _customer_strata(spark, sf_dir):
    from merchantry.plans.testdata import table
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")


@register("f4_stratified_sample", f"""
  WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey,
                    {Q.uniform(Q.hkey(str(K.SEED), 'strat', Sql('c_custkey::VARCHAR')))} AS u FROM customer),
  s AS (SELECT c_mktsegment, c_nationkey, count(*) AS size FROM c GROUP BY ALL),
  t AS (SELECT sum(size) AS total FROM s),
  k AS (SELECT s.*, least(size, greatest(1, round_even(300 * size / total, 0)::BIGINT)) AS take FROM s, t)
  SELECT c_custkey, c_mktsegment, c_nationkey FROM (
    SELECT c.*, k.take, row_number() OVER (PARTITION BY c.c_mktsegment, c.c_nationkey ORDER BY c.u) AS rn
    FROM c JOIN k USING (c_mktsegment, c_nationkey)) WHERE rn <= take""")
def q_f4(spark, sf_dir):
    from merchantry.operators.synth import stratified_sample
    c = _customer_strata(spark, sf_dir)
    u = uniform(hkey(str(K.SEED), "strat", F.col("c_custkey")))
    return stratified_sample(c, 300, ["c_mktsegment", "c_nationkey"], u)


def _families_sql() -> list[str]:
    links = " UNION ALL ".join(f"SELECT {Q.q(a)} AS a, {Q.q(b)} AS b" for a, b in K.FAMILY_LINKS)
    return [
        "m AS (SELECT DISTINCT canonical_merchant AS name FROM gold WHERE canonical_merchant IS NOT NULL)",
        f"tt AS (SELECT name, {Q.name_tokens_sorted('name')} AS toks FROM m)",
        "tokf AS (SELECT tok, count(DISTINCT name) AS f FROM (SELECT name, unnest(toks) AS tok FROM tt) GROUP BY tok)",
        "hub AS (SELECT t.name FROM tt t JOIN tokf f ON len(t.toks) = 1 AND t.toks[1] = f.tok WHERE f.f - 1 >= 3)",
        "nt AS (SELECT * FROM tt WHERE name NOT IN (SELECT name FROM hub) AND len(toks) > 0)",
        "edges AS (SELECT a.name AS a, b.name AS b FROM nt a JOIN nt b ON a.name <> b.name AND list_has_all(b.toks, a.toks))",
        f"lk AS (SELECT * FROM ({links}) WHERE a IN (SELECT name FROM m) AND b IN (SELECT name FROM m))",
        "und AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT a, b FROM lk UNION SELECT b, a FROM lk)",
        "reach(name, label) AS (SELECT name, name FROM m UNION SELECT u.b, r.label FROM reach r JOIN und u ON r.name = u.a)",
        "fam AS (SELECT name, min(label) AS family FROM reach GROUP BY name)",
    ]


@register("c9_containment_edges", W("SELECT a, b FROM edges", _families_sql()[:6]))
def q_c9(spark, sf_dir):
    g = fg(spark, sf_dir)[1]
    names = g.select(F.col("canonical_merchant").alias("name")).filter(F.col("name").isNotNull()).distinct()
    return FM.containment_edges(names)


@register("g5_brand_families", W("SELECT name, family FROM fam", _families_sql(), recursive=True))
def q_g5(spark, sf_dir):
    return FM.brand_families(fg(spark, sf_dir)[1].select(F.col("canonical_merchant").alias("name")))


UNSEEN_MEM_SQL = (f"mem AS (SELECT g.txn_id, CASE WHEN g.canonical_merchant IS NULL THEN {Q.in_eval('g.txn_id', 0.2)} "
                  f"ELSE {Q.in_eval('f.family', 0.2)} END AS is_eval FROM gold g LEFT JOIN fam f ON g.canonical_merchant = f.name)")


@register("f5_split_unseen", W("SELECT txn_id, is_eval FROM mem", _families_sql() + [UNSEEN_MEM_SQL], recursive=True))
def q_f5(spark, sf_dir):
    return SP.split_unseen(fg(spark, sf_dir)[1])


def _views_sql(mem_sql: str) -> list[str]:
    return [
        mem_sql,
        "tf AS (SELECT f.* FROM feed f JOIN mem m USING (txn_id) WHERE NOT m.is_eval)",
        "ef AS (SELECT f.* FROM feed f JOIN mem m USING (txn_id) WHERE m.is_eval)",
        """conf AS (SELECT description FROM (SELECT f.description, coalesce(g.canonical_merchant, '') || chr(31)
             || coalesce(g.txn_type, '') AS key FROM feed f JOIN gold g USING (txn_id))
             GROUP BY description HAVING count(DISTINCT key) > 1)""",
        "tdesc AS (SELECT DISTINCT description FROM tf)",
        """miss AS (SELECT * FROM ef WHERE description NOT IN (SELECT description FROM tdesc)
             AND description NOT IN (SELECT description FROM conf))""",
        "reps AS (SELECT description, min(txn_id) AS txn_id FROM miss GROUP BY description)",
        "pool AS (SELECT m.* FROM miss m JOIN reps r USING (description, txn_id))",
        "model AS (SELECT * FROM pool)",
        """trep AS (SELECT t.description, min(t.txn_id) AS rep_txn_id,
             arg_min({'m': g.canonical_merchant, 'c': g.category}, t.txn_id) AS r
             FROM tf t JOIN gold g USING (txn_id) WHERE t.description NOT IN (SELECT description FROM conf)
             GROUP BY t.description)""",
        """cache AS (SELECT e.txn_id, TRUE AS cache_hit, r.rep_txn_id, r.r.m AS cache_merchant, r.r.c AS cache_category
             FROM ef e JOIN trep r USING (description) WHERE e.description NOT IN (SELECT description FROM conf)
           UNION ALL SELECT e.txn_id, FALSE, mo.txn_id, NULL, NULL FROM ef e JOIN model mo USING (description))""",
    ]


RANDOM_MEM_SQL = f"mem AS (SELECT txn_id, {ORDER_U} >= 0.8 AS is_eval FROM feed)"


def _views(spark, sf_dir, split="random"):
    """Views of one split; the membership, model view and cache are written once (they
    feed many queries) and everything else is derived from them by semi joins."""
    key = ("views", _sid(spark), sf_dir, split)
    if key not in _CACHE:
        feed, gold = fg(spark, sf_dir)
        mem = SP.split_random(feed) if split == "random" else SP.split_unseen(gold)
        mem = materialize(mem, f"membership_{split}")
        v = VW.build_views(feed, gold, mem, labelled_feed=wide(spark, sf_dir), write=materialize)
        model_feed = materialize(v.model_feed, f"model_view_{split}")
        cache = materialize(v.cache, f"cache_{split}")
        ids = cache.select("txn_id")
        v = v._replace(model_feed=model_feed, cache=cache,
                       model_gold=gold.join(model_feed.select("txn_id"), "txn_id", "left_semi"),
                       ideal_feed=v.eval_feed.join(ids, "txn_id", "left_semi"),
                       ideal_gold=gold.join(ids, "txn_id", "left_semi"))
        _CACHE[key] = v
    return _CACHE[key]


@register("f7_model_view_random", W("SELECT txn_id, description FROM model", _views_sql(RANDOM_MEM_SQL)))
def q_f7(spark, sf_dir):
    return _views(spark, sf_dir).model_feed.select("txn_id", "description")


@register("f8_ideal_cache_random", W("SELECT * FROM cache", _views_sql(RANDOM_MEM_SQL)))
def q_f8(spark, sf_dir):
    return _views(spark, sf_dir).cache


@register("f7_model_view_unseen", W("SELECT txn_id, description FROM model",
                                    _families_sql() + _views_sql(UNSEEN_MEM_SQL), recursive=True))
def q_f7u(spark, sf_dir):
    return _views(spark, sf_dir, "unseen").model_feed.select("txn_id", "description")


@register("f8_ideal_cache_unseen", W("SELECT * FROM cache", _families_sql() + _views_sql(UNSEEN_MEM_SQL),
                                     recursive=True))
def q_f8u(spark, sf_dir):
    return _views(spark, sf_dir, "unseen").cache


@register("d36_view_stats_random", W(f"""SELECT count(*) AS n_eval,
    count(*) FILTER (WHERE description IN (SELECT description FROM tdesc)) AS removed_verbatim,
    round((SELECT count(*) FROM cache WHERE cache_hit) / greatest(count(*), 1), 4) AS cache_hit_rate,
    count(*) FILTER (WHERE description IN (SELECT description FROM conf)) AS conflict_eval_rows,
    (SELECT count(*) FROM pool) AS model_view_n, (SELECT count(*) FROM model) AS capped_n FROM ef""",
    _views_sql(RANDOM_MEM_SQL)))
def q_d36(spark, sf_dir):
    return _views(spark, sf_dir).stats


# ------------------------------------------------------------------ statistics on documents + labels
def conf_rows(spark, sf_dir) -> DataFrame:
    """Confidence rows: documents with a quality label; a length score is the
    confidence, choices 'high'/'low' (none for very short texts), gold from quality."""
    from merchantry.plans.testdata import table
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    conf = F.round(F.least(F.lit(1.0), F.log(1 + F.col("n_chars")) / 10.0), 6)
    choice = (F.when(F.col("n_chars") < 20, F.lit(K.NONE_OPTION))
              .when(conf >= 0.6, "high").otherwise("low"))
    gold = F.when(F.col("quality") == 1, "high").otherwise("low")
    return j.select("doc_id", F.col("lang").alias("dataset"), F.lit("length").alias("setting"),
                    "source", conf.alias("confidence"), choice.alias("choice"), gold.alias("gold"),
                    (choice == gold).alias("correct"),
                    ((conf >= 0.6) == (F.col("quality") == 1)).alias("a_ok"),
                    ((F.col("toxic") == 0) == (F.col("quality") == 1)).alias("b_ok"))


CONF_SQL = f"""cr AS (SELECT doc_id, lang AS dataset, 'length' AS setting, source,
    round(least(1.0, ln(1 + n_chars) / 10.0), 6) AS confidence,
    CASE WHEN n_chars < 20 THEN {Q.q(K.NONE_OPTION)} WHEN round(least(1.0, ln(1 + n_chars) / 10.0), 6) >= 0.6
         THEN 'high' ELSE 'low' END AS choice,
    CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS gold,
    (round(least(1.0, ln(1 + n_chars) / 10.0), 6) >= 0.6) = (quality = 1) AS a_ok,
    (toxic = 0) = (quality = 1) AS b_ok
  FROM documents JOIN labels USING (doc_id)),
crc AS (SELECT *, choice = gold AS correct FROM cr)"""


def _boot_sql(k_expr: str, n_boot: int, seed: int) -> str:
    return (f"draws AS (SELECT range // {k_expr} AS b, "
            f"{Q.hash52(Q.hkey(str(seed), 'boot', Sql('range::VARCHAR')))} % {k_expr} AS idx "
            f"FROM range(0, {n_boot} * {k_expr}))")


@register("d17_cluster_sums", "WITH " + CONF_SQL + """
  SELECT source AS cluster, sum(a_ok::INT - b_ok::INT)::DOUBLE AS num, count(*)::DOUBLE AS den, count(*) AS rows
  FROM crc GROUP BY source""")
def q_d17(spark, sf_dir):
    return ST.cluster_sums(conf_rows(spark, sf_dir), "a_ok", "b_ok", "source")


N_BOOT_Q = 1000


@register("d19_paired_bootstrap", f"""WITH {CONF_SQL},
  sums AS (SELECT source AS cluster, sum(a_ok::INT - b_ok::INT)::DOUBLE AS num, count(*)::DOUBLE AS den,
           count(*) AS rows FROM crc GROUP BY source),
  bk AS (SELECT *, {Q.hash52(Q.hkey('bucket', Sql('cluster')))} % 64 AS _bk FROM sums),
  off AS (SELECT _bk, coalesce(sum(count(*)) OVER (ORDER BY _bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off
          FROM bk GROUP BY _bk),
  idx AS (SELECT bk.*, off._off + row_number() OVER (PARTITION BY bk._bk ORDER BY cluster) - 1 AS idx
          FROM bk JOIN off USING (_bk)),
  kk AS (SELECT count(*) AS k FROM sums),
  draws AS (SELECT range // (SELECT k FROM kk) AS b,
            {Q.hash52(Q.hkey('0', 'boot', Sql('range::VARCHAR')))} % (SELECT k FROM kk) AS idx
            FROM range(0, {N_BOOT_Q} * (SELECT k FROM kk))),
  cnt AS (SELECT b, idx, count(*) AS cnt FROM draws GROUP BY b, idx),
  rep AS (SELECT b, CASE WHEN sum(cnt * den) <> 0 THEN sum(cnt * num) / sum(cnt * den) ELSE 0.0 END AS r
          FROM cnt JOIN idx USING (idx) GROUP BY b),
  q AS (SELECT quantile_cont(r, [0.025, 0.975]) AS q FROM rep)
  SELECT round(coalesce(sum(num) / nullif(sum(den), 0.0), 0.0), 6) AS diff, round((SELECT q[1] FROM q), 6) AS lo,
         round((SELECT q[2] FROM q), 6) AS hi, count(*) AS n_clusters, sum(rows)::BIGINT AS n_rows FROM sums""")
def q_d19(spark, sf_dir):
    return _round6(ST.paired_bootstrap(conf_rows(spark, sf_dir), "a_ok", "b_ok", "source", n_boot=N_BOOT_Q, seed=0),
                   ["diff", "lo", "hi"])


@register("d20_leave_one_out", f"""WITH {CONF_SQL},
  sums AS (SELECT source, sum(a_ok::INT - b_ok::INT)::DOUBLE AS num, count(*)::DOUBLE AS den FROM crc GROUP BY source),
  t AS (SELECT sum(num) AS n, sum(den) AS d FROM sums)
  SELECT min(CASE WHEN t.d - den <> 0 THEN (t.n - num) / (t.d - den) END) AS lo,
         max(CASE WHEN t.d - den <> 0 THEN (t.n - num) / (t.d - den) END) AS hi FROM sums, t""")
def q_d20(spark, sf_dir):
    return ST.leave_one_cluster_out(conf_rows(spark, sf_dir), "a_ok", "b_ok", "source")


@register("d21_mcnemar", f"""WITH {CONF_SQL},
  c AS (SELECT count(*) FILTER (WHERE a_ok AND NOT b_ok) AS only_a, count(*) FILTER (WHERE NOT a_ok AND b_ok) AS only_b FROM crc),
  t AS (SELECT only_a, only_b, only_a + only_b AS n, least(only_a, only_b) AS m FROM c)
  SELECT only_a, only_b, round(CASE WHEN only_a = only_b THEN 1.0 ELSE least(1.0, 2 * (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) FROM range(0, m + 1) r(i))) END, 6)
    AS p_value FROM t""")
def q_d21(spark, sf_dir):
    return _round6(ST.mcnemar(conf_rows(spark, sf_dir), "a_ok", "b_ok"), ["p_value"])


@register("d28_auroc", f"""WITH {CONF_SQL},
  acc AS (SELECT * FROM crc WHERE choice <> {Q.q(K.NONE_OPTION)}),
  per AS (SELECT dataset, confidence AS s, count(*) FILTER (WHERE correct) AS p, count(*) FILTER (WHERE NOT correct) AS n
          FROM acc GROUP BY dataset, confidence),
  cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dataset ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
  SELECT dataset, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + 0.5 * n)) / (sum(p) * sum(n)) END AS auroc
  FROM cum GROUP BY dataset""")
def q_d28(spark, sf_dir):
    r = conf_rows(spark, sf_dir).filter(F.col("choice") != K.NONE_OPTION)
    return ST.auroc(r, "confidence", F.col("correct"), ["dataset"])


@register("d29_quantiles", f"""WITH {CONF_SQL}
  SELECT dataset, correct, list_transform(quantile_cont(confidence, [0.1, 0.25, 0.5, 0.75, 0.9]), lambda x: round(x, 3))
    AS quantiles FROM crc WHERE choice <> {Q.q(K.NONE_OPTION)} GROUP BY dataset, correct""")
def q_d29(spark, sf_dir):
    r = conf_rows(spark, sf_dir).filter(F.col("choice") != K.NONE_OPTION)
    return ST.quantiles(r, "confidence", ["dataset", "correct"])


def _sweep_sql():
    parts = []
    for t in K.CONFIDENCE_THRESHOLDS:
        acc = f"(choice <> {Q.q(K.NONE_OPTION)} AND confidence >= {Q.dbl(t)})"
        parts.append(f"""SELECT dataset, {Q.dbl(t)} AS threshold,
          round(count(*) FILTER (WHERE {acc}) / count(*), 3) AS auto_accepted,
          CASE WHEN count(*) FILTER (WHERE {acc}) > 0 THEN round(count(*) FILTER (WHERE {acc} AND correct)
            / count(*) FILTER (WHERE {acc}), 3) END AS precision_of_accepted,
          round((count(*) FILTER (WHERE {acc}) - count(*) FILTER (WHERE {acc} AND correct)) / count(*), 3)
            AS wrong_accepts_of_all_rows,
          round(1 - count(*) FILTER (WHERE {acc}) / count(*), 3) AS escalated FROM crc GROUP BY dataset""")
    return f"WITH {CONF_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("d30_threshold_sweep", _sweep_sql())
def q_d30(spark, sf_dir):
    r = conf_rows(spark, sf_dir)
    return ST.threshold_sweep(r, F.col("choice") != K.NONE_OPTION, "confidence", "correct", group=["dataset"])


@register("d12_macro_f1", f"""WITH {CONF_SQL},
  c AS (SELECT gold AS label, (choice = gold)::INT AS tp, 0 AS fp, (choice <> gold)::INT AS fn FROM crc
        UNION ALL SELECT choice, 0, (choice <> gold)::INT, 0 FROM crc),
  per AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY label)
  SELECT round(coalesce(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END), 0.0), 6)
    AS category_macro_f1 FROM per""")
def q_d12(spark, sf_dir):
    r = conf_rows(spark, sf_dir)
    pred = r.select(F.col("doc_id").alias("txn_id"), F.col("choice").alias("category"))
    gold = r.select(F.col("doc_id").alias("txn_id"), F.col("gold").alias("category"))
    return _round6(M.macro_f1(pred, gold), ["category_macro_f1"])


@register("d22_d23_binomial_invalid", f"""WITH {CONF_SQL}
  SELECT dataset, round(avg(correct::INT), 6) AS accuracy,
    round(1.96 * sqrt(avg(correct::INT) * (1 - avg(correct::INT)) / count(*)), 6) AS half_width,
    count(*) FILTER (WHERE choice NOT IN ('high', 'low')) AS invalid FROM crc GROUP BY dataset""")
def q_d22(spark, sf_dir):
    r = conf_rows(spark, sf_dir)
    return (r.groupBy("dataset").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"),
                                     F.count(F.lit(1)).alias("_n"),
                                     F.count_if(~F.col("choice").isin("high", "low")).alias("invalid"))
            .select("dataset", F.round("accuracy", 6).alias("accuracy"),
                    F.round(ST.binomial_halfwidth(F.col("accuracy"), F.col("_n")), 6).alias("half_width"), "invalid"))


# ------------------------------------------------------------------ vectors on embeddings
@register("c8_nearest_centroid", """WITH emb AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
      generate_subscripts(embedding, 1) AS i FROM embeddings),
  cent AS (SELECT label::VARCHAR AS cand, i, avg(v) AS c FROM emb GROUP BY label, i),
  dots AS (SELECT e.vec_id, c.cand, sum(e.v * c.c) AS dot FROM emb e JOIN cent c ON e.i = c.i GROUP BY e.vec_id, c.cand),
  qn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM emb GROUP BY vec_id),
  cn AS (SELECT cand, sqrt(sum(c * c)) AS n FROM cent GROUP BY cand),
  sc AS (SELECT d.vec_id, d.cand, d.dot / (q.n * c.n) AS cos FROM dots d JOIN qn q USING (vec_id) JOIN cn c USING (cand))
  SELECT e.vec_id, e.label, s.pred FROM (SELECT DISTINCT vec_id, label FROM emb) e JOIN
    (SELECT vec_id, arg_min(cand, (-cos, cand)) AS pred FROM sc GROUP BY vec_id) s USING (vec_id)""")
def q_c8(spark, sf_dir):
    from merchantry.operators.vectors import centroids, nearest_vector
    from merchantry.plans.testdata import table
    e = table(spark, sf_dir, "embeddings")
    vocab = centroids(e.select(F.col("label").cast("string").alias("name"), F.col("embedding").alias("vec")),
                      "vec", "name")
    near = nearest_vector(e.select(F.col("vec_id"), F.col("embedding").alias("vec")), vocab, id_col="vec_id")
    return e.select("vec_id", "label").join(near.select("vec_id", F.col("name").alias("pred")), "vec_id")


# ------------------------------------------------------------------ rules route, fuzzy joins
from merchantry.operators.fuzzy import fuzzy_top1  # noqa: E402
from merchantry.operators.routes import RulesRoute, candidates, query_text  # noqa: E402,F401


def _rules(spark, sf_dir, split="random"):
    key = ("rules", _sid(spark), sf_dir, split)
    if key not in _CACHE:
        v = _views(spark, sf_dir, split)
        _CACHE[key] = RulesRoute().fit(v.train_feed, v.train_gold)
    return _CACHE[key]


@register("r3_rules_preds_random")
def q_r3(spark, sf_dir):
    v = _views(spark, sf_dir)
    return _rules(spark, sf_dir).transform(v.eval_feed)


@register("c5_fuzzy_top1_random")
def q_c5(spark, sf_dir):
    v = _views(spark, sf_dir)
    q = v.eval_feed.select(query_text("description").alias("query"))
    return fuzzy_top1(q, _rules(spark, sf_dir).names)


@register("c6_candidates_model_view")
def q_c6(spark, sf_dir):
    v = _views(spark, sf_dir)
    names = _rules(spark, sf_dir).names.filter(F.col("kind") == "merchant")
    return candidates(v.model_feed, names)


@register("d16_retrieval_recall")
def q_d16(spark, sf_dir):
    v = _views(spark, sf_dir)
    names = _rules(spark, sf_dir).names.filter(F.col("kind") == "merchant")
    c = candidates(v.model_feed, names).join(
        v.model_gold.select("txn_id", F.col("canonical_merchant").alias("gold")), "txn_id")
    return M.retrieval_recall(c.filter(F.col("gold").isNotNull()))


def leaderboard(spark, sf_dir, split: str = "random"):
    """D37/D36/R11/R12 for one split: cleaner and rules routes, model and ideal-cache
    views (operators.evaluate)."""
    from merchantry.operators.evaluate import evaluate
    v = _views(spark, sf_dir, split)
    pre = {}
    if split == "random":
        pre[("rules", split)] = _route_preds(spark, sf_dir, "rules_model")
    else:
        pre[("rules", split)] = materialize(_rules(spark, sf_dir, split).transform(v.model_feed),
                                            f"preds_rules_{split}")
    return evaluate({split: v}, {"cleaner": CleanerRoute, "rules": RulesRoute}, write=materialize, preds=pre, n_boot=N_BOOT_Q)


@register("d37_leaderboard_random")
def q_d37(spark, sf_dir):
    return leaderboard(spark, sf_dir, "random")


@register("d37_leaderboard_unseen")
def q_d37u(spark, sf_dir):
    return leaderboard(spark, sf_dir, "unseen")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules route fitted on the random split's train rows, applied to the held-out rows,
    then spend rolled up per customer and predicted merchant (D1)."""
    v = _views(spark, sf_dir)
    pred = _rules(spark, sf_dir).transform(v.eval_feed)
    rows = v.eval_feed.select("txn_id", "customer_id", "amount").join(
        pred.select("txn_id", "canonical_merchant"), "txn_id")
    return AG.rollup_by_merchant(rows)


register("flagship_rules_rollup")(flagship)


# ------------------------------------------------------------------ streaming
from merchantry.streaming import cache as SC  # noqa: E402


def _stream_source(spark, sf_dir):
    key = ("stream_src", _sid(spark), sf_dir)
    if key not in _CACHE:
        feed = fg(spark, sf_dir)[0]
        _CACHE[key] = (SC.write_stream_source(feed), feed.schema)
    return _CACHE[key]


def _s1(spark, sf_dir):
    key = ("s1", _sid(spark), sf_dir)
    if key not in _CACHE:
        src, schema = _stream_source(spark, sf_dir)
        # files arrive in date order, so any batch size keeps the batch-order semantics of E1
        _CACHE[key] = SC.descriptor_cache_stream(spark, src, schema, max_files=5)
    return _CACHE[key]


@register("s1_descriptor_cache_stream", W(NEW_SQL))
def q_s1(spark, sf_dir):
    return _s1(spark, sf_dir).select("txn_id", "is_new")


@register("s2_hit_rate_windows_stream", W(f"""SELECT f.posted_date AS window_start,
  round(avg((NOT n.is_new)::INT), 3) AS hit_rate, count(*) AS n
  FROM feed f JOIN ({NEW_SQL}) n USING (txn_id) GROUP BY f.posted_date"""))
def q_s2(spark, sf_dir):
    flags = _s1(spark, sf_dir)
    src = SC.write_stream_source(flags, name="flags")
    SC.end_source(src, flags, after_days=4)     # one window and the watermark's delay later
    return SC.hit_rate_stream(spark, src, flags.schema, max_files=5)


@register("s3_spend_rollup_stream", W("""SELECT posted_date AS day, customer_id, canonical_merchant,
    round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS total_spend, count(*) AS txn_count
  FROM feed JOIN gold USING (txn_id) GROUP BY ALL"""))
def q_s3(spark, sf_dir):
    labelled = wide(spark, sf_dir).select("txn_id", "posted_date", "customer_id", "canonical_merchant", "amount")
    src = SC.write_stream_source(labelled, name="labelled")
    return SC.spend_rollup_stream(spark, src, labelled.schema, lambda s: s, max_files=5)


@register("s4_enrich_stream")
def q_s4(spark, sf_dir):
    src, schema = _stream_source(spark, sf_dir)
    return SC.enrich_batches(spark, src, schema, _rules(spark, sf_dir), max_files=5)


# ------------------------------------------------------------------ more scalar functions
from merchantry.functions import synth as SY  # noqa: E402
from merchantry.functions import labels as LB  # noqa: E402
from merchantry.functions import prompts as PR  # noqa: E402


@register("b9_b10_direction_type_code", W(f"""SELECT txn_id,
    CASE WHEN amount > 0 THEN 'incoming' ELSE 'outgoing' END AS direction,
    {Q.type_code('payment_method', "CASE WHEN amount > 0 THEN 'incoming' ELSE 'outgoing' END")} AS type_code
  FROM feed"""))
def q_b9(spark, sf_dir):
    f = fg(spark, sf_dir)[0]
    d = SY.direction("amount")
    return f.select("txn_id", d.alias("direction"), SY.type_code(F.col("payment_method"), d).alias("type_code"))


@register("b18_zipf_draws", W(f"""SELECT f.txn_id, z.k AS rank FROM
  (SELECT txn_id, least({K.LOCATIONS_CAP}, ceil(count(*) OVER (PARTITION BY customer_id) / {K.LOCATIONS_ROWS_PER}))::BIGINT AS n,
          {Q.hash52(Q.hkey('zipf', Sql('txn_id')))} AS h FROM feed) f
  JOIN _zipf_loc z ON f.n = z.n AND f.h % z.total >= z.lo AND f.h % z.total < z.hi"""))
def q_b18(spark, sf_dir):
    """A Zipf(1.5) rank per feed row over min(200, ceil(rows of its customer / 3))."""
    from merchantry.operators.synth import zipf_pick, zipf_table
    from merchantry.operators.windows import count_per_key
    f = count_per_key(fg(spark, sf_dir)[0].select("txn_id", "customer_id"), "customer_id", "_rows")
    f = f.withColumn("_n", F.least(F.lit(K.LOCATIONS_CAP), F.ceil(F.col("_rows") / K.LOCATIONS_ROWS_PER)).cast("bigint"))
    z = zipf_pick(f, "_n", hkey("zipf", F.col("txn_id")), "rank", zipf_table(spark, K.LOCATIONS_CAP, K.LOCATIONS_ZIPF_S))
    return z.select("txn_id", "rank")


@register("b22_accepted_names", W(f"""SELECT canonical_merchant, list_sort(list_distinct(list_filter(
    [{Q.norm_merchant('canonical_merchant')}, CASE WHEN coalesce({Q.same_line('canonical_merchant')}, FALSE)
      THEN {Q.norm_merchant(Q.parent_of('canonical_merchant'))} END], lambda x: x IS NOT NULL AND x <> ''))) AS accepted
  FROM (SELECT DISTINCT canonical_merchant FROM gold WHERE canonical_merchant IS NOT NULL)"""))
def q_b22(spark, sf_dir):
    g = fg(spark, sf_dir)[1].select("canonical_merchant").filter(F.col("canonical_merchant").isNotNull()).distinct()
    return g.select("canonical_merchant", F.array_sort(LB.accepted_names(F.col("canonical_merchant"))).alias("accepted"))


@register("b23_prompts_model_view", W(
    "SELECT txn_id, " + Q.q(PR.FEWSHOT_HEAD + "Allowed categories: " + ", ".join(K.CATEGORIES) + "\n" + PR.FEWSHOT
                            + 'Now do this one. Description: "') + " || "
    + Q.strip_processor_prefix("description") + " || " + Q.q('"\n' + PR.REPLY_RULE) + " AS prompt FROM model",
    _views_sql(RANDOM_MEM_SQL)))
def q_b23(spark, sf_dir):
    m = _views(spark, sf_dir).model_feed
    return m.select("txn_id", PR.build_prompt(TX.strip_processor_prefix("description")).alias("prompt"))


@register("b30_headline_rows", W("""SELECT txn_id FROM gold
  WHERE NOT (coalesce(origin = 'local', FALSE) AND coalesce(noise_abbrev, FALSE))"""))
def q_b30(spark, sf_dir):
    g = fg(spark, sf_dir)[1]
    return g.filter(F.coalesce(LB.headline_keep(F.col("origin"), F.col("noise_abbrev")), F.lit(True))).select("txn_id")


@register("b34_letter_counts", W(
    "SELECT canonical_merchant, [" + ", ".join(
        f"(length(lower(canonical_merchant)) - length(replace(lower(canonical_merchant), '{c}', '')))::FLOAT"
        for c in "abcdefghijklmnopqrstuvwxyz") + "] AS vec FROM (SELECT DISTINCT canonical_merchant FROM gold "
    "WHERE canonical_merchant IS NOT NULL)"))
def q_b34(spark, sf_dir):
    g = fg(spark, sf_dir)[1].select("canonical_merchant").filter(F.col("canonical_merchant").isNotNull()).distinct()
    return g.select("canonical_merchant", TX.letter_counts("canonical_merchant").alias("vec"))


@register("h1_local_merchants", O.with_feed("SELECT name, category, rank::INTEGER AS rank FROM _locals"))
def q_h1(spark, sf_dir):
    from merchantry.operators.synth import local_merchants
    # labels before reassignment: source merchants + types (locals never share their tokens)
    raw = raw_labelled(spark, sf_dir)
    canon = raw.select(TX.derive_canonical("transaction_description").alias("c"), "category")
    gm = canon.select(LB.gold_merchant(F.col("c"), F.col("category")).alias("g"))
    labels = gm.select(F.coalesce("g.merchant", "g.txn_type").alias("label")).distinct()
    return local_merchants(spark, labels)


# ------------------------------------------------------------------ D18, D24, D26, D41
@register("d18_cluster_bootstrap_cleaner", W(f"""
  SELECT round((q_c[2] - q_c[1]) / 2, 3) AS category, round((q_m[2] - q_m[1]) / 2, 3) AS merchant_norm FROM (
    SELECT quantile_cont(cat, [0.025, 0.975]) AS q_c, quantile_cont(m, [0.025, 0.975]) AS q_m FROM (
      SELECT b, sum(cnt * cat_sum) / greatest(1.0, sum(cnt * n_all)) AS cat,
                sum(cnt * m_sum) / greatest(1.0, sum(cnt * n_m)) AS m
      FROM cnt JOIN idx USING (idx) GROUP BY b))""", [
    f"p AS ({CLEANER_PRED})",
    f"""j AS (SELECT coalesce(g.canonical_merchant, g.txn_type, '?') AS cluster,
          FALSE AS cat_ok, g.canonical_merchant IS NOT NULL AS has_m,
          {Q.merchant_ok('p.canonical_merchant', 'g.canonical_merchant', 'FALSE')} AS m_ok
        FROM p JOIN gold g USING (txn_id))""",
    """sums AS (SELECT cluster, sum(cat_ok::INT)::DOUBLE AS cat_sum, count(*)::DOUBLE AS n_all,
          sum((m_ok AND has_m)::INT)::DOUBLE AS m_sum, sum(has_m::INT)::DOUBLE AS n_m FROM j GROUP BY cluster)""",
    f"bk AS (SELECT *, {Q.hash52(Q.hkey('bucket', Sql('cluster')))} % 64 AS _bk FROM sums)",
    """off AS (SELECT _bk, coalesce(sum(count(*)) OVER (ORDER BY _bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS _off FROM bk GROUP BY _bk)""",
    """idx AS (SELECT bk.*, off._off + row_number() OVER (PARTITION BY bk._bk ORDER BY cluster) - 1 AS idx
          FROM bk JOIN off USING (_bk))""",
    "kk AS (SELECT count(*) AS k FROM sums)",
    f"""draws AS (SELECT range // (SELECT k FROM kk) AS b,
          {Q.hash52(Q.hkey('0', 'boot', Sql('range::VARCHAR')))} % (SELECT k FROM kk) AS idx
          FROM range(0, {N_BOOT_Q} * (SELECT k FROM kk)))""",
    "cnt AS (SELECT b, idx, count(*) AS cnt FROM draws GROUP BY b, idx)"]))
def q_d18(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    p = CleanerRoute().transform(feed)
    j = p.select("txn_id", F.col("canonical_merchant").alias("p_m")).join(gold, "txn_id")
    m_ok = merchant_ok(F.col("p_m"), F.col("canonical_merchant"), F.lit(False))
    return ST.cluster_bootstrap_ci(j, F.lit(False), m_ok, F.col("canonical_merchant").isNotNull(),
                                   LB.cluster_key(F.col("canonical_merchant"), F.col("txn_type")),
                                   n_boot=N_BOOT_Q, seed=0)


DESC_SQL = f"""ds AS (SELECT f.description, count(*) AS n, sum(abs(f.amount)) AS spend,
    arg_min(g.canonical_merchant, f.txn_id) AS canonical_merchant,
    bool_and({Q.merchant_ok(Q.derive_canonical(Q.strip_processor_prefix('f.description')), 'g.canonical_merchant', 'FALSE')}) AS ok
  FROM feed f JOIN gold g USING (txn_id) WHERE g.canonical_merchant IS NOT NULL GROUP BY f.description)"""


def _desc_scores(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    j = feed.join(gold.select("txn_id", "canonical_merchant"), "txn_id").filter(F.col("canonical_merchant").isNotNull())
    pred = TX.derive_canonical(TX.strip_processor_prefix("description"))
    j = j.withColumn("_ok", merchant_ok(pred, F.col("canonical_merchant"), F.lit(False)))
    return j.groupBy("description").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("spend"),
                                        F.min_by("canonical_merchant", "txn_id").alias("canonical_merchant"),
                                        F.bool_and("_ok").alias("ok"))


@register("d24_weighted_scores", W("""SELECT round(avg(ok::INT), 6) AS "distinct",
    round(sum(ok::INT * n) / nullif(sum(n), 0), 6) AS row_weighted,
    round((SELECT avg(mm) FROM (SELECT avg(ok::INT) AS mm FROM ds GROUP BY canonical_merchant)), 6) AS macro_merchant,
    round(sum(ok::INT * spend) / nullif(sum(spend), 0.0), 6) AS spend_weighted,
    round((sum(ok::INT * spend) - (SELECT arg_max(ok::INT * spend, spend) FROM ds))
      / nullif(sum(spend) - (SELECT max(spend) FROM ds), 0.0), 6) AS spend_weighted_no_top FROM ds""", [DESC_SQL]))
def q_d24(spark, sf_dir):
    return _round6(M.weighted_scores(_desc_scores(spark, sf_dir)),
                   ["distinct", "row_weighted", "macro_merchant", "spend_weighted", "spend_weighted_no_top"])


@register("d26_top_descriptor_share", W("""SELECT arg_max(description, (spend, description)) AS top_description,
    round(max(spend) / sum(spend), 6) AS top_share FROM ds""", [DESC_SQL]))
def q_d26(spark, sf_dir):
    d = _desc_scores(spark, sf_dir)
    return d.agg(F.max_by("description", F.struct("spend", "description")).alias("top_description"),
                 F.round(F.max("spend") / F.sum("spend"), 6).alias("top_share"))


@register("d41_busiest_customer_spend", W(f"""
  SELECT canonical_merchant, gold_spend, coalesce(pred_spend, 0.0) AS pred_spend FROM
   (SELECT g.canonical_merchant, round(sum(abs(f.amount)::DECIMAL(18,2)), 2)::DOUBLE AS gold_spend FROM feed f
      JOIN gold g USING (txn_id) WHERE f.customer_id = (SELECT c FROM busy) AND g.canonical_merchant IS NOT NULL
      GROUP BY ALL) gs
   LEFT JOIN (SELECT p.canonical_merchant, round(sum(abs(f.amount)::DECIMAL(18,2)), 2)::DOUBLE AS pred_spend
      FROM feed f JOIN p USING (txn_id) WHERE f.customer_id = (SELECT c FROM busy) GROUP BY ALL) ps
   USING (canonical_merchant)""", [
    f"p AS ({CLEANER_PRED})",
    "busy AS (SELECT arg_min(customer_id, (-n, customer_id)) AS c FROM (SELECT customer_id, count(*) AS n FROM feed GROUP BY customer_id))"]))
def q_d41(spark, sf_dir):
    feed, gold = fg(spark, sf_dir)
    cust = AG.busiest(feed).first()["customer_id"]
    return AG.customer_spend_compare(feed, gold, CleanerRoute().transform(feed), cust)


# ------------------------------------------------------------------ more routes (R2, R4-R9, R13, R14) and reports
from merchantry.operators import reports as RP  # noqa: E402
from merchantry.operators.routes import (ChoiceRoute, EmbeddingRoute, GeneratorRoute,  # noqa: E402
                                         MetadataRoute, cascade)
from merchantry.plans.stand_in_models import echo_generator, first_candidate_chooser  # noqa: E402


def _route_preds(spark, sf_dir, name):
    key = ("route", name, _sid(spark), sf_dir)
    if key not in _CACHE:
        v = _views(spark, sf_dir)
        if name == "metadata":
            r = MetadataRoute().fit(v.train_feed, v.train_gold).transform(v.eval_feed)
        elif name == "embedding":
            r = EmbeddingRoute().fit(v.train_feed, v.train_gold).transform(v.model_feed)
        elif name == "generator":
            r = GeneratorRoute(echo_generator).fit(v.train_feed, v.train_gold).transform(v.model_feed)
        elif name == "finetuned":
            r = (GeneratorRoute(echo_generator, prompt_fn=PR.finetune_prompt, strip_prefix=False, name="finetuned")
                 .fit(v.train_feed, v.train_gold).transform(v.model_feed))
        elif name == "choice":
            r = ChoiceRoute(first_candidate_chooser).fit(v.train_feed, v.train_gold).transform(v.model_feed)
        elif name == "choice_generator":
            r = (ChoiceRoute(first_candidate_chooser, fallback=GeneratorRoute(echo_generator))
                 .fit(v.train_feed, v.train_gold).transform(v.model_feed))
        elif name == "rules_model":
            r = _rules(spark, sf_dir).transform(v.model_feed)
        _CACHE[key] = materialize(r, f"preds_{name}")
    return _CACHE[key]


@register("r2_metadata_preds")
def q_r2(spark, sf_dir):
    return _route_preds(spark, sf_dir, "metadata")


@register("r4_embedding_preds")
def q_r4(spark, sf_dir):
    return _route_preds(spark, sf_dir, "embedding")


@register("r5_generator_preds")
def q_r5(spark, sf_dir):
    return _route_preds(spark, sf_dir, "generator")


@register("r6_choice_preds")
def q_r6(spark, sf_dir):
    return _route_preds(spark, sf_dir, "choice")


@register("r7_choice_then_generator")
def q_r7(spark, sf_dir):
    return _route_preds(spark, sf_dir, "choice_generator")


@register("r9_finetuned_generator_preds")
def q_r9(spark, sf_dir):
    return _route_preds(spark, sf_dir, "finetuned")


@register("r8_fuzzy_else_generator")
def q_r8(spark, sf_dir):
    rules = _route_preds(spark, sf_dir, "rules_model")
    gen = _route_preds(spark, sf_dir, "generator")
    return cascade(rules, gen, ~F.col("f_no_match"), cols=("canonical_merchant", "category"))


def _gold_model(spark, sf_dir):
    return _views(spark, sf_dir).model_gold


@register("d32_cascade_sweep")
def q_d32(spark, sf_dir):
    ch = _route_preds(spark, sf_dir, "choice")
    gen = _route_preds(spark, sf_dir, "generator").select("txn_id", F.col("canonical_merchant").alias("fallback"))
    g = _gold_model(spark, sf_dir).select("txn_id", F.col("canonical_merchant").alias("gold"))
    d = (RP.pair_routes(ch.select("txn_id", F.coalesce("canonical_merchant", F.lit(K.NONE_OPTION)).alias("choice"),
                                  F.col("choice_confidence").alias("confidence"), "candidates"), gen)
         .join(g, "txn_id").filter(F.col("gold").isNotNull())
         .withColumn("in_list", F.array_contains(F.transform("candidates", lambda c: TX.norm_merchant(c)),
                                                 TX.norm_merchant("gold"))))
    return RP.cascade_sweep(d, lambda p: merchant_ok(p, F.col("gold")), in_list="in_list")


@register("d33_r13_category_routing")
def q_d33(spark, sf_dir):
    ch = _route_preds(spark, sf_dir, "choice").select("txn_id", F.col("category").alias("choice_cat"), "none")
    emb = _route_preds(spark, sf_dir, "embedding").select("txn_id", F.col("category").alias("embedding_cat"))
    g = _gold_model(spark, sf_dir).select("txn_id", F.col("category").alias("gold"), "origin")
    d = RP.pair_routes(ch, emb).join(g, "txn_id").withColumn(
        "rule", F.when(F.col("none"), F.col("choice_cat")).otherwise(F.col("embedding_cat")))
    d = d.withColumn("answer", F.when(F.col("none"), "none_of_these").otherwise("picked")).withColumn(
        "origin", F.coalesce("origin", F.lit("no merchant")))
    return RP.routing_summary(d, ["embedding_cat", "choice_cat", "rule"], "gold", ["answer", "origin"])


@register("d34_gate_separation")
def q_d34(spark, sf_dir):
    v = _views(spark, sf_dir)
    rules = _route_preds(spark, sf_dir, "rules_model").select("txn_id", "no_match")
    emb = _route_preds(spark, sf_dir, "embedding").select("txn_id", "cosine")
    ch = _route_preds(spark, sf_dir, "choice").select("txn_id", "none")
    gen = _route_preds(spark, sf_dir, "generator").select("txn_id", F.col("canonical_merchant").alias("gen"))
    g = v.model_gold.select("txn_id", F.col("canonical_merchant").alias("gold")).filter(F.col("gold").isNotNull())
    listed = AG.seen_at_least(v.train_gold.filter(F.col("canonical_merchant").isNotNull()), "canonical_merchant", 2)
    d = (g.join(rules, "txn_id").join(emb, "txn_id").join(ch, "txn_id").join(gen, "txn_id")
         .join(listed.select(F.col("canonical_merchant").alias("gold"), F.lit(True).alias("_listed")), "gold", "left"))
    return RP.gate_separation(d, {"choice_none": F.col("none"), "fuzzy_below_85": F.col("no_match"),
                                  "embedding_below_0.6": F.coalesce(F.col("cosine"), F.lit(0.0)) < 0.6,
                                  "embedding_below_0.7": F.coalesce(F.col("cosine"), F.lit(0.0)) < 0.7},
                              F.col("_listed").isNull(), merchant_ok(F.col("gen"), F.col("gold")))


@register("d35_r16_significance_report")
def q_d35(spark, sf_dir):
    v = _views(spark, sf_dir)
    g = v.model_gold.select("txn_id", F.col("canonical_merchant").alias("gold"), F.col("category").alias("gcat"),
                            "txn_type")
    def ok_of(name, col="ok"):
        p = _route_preds(spark, sf_dir, name)
        return p.join(g, "txn_id").select(
            "txn_id", merchant_ok(F.col("canonical_merchant"), F.col("gold"),
                                  LB.category_ok(F.col("category"), F.col("gcat"))).alias(col),
            LB.cluster_key(F.col("gold"), F.col("txn_type")).alias("cluster"))
    rules, gen = ok_of("rules_model", "a"), ok_of("generator", "b")
    emb, ch = ok_of("embedding", "a"), ok_of("choice", "b")
    comps = [{"name": "rules_minus_generator_merchant", "df": RP.pair_routes(rules, gen.drop("cluster"), "txn_id"),
              "a": "a", "b": "b", "cluster": "cluster"},
             {"name": "embedding_minus_choice_merchant", "df": RP.pair_routes(emb, ch.drop("cluster"), "txn_id"),
              "a": "a", "b": "b", "cluster": "cluster"},
             # the reference also compares against a real-statement run; no such input here
             {"name": "cascade_minus_generator_real_statement", "df": None}]
    return RP.significance_report(comps, n_boot=N_BOOT_Q)


@register("d31_confidence_summary", f"""WITH {CONF_SQL}
  SELECT dataset, setting, count(*) AS rows, round(avg((gold IN ('high', 'low'))::INT), 3) AS gold_in_list,
    round(avg((choice = {Q.q(K.NONE_OPTION)})::INT), 3) AS picked_none,
    count(*) FILTER (WHERE choice <> {Q.q(K.NONE_OPTION)} AND correct) AS accepted_right,
    count(*) FILTER (WHERE choice <> {Q.q(K.NONE_OPTION)} AND NOT correct) AS accepted_wrong
  FROM crc GROUP BY dataset, setting""")
def q_d31(spark, sf_dir):
    r = conf_rows(spark, sf_dir).withColumn("gold_in_list", F.col("gold").isin("high", "low"))
    return RP.confidence_summary(r)


@register("r14_external_category_benchmark")
def q_r14(spark, sf_dir):
    """R14 on documents: keep-first dedupe of texts, a hash-sampled test set, the rest as
    train; an embedding-style classifier (letter counts + logistic regression)
    predicts the language; accuracy, macro-F1, McNemar against a majority baseline,
    binomial half-width and invalid answers."""
    from merchantry.plans.testdata import table
    from merchantry.operators.splits import split_random
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector
    from merchantry.operators.routes import _logreg
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    firsts = AG.first_per_group(docs, "text", "doc_id", ["lang"])
    mem = split_random(firsts.withColumnRenamed("doc_id", "txn_id"))
    d = firsts.join(mem.withColumnRenamed("txn_id", "doc_id"), "doc_id").withColumn(
        "features", array_to_vector(TX.letter_counts("text")))
    train, test = d.filter(~F.col("is_eval")), d.filter("is_eval")
    model = Pipeline(stages=[StringIndexer(inputCol="lang", outputCol="label_idx"), _logreg(train.count())]).fit(train)
    pred = IndexToString(inputCol="prediction", outputCol="pred", labels=model.stages[0].labels).transform(
        model.transform(test))
    major = AG.global_majority(train.withColumnRenamed("lang", "category")).first()[0]
    p = pred.select(F.col("doc_id").alias("txn_id"), F.col("pred").alias("category"),
                    F.lit(major).alias("base"), F.col("lang").alias("gold"))
    acc = p.agg(F.avg((F.col("category") == F.col("gold")).cast("double")).alias("accuracy"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(~F.col("category").isin("en", "de", "fr", "es")).alias("invalid"))
    f1 = M.macro_f1(p.select("txn_id", "category"), p.select("txn_id", F.col("gold").alias("category")))
    mc = ST.mcnemar(p, F.col("category") == F.col("gold"), F.col("base") == F.col("gold"))
    a, f, m = acc.first(), f1.first()[0], mc.first()
    return spark.createDataFrame([(a["accuracy"], f, a["n"], a["invalid"], m["only_a"], m["only_b"], m["p_value"])],
                                 "accuracy double, macro_f1 double, n long, invalid long, only_model long, "
                                 "only_majority long, mcnemar_p double").withColumn(
        "half_width", ST.binomial_halfwidth(F.col("accuracy"), F.col("n")))


@register("a5_a6_saved_preds_roundtrip")
def q_a5(spark, sf_dir):
    from merchantry.sources import contracts as C
    from merchantry.session import ensure_checkpoint_dir
    import uuid
    v = _views(spark, sf_dir)
    preds = _route_preds(spark, sf_dir, "rules_model")
    m = C.build_manifest(seed=K.SEED, feed=C.fingerprint_str(fg(spark, sf_dir)[0]),
                         model_view=C.fingerprint_str(v.model_feed.select("txn_id")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/preds-{uuid.uuid4().hex[:8]}"
    C.save_preds(preds, path, m["manifest_hash"], "random", "model", "rules")
    return C.load_preds(spark, path, "random", "model", "rules", m, v.model_feed.select("txn_id"))


@register("a7_a9_fingerprints")
def q_a7(spark, sf_dir):
    from merchantry.sources import contracts as C
    feed, gold = fg(spark, sf_dir)
    fp = C.table_fingerprint(feed).withColumn("table", F.lit("feed"))
    gp = C.table_fingerprint(gold).withColumn("table", F.lit("gold"))
    lp = C.list_fingerprint(gold.filter(F.col("canonical_merchant").isNotNull()), "canonical_merchant").withColumn(
        "table", F.lit("merchant_list"))
    return fp.unionByName(gp).unionByName(lp)


@register("a10_chat_export")
def q_a10(spark, sf_dir):
    from merchantry.sources.io import export_chat_jsonl
    from merchantry.session import ensure_checkpoint_dir
    import uuid
    v = _views(spark, sf_dir)
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chat-{uuid.uuid4().hex[:8]}"
    export_chat_jsonl(v.train_feed, v.train_gold, out)
    return spark.read.text(out)


# ------------------------------------------------------------------ remaining operators
@register("b17_lognormal_amounts", W(f"""SELECT txn_id, round(exp(ln(coalesce({Q.case_map('category', {k: Q.dbl(v) for k, v in K.AMOUNT_MEDIAN.items()})}, 50.0))
    + 0.6 * sqrt(-2.0 * ln(greatest({Q.uniform(Q.hkey(Sql("txn_id"), "n1"))}, 1e-300)))
    * cos(6.283185307179586 * {Q.uniform(Q.hkey(Sql("txn_id"), "n2"))})), 2) AS amount FROM gold"""))
def q_b17(spark, sf_dir):
    g = fg(spark, sf_dir)[1]
    return g.select("txn_id", SY.lognormal_amount(F.col("category"), F.col("txn_id")).alias("amount"))


@register("e6_e7_first_row_and_rows_per_label", W("""SELECT txn_id, min(txn_id) OVER (PARTITION BY label) AS first_index,
    count(*) OVER (PARTITION BY label) AS key_rows
  FROM (SELECT txn_id, coalesce(canonical_merchant, txn_type) AS label FROM gold)"""))
def q_e6(spark, sf_dir):
    g = fg(spark, sf_dir)[1].select("txn_id", F.coalesce("canonical_merchant", "txn_type").alias("label"))
    return WN.count_per_key(WN.first_index(g, "label", "txn_id"), "label").select("txn_id", "first_index", "key_rows")


@register("f6_first_n_by_id", W("SELECT txn_id, description FROM feed ORDER BY txn_id LIMIT 100"))
def q_f6(spark, sf_dir):
    return SP.first_n(fg(spark, sf_dir)[0], 100).select("txn_id", "description")


@register("f10_known_heldout_merchants", W("""SELECT g.txn_id, s.canonical_merchant IS NOT NULL AS known FROM gold g
  LEFT JOIN (SELECT canonical_merchant FROM gold WHERE canonical_merchant IS NOT NULL GROUP BY canonical_merchant
             HAVING count(*) >= 2) s USING (canonical_merchant) WHERE g.canonical_merchant IS NOT NULL"""))
def q_f10(spark, sf_dir):
    g = fg(spark, sf_dir)[1].filter(F.col("canonical_merchant").isNotNull())
    known, held = SP.known_heldout(g, "canonical_merchant", 2)
    return (known.select("txn_id", F.lit(True).alias("known"))
            .unionByName(held.select("txn_id", F.lit(False).alias("known"))))


@register("c15_spend_label_coverage", W("""SELECT round(avg((l.label IS NOT NULL)::INT), 6) AS matched_share,
    round(sum(CASE WHEN l.label IS NOT NULL THEN s.spend ELSE 0 END) / sum(s.spend), 6) AS matched_spend_share
  FROM (SELECT description, round(sum(abs(coalesce(debit, 0.0))::DECIMAL(18,2)), 2)::DOUBLE AS spend
        FROM stmt WHERE type IN ('DEB', 'DD') GROUP BY description) s
  LEFT JOIN (SELECT f.description, min(coalesce(g.canonical_merchant, g.txn_type)) AS label FROM feed f JOIN gold g USING (txn_id)
             WHERE g.origin = 'source' GROUP BY f.description) l USING (description)""", [STATEMENT_SQL]))
def q_c15(spark, sf_dir):
    """Spend per descriptor joined to a label table (here: source-origin gold labels
    per descriptor); share of descriptors and of spend that found a label."""
    feed, gold = fg(spark, sf_dir)
    spend = AG.spend_by_descriptor(statement(feed))
    labels = (wide(spark, sf_dir).filter(F.col("origin") == "source")
              .groupBy("description").agg(F.min(F.coalesce("canonical_merchant", "txn_type")).alias("label")))
    j = spend.join(labels, "description", "left")
    hit = F.col("label").isNotNull()
    return j.agg(F.round(F.avg(hit.cast("double")), 6).alias("matched_share"),
                 F.round(F.sum(F.when(hit, F.col("spend")).otherwise(0.0)) / F.sum("spend"), 6)
                 .alias("matched_spend_share"))


@register("c16_refit_agreement")
def q_c16(spark, sf_dir):
    """A refitted rules route must reproduce the saved predictions row for row
    (null-aware); returns the disagreeing rows (expected: none)."""
    v = _views(spark, sf_dir)
    saved = _route_preds(spark, sf_dir, "rules_model").select("txn_id", F.col("canonical_merchant").alias("saved"))
    refit = RulesRoute().fit(v.train_feed, v.train_gold).transform(v.model_feed).select(
        "txn_id", F.col("canonical_merchant").alias("refit"))
    return saved.join(refit, "txn_id", "full").filter(~F.col("saved").eqNullSafe(F.col("refit")))


@register("c17_gold_in_known_list", W(f"""SELECT m.txn_id, k.key IS NOT NULL AS gold_in_list FROM
  (SELECT g.txn_id, {Q.norm_merchant('g.canonical_merchant')} AS gn FROM model mo JOIN gold g USING (txn_id)
   WHERE g.canonical_merchant IS NOT NULL) m
  LEFT JOIN (SELECT DISTINCT {Q.norm_merchant('g.canonical_merchant')} AS key FROM tf JOIN gold g USING (txn_id)
             WHERE g.canonical_merchant IS NOT NULL) k ON m.gn = k.key""", _views_sql(RANDOM_MEM_SQL)))
def q_c17(spark, sf_dir):
    v = _views(spark, sf_dir)
    known = (v.train_gold.filter(F.col("canonical_merchant").isNotNull())
             .select(TX.norm_merchant("canonical_merchant").alias("gn")).distinct().withColumn("_in", F.lit(True)))
    m = v.model_gold.filter(F.col("canonical_merchant").isNotNull()).select(
        "txn_id", TX.norm_merchant("canonical_merchant").alias("gn"))
    return m.join(known, "gn", "left").select("txn_id", F.coalesce("_in", F.lit(False)).alias("gold_in_list"))


@register("d38_best_route")
def q_d38(spark, sf_dir):
    from merchantry.operators.evaluate import best_route
    return best_route(q_d37(spark, sf_dir))


@register("a11_a12_write_and_extract")
def q_a11(spark, sf_dir):
    """The leaderboard written as JSON; A12: the local-origin rows extracted to
    their own Parquet set; returns the extracted rows read back."""
    from merchantry.sources.io import extract_rows, write_json
    from merchantry.session import ensure_checkpoint_dir
    import uuid
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/out-{uuid.uuid4().hex[:8]}"
    write_json(q_d37(spark, sf_dir), f"{base}/leaderboard")
    return extract_rows(wide(spark, sf_dir), F.col("origin") == "local", f"{base}/local_rows")


@register("r15_statement_benchmark")
def q_r15(spark, sf_dir):
    """R15 on the statement view: per debit descriptor (D25) its gold label (first row,
    D8); a full known list and a realistic one (labels seen in >= 2 descriptors, D27/F10);
    fuzzy top-1 (C5) of each descriptor against each list; scores weighted five ways
    (D24) per list, plus the held-out subset (labels not on the realistic list)."""
    feed = fg(spark, sf_dir)[0]
    w = wide(spark, sf_dir)
    spend = AG.spend_by_descriptor(statement(feed))
    first = AG.first_per_group(w.select("txn_id", "description", "canonical_merchant"), "description", "txn_id",
                               ["canonical_merchant"]).filter(F.col("canonical_merchant").isNotNull())
    d = spend.join(first.select("description", "canonical_merchant"), "description")
    names = (w.filter(F.col("canonical_merchant").isNotNull()).groupBy("canonical_merchant")
             .agg(F.min("txn_id").alias("ord"), F.countDistinct("description").alias("n_desc")))
    full = names.select(TX.clean_description("canonical_merchant").alias("key"),
                        F.col("canonical_merchant").alias("name"), "ord")
    realistic = names.filter(F.col("n_desc") >= 2).select(
        TX.clean_description("canonical_merchant").alias("key"), F.col("canonical_merchant").alias("name"), "ord")
    q = d.withColumn("query", query_text("description"))
    out = None
    for list_name, lst in (("full", full), ("realistic", realistic)):
        best = fuzzy_top1(q.select("query"), lst)
        scored = (q.join(best.select("query", F.col("name").alias("pred")), "query", "left")
                  .withColumn("ok", F.coalesce(merchant_ok(F.col("pred"), F.col("canonical_merchant")), F.lit(False))))
        held = scored.join(realistic.select(F.col("name").alias("canonical_merchant")), "canonical_merchant", "left_anti")
        for subset, df in (("all", scored), ("held_out", held)):
            row = M.weighted_scores(df).select(F.lit(list_name).alias("list"), F.lit(subset).alias("subset"), "*")
            out = row if out is None else out.unionByName(row)
    return out


@register("d39_families_by_origin", W("""SELECT coalesce(g.origin, 'none') AS origin,
    count(DISTINCT g.canonical_merchant) AS merchants, count(DISTINCT f.family) AS families
  FROM gold g LEFT JOIN fam f ON g.canonical_merchant = f.name GROUP BY coalesce(g.origin, 'none')""",
    _families_sql(), recursive=True))
def q_d39f(spark, sf_dir):
    """Merchants and brand families (G5) per origin."""
    g = fg(spark, sf_dir)[1]
    fam = FM.brand_families(g.select(F.col("canonical_merchant").alias("name")))
    j = g.join(fam.withColumnRenamed("name", "canonical_merchant"), "canonical_merchant", "left")
    return (j.groupBy(F.coalesce("origin", F.lit("none")).alias("origin"))
            .agg(F.countDistinct("canonical_merchant").alias("merchants"), F.countDistinct("family").alias("families")))


@register("d37_leaderboard_all_routes_random")
def q_d37_all(spark, sf_dir):
    """R12 over every route family on the random split (model-function routes use the
    deterministic stand-in models)."""
    from merchantry.operators.evaluate import evaluate
    v = _views(spark, sf_dir)
    routes = {
        "cleaner": CleanerRoute, "rules": RulesRoute, "metadata": MetadataRoute, "embedding": EmbeddingRoute,
        "generator": lambda: GeneratorRoute(echo_generator),
        "finetuned": lambda: GeneratorRoute(echo_generator, prompt_fn=PR.finetune_prompt, strip_prefix=False),
        "choice": lambda: ChoiceRoute(first_candidate_chooser),
        "choice_generator": lambda: ChoiceRoute(first_candidate_chooser, fallback=GeneratorRoute(echo_generator)),
    }
    pre = {("rules", "random"): _route_preds(spark, sf_dir, "rules_model")}
    return evaluate({"random": v}, routes, write=materialize, preds=pre)


def _rules_lev_ctes() -> list[str]:
    """SQL twin of RulesRoute(scorer="levenshtein") fitted on the random split's train
    rows and applied to its model view; the predictions are the CTE ``rp``."""
    return _views_sql(RANDOM_MEM_SQL) + [
        "tj AS (SELECT t.txn_id, t.mcc, g.category, g.canonical_merchant, g.txn_type FROM tf t JOIN gold g USING (txn_id))",
        """lab AS (SELECT txn_id, CASE WHEN canonical_merchant IS NOT NULL THEN 'merchant'
                     WHEN txn_type IS NOT NULL THEN 'type' END AS kind,
                     coalesce(canonical_merchant, txn_type) AS name FROM tj)""",
        f"""per AS (SELECT {Q.clean_description('name')} AS key, kind, arg_max(name, txn_id) AS name,
                     min(txn_id) AS first FROM lab WHERE kind IS NOT NULL GROUP BY ALL)""",
        """kl AS (SELECT key, arg_max(name, kind = 'merchant') AS name,
                     min(CASE WHEN kind = 'type' THEN 0 ELSE 1 END) AS ord_k,
                     arg_min(first, (CASE WHEN kind = 'type' THEN 0 ELSE 1 END, first)) AS ord_f FROM per GROUP BY key)""",
        f"""mq AS (SELECT txn_id, mcc, amount, {Q.derive_canonical(Q.strip_processor_prefix('description'))} AS fallback,
                     {Q.clean_description(Q.derive_canonical(Q.strip_processor_prefix('description')))} AS query FROM model)""",
        """sc AS (SELECT q.query, k.name, k.ord_k, k.ord_f,
                     CASE WHEN greatest(length(q.query), length(k.key)) = 0 THEN 100.0
                          ELSE 100.0 * (1.0 - levenshtein(q.query, k.key) / greatest(length(q.query), length(k.key))) END
                     AS score
                   FROM (SELECT DISTINCT query FROM mq) q, kl k)""",
        "best AS (SELECT query, arg_min(name, (-score, ord_k, ord_f)) AS name FROM sc WHERE score >= 85.0 GROUP BY query)",
        """mccp AS (SELECT mcc, arg_min(category, (-n, first)) AS category FROM (
                     SELECT mcc, category, count(*) AS n, min(txn_id) AS first FROM tj WHERE mcc IS NOT NULL GROUP BY ALL)
                   GROUP BY mcc)""",
        """labp AS (SELECT label, arg_min(category, (-n, first)) AS category FROM (
                     SELECT coalesce(canonical_merchant, txn_type) AS label, category, count(*) AS n, min(txn_id) AS first
                     FROM tj WHERE coalesce(canonical_merchant, txn_type) IS NOT NULL GROUP BY ALL) GROUP BY label)""",
        """dflt AS (SELECT arg_min(category, (-n, category)) AS category FROM (
                     SELECT category, count(*) AS n FROM gold WHERE txn_id IN (SELECT txn_id FROM tf) GROUP BY category))""",
        """rp AS (SELECT m.txn_id, coalesce(b.name, m.fallback) AS canonical_merchant,
                     coalesce(mp.category, lp.category, (SELECT category FROM dflt)) AS category,
                     CASE WHEN m.amount > 0 THEN 'incoming' ELSE 'outgoing' END AS direction,
                     b.name IS NULL AS no_match
                   FROM mq m LEFT JOIN best b USING (query)
                   LEFT JOIN mccp mp ON m.mcc = mp.mcc
                   LEFT JOIN labp lp ON coalesce(b.name, m.fallback) = lp.label)""",
    ]


@register("r3_rules_levenshtein_model_view", W("SELECT * FROM rp", _rules_lev_ctes()))
def q_r3_lev(spark, sf_dir):
    """R3 with the U7 Levenshtein scorer: the whole route (known list and its ties, fuzzy
    top-1 at 85, mcc / label priors, majority default, no-match fallback) is then
    expressible in SQL."""
    v = _views(spark, sf_dir)
    return RulesRoute(scorer="levenshtein").fit(v.train_feed, v.train_gold).transform(v.model_feed)


def _kl_sql() -> list[str]:
    """Known list of the random split's train rows (D6) as SQL."""
    return [
        "tj AS (SELECT t.txn_id, g.canonical_merchant, g.txn_type FROM tf t JOIN gold g USING (txn_id))",
        """lab AS (SELECT txn_id, CASE WHEN canonical_merchant IS NOT NULL THEN 'merchant'
                     WHEN txn_type IS NOT NULL THEN 'type' END AS kind,
                     coalesce(canonical_merchant, txn_type) AS name FROM tj)""",
        f"""per AS (SELECT {Q.clean_description('name')} AS key, kind, arg_max(name, txn_id) AS name,
                     min(txn_id) AS first FROM lab WHERE kind IS NOT NULL GROUP BY ALL)""",
        """kl AS (SELECT key, arg_max(name, kind = 'merchant') AS name, arg_max(kind, kind = 'merchant') AS kind,
                     min(CASE WHEN kind = 'type' THEN 0 ELSE 1 END) AS ord_k,
                     arg_min(first, (CASE WHEN kind = 'type' THEN 0 ELSE 1 END, first)) AS ord_f FROM per GROUP BY key)""",
        f"""mq AS (SELECT txn_id, {Q.clean_description(Q.derive_canonical(Q.strip_processor_prefix('description')))}
                     AS query FROM model)""",
        """sc AS (SELECT q.query, k.name, k.ord_k, k.ord_f,
                     CASE WHEN greatest(length(q.query), length(k.key)) = 0 THEN 100.0
                          ELSE 100.0 * (1.0 - levenshtein(q.query, k.key) / greatest(length(q.query), length(k.key))) END
                     AS score
                   FROM (SELECT DISTINCT query FROM mq) q, (SELECT * FROM kl WHERE kind = 'merchant') k)""",
        f"""topk AS (SELECT query, list(name ORDER BY rn) AS candidates FROM (
                     SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord_k, ord_f) AS rn
                     FROM sc) WHERE rn <= {K.TOP_K} GROUP BY query)""",
    ]


def _lev_candidates(spark, sf_dir):
    v = _views(spark, sf_dir)
    names = _rules(spark, sf_dir).names.filter(F.col("kind") == "merchant")
    return candidates(v.model_feed, names, scorer="levenshtein")


@register("c6_candidates_levenshtein_model_view", W(
    "SELECT m.txn_id, t.candidates FROM mq m LEFT JOIN topk t USING (query)",
    _views_sql(RANDOM_MEM_SQL) + _kl_sql()))
def q_c6_lev(spark, sf_dir):
    """C6 with the U7 Levenshtein scorer (score desc, then list order), checked in SQL."""
    return _lev_candidates(spark, sf_dir)


@register("d16_retrieval_recall_levenshtein", W(f"""SELECT coalesce(avg(list_contains(
    list_transform(coalesce(t.candidates, []), lambda c: {Q.norm_merchant('c')}),
    {Q.norm_merchant('g.canonical_merchant')})::INT), 0.0) AS retrieval_recall
  FROM mq m LEFT JOIN topk t USING (query) JOIN gold g USING (txn_id) WHERE g.canonical_merchant IS NOT NULL""",
    _views_sql(RANDOM_MEM_SQL) + _kl_sql()))
def q_d16_lev(spark, sf_dir):
    v = _views(spark, sf_dir)
    c = _lev_candidates(spark, sf_dir).join(
        v.model_gold.select("txn_id", F.col("canonical_merchant").alias("gold")), "txn_id")
    return M.retrieval_recall(c.filter(F.col("gold").isNotNull()))


@register("f3_split_random_exact", W(f"""SELECT txn_id, (row_number() OVER (ORDER BY {ORDER_U}, txn_id) - 1)
    >= (SELECT CAST(floor(0.8 * count(*)) AS BIGINT) FROM feed) AS is_eval FROM feed"""))
def q_f3x(spark, sf_dir):
    """F3 exact: the seeded permutation cut at int(0.8 n), as in the reference."""
    return SP.split_random(fg(spark, sf_dir)[0], exact=True)


@register("d36_view_stats_unseen", W(f"""SELECT count(*) AS n_eval,
    count(*) FILTER (WHERE description IN (SELECT description FROM tdesc)) AS removed_verbatim,
    round((SELECT count(*) FROM cache WHERE cache_hit) / greatest(count(*), 1), 4) AS cache_hit_rate,
    count(*) FILTER (WHERE description IN (SELECT description FROM conf)) AS conflict_eval_rows,
    (SELECT count(*) FROM pool) AS model_view_n, (SELECT count(*) FROM model) AS capped_n FROM ef""",
    _families_sql() + _views_sql(UNSEEN_MEM_SQL), recursive=True))
def q_d36u(spark, sf_dir):
    return _views(spark, sf_dir, "unseen").stats


@register("d37_cleaner_ideal_cache_random", W(f"""
  SELECT count(*) AS n,
    CASE WHEN count(pm) > 0 THEN avg(CASE WHEN gm IS NOT NULL THEN
      ({Q.merchant_ok('pm', 'gm', 'coalesce(pc = gc, FALSE)')})::INT END) END AS merchant_norm,
    CASE WHEN count(pm) > 0 THEN avg(CASE WHEN gm IS NOT NULL THEN coalesce(pm = gm, FALSE)::INT END) END AS merchant_exact,
    avg(coalesce((CASE WHEN amount > 0 THEN 'incoming' ELSE 'outgoing' END) = gd, FALSE)::INT) AS direction_accuracy,
    CASE WHEN count(pc) > 0 THEN avg(coalesce(pc = gc, FALSE)::INT) END AS category_accuracy
  FROM j""", _views_sql(RANDOM_MEM_SQL) + [
    f"p AS (SELECT txn_id, {Q.derive_canonical(Q.strip_processor_prefix('description'))} AS canonical_merchant, "
    "NULL::VARCHAR AS category FROM model)",
    """ip AS (SELECT c.txn_id, CASE WHEN c.cache_hit THEN c.cache_merchant ELSE p.canonical_merchant END AS pm,
                 CASE WHEN c.cache_hit THEN c.cache_category ELSE p.category END AS pc
              FROM cache c LEFT JOIN p ON c.rep_txn_id = p.txn_id)""",
    """j AS (SELECT ip.*, g.canonical_merchant AS gm, g.category AS gc, g.direction AS gd, f.amount
             FROM ip JOIN gold g USING (txn_id) JOIN feed f USING (txn_id))"""]))
def q_d37_clean_ideal(spark, sf_dir):
    """R11/C13/D37 checked in SQL: the cleaner's ideal-cache row (hits take the cached
    train labels, misses the prediction of their representative model-view row)."""
    from merchantry.operators.views import ideal_preds
    v = _views(spark, sf_dir)
    mp = CleanerRoute().transform(v.model_feed)
    ip = ideal_preds(mp, v.cache).join(v.ideal_feed.select("txn_id", "amount"), "txn_id").withColumn(
        "direction", F.when(F.col("amount") > 0, "incoming").otherwise("outgoing"))
    return M.leaderboard_row(ip, v.ideal_gold, "cleaner", "random", "ideal_cache").select(
        "n", "merchant_norm", "merchant_exact", "direction_accuracy", "category_accuracy")


def _rules_lev_preds(spark, sf_dir):
    key = ("rules_lev", _sid(spark), sf_dir)
    if key not in _CACHE:
        v = _views(spark, sf_dir)
        _CACHE[key] = materialize(RulesRoute(scorer="levenshtein").fit(v.train_feed, v.train_gold)
                                  .transform(v.model_feed), "preds_rules_lev")
    return _CACHE[key]


@register("d10_d11_rules_levenshtein_scores", W(f"""
  SELECT count(*) AS n,
    CASE WHEN count(canonical_merchant) > 0 THEN avg(CASE WHEN gm IS NOT NULL THEN
      ({Q.merchant_ok('canonical_merchant', 'gm', 'coalesce(category = gc, FALSE)')})::INT END) END AS merchant_norm,
    CASE WHEN count(canonical_merchant) > 0 THEN avg(CASE WHEN gm IS NOT NULL THEN
      coalesce(canonical_merchant = gm, FALSE)::INT END) END AS merchant_exact,
    avg(coalesce(direction = gd, FALSE)::INT) AS direction_accuracy,
    CASE WHEN count(category) > 0 THEN avg(coalesce(category = gc, FALSE)::INT) END AS category_accuracy,
    avg(no_match::INT) AS no_match_rate
  FROM (SELECT rp.*, g.canonical_merchant AS gm, g.category AS gc, g.direction AS gd FROM rp JOIN gold g USING (txn_id))""",
    _rules_lev_ctes()))
def q_d10_lev(spark, sf_dir):
    """D10/D11/D36 for a route with real category predictions (priors), checked in SQL."""
    v = _views(spark, sf_dir)
    p = _rules_lev_preds(spark, sf_dir)
    row = M.leaderboard_row(p, v.model_gold, "rules_levenshtein", "random", "model")
    rate = p.agg(F.avg(F.col("no_match").cast("double")).alias("no_match_rate"))
    out = row.select("n", "merchant_norm", "merchant_exact", "direction_accuracy", "category_accuracy",
                     F.lit(None).cast("double").alias("no_match_rate"))
    return (out.unionByName(rate, allowMissingColumns=True)
            .agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns]))


@register("d15_subsets_rules_levenshtein", W(f"""
  SELECT subset, avg(ok) AS accuracy, count(*) AS n FROM (
    SELECT unnest(list_filter([
        CASE WHEN NOT coalesce(g.noise_abbrev, FALSE) AND NOT coalesce(g.noise_trunc, FALSE) THEN 'recoverable' END,
        CASE WHEN coalesce(g.noise_abbrev, FALSE) THEN 'abbreviated' END,
        CASE WHEN coalesce(g.noise_trunc, FALSE) THEN 'truncated' END,
        CASE WHEN g.origin IS NOT NULL THEN 'origin:' || g.origin END], lambda t: t IS NOT NULL)) AS subset,
      ({Q.merchant_ok('rp.canonical_merchant', 'g.canonical_merchant', 'coalesce(rp.category = g.category, FALSE)')})::DOUBLE AS ok
    FROM rp JOIN gold g USING (txn_id) WHERE g.canonical_merchant IS NOT NULL) GROUP BY subset""", _rules_lev_ctes()))
def q_d15_lev(spark, sf_dir):
    return M.merchant_subsets(_rules_lev_preds(spark, sf_dir), _views(spark, sf_dir).model_gold)


@register("d14_spend_kpi_rules_levenshtein_ideal", W("""
  SELECT round(coalesce(avg(CASE WHEN total_spend IS NOT NULL THEN abs(total_spend - coalesce(pred_spend, 0.0)) END), 0.0), 6) AS mae,
         round(coalesce(avg(CASE WHEN total_spend IS NOT NULL THEN
           (abs(total_spend - coalesce(pred_spend, 0.0)) / greatest(abs(total_spend), 1e-9) <= 0.01)::INT END), 0.0), 6)
           AS within_tolerance,
         count(*) FILTER (WHERE total_spend IS NULL) AS pred_only_buckets
  FROM merged""", _rules_lev_ctes() + [
    """ip AS (SELECT c.txn_id, CASE WHEN c.cache_hit THEN c.cache_merchant ELSE rp.canonical_merchant END AS pm
              FROM cache c LEFT JOIN rp ON c.rep_txn_id = rp.txn_id)""",
    f"""gm AS (SELECT g.txn_id, {Q.norm_merchant('g.canonical_merchant')} AS m FROM gold g
              WHERE g.canonical_merchant IS NOT NULL AND g.txn_id IN (SELECT txn_id FROM cache))""",
    "base AS (SELECT f.txn_id, f.customer_id, f.amount FROM feed f WHERE f.txn_id IN (SELECT txn_id FROM gm))",
    """groll AS (SELECT customer_id, m, round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS total_spend
              FROM base JOIN gm USING (txn_id) GROUP BY ALL)""",
    f"""proll AS (SELECT customer_id, {Q.norm_merchant('ip.pm')} AS m,
                     round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS pred_spend
              FROM base JOIN ip USING (txn_id) GROUP BY ALL)""",
    "merged AS (SELECT * FROM groll FULL OUTER JOIN proll USING (customer_id, m))"]))
def q_d14_lev(spark, sf_dir):
    """D14 on the ideal-cache view for the rules route (cached labels for hits, the
    representative's prediction for misses)."""
    from merchantry.operators.views import ideal_preds
    v = _views(spark, sf_dir)
    ip = ideal_preds(_rules_lev_preds(spark, sf_dir), v.cache)
    return _round6(M.spend_kpi(v.ideal_feed, ip, v.ideal_gold), ["mae", "within_tolerance"])


# ------------------------------------------------------------------ leaderboard, cascades and benchmarks in full
LEADERBOARD_SQL = f"""SELECT s.*, CASE WHEN s.category_accuracy IS NOT NULL THEN round(f.macro_f1, 6) END AS macro_f1,
    k.kpi_mae, k.kpi_within_1pct, CASE WHEN s.view = 'ideal_cache' THEN round((SELECT avg(cache_hit::INT) FROM cache), 6) END
    AS cache_hit_rate
  FROM (SELECT route, view, count(*) AS n, count(*) FILTER (WHERE head) AS merchant_rows,
      count(*) FILTER (WHERE gm IS NOT NULL AND NOT head) AS headline_excluded,
      CASE WHEN count(pc) > 0 THEN round(avg(coalesce(pc = gc, FALSE)::INT), 6) END AS category_accuracy,
      round(avg(coalesce(pm = gm, FALSE)::INT) FILTER (WHERE head), 6) AS merchant_exact,
      round(avg(ok::INT) FILTER (WHERE head), 6) AS merchant_norm,
      round((count(DISTINCT pm) FILTER (WHERE head) + max((head AND pm IS NULL)::INT)) / (count(DISTINCT description) FILTER (WHERE head)), 6)
        AS dedup_ratio,
      round((count(DISTINCT gm) FILTER (WHERE head)) / (count(DISTINCT description) FILTER (WHERE head)), 6) AS gold_dedup_ratio,
      round(avg(ok::INT) FILTER (WHERE gm IS NOT NULL AND NOT ab AND NOT tr), 6) AS subset_recoverable,
      round(avg(ok::INT) FILTER (WHERE gm IS NOT NULL AND ab), 6) AS subset_abbreviated,
      round(avg(ok::INT) FILTER (WHERE gm IS NOT NULL AND tr), 6) AS subset_truncated,
      round(avg(ok::INT) FILTER (WHERE gm IS NOT NULL AND origin = 'source'), 6) AS subset_source,
      round(avg(ok::INT) FILTER (WHERE gm IS NOT NULL AND origin = 'local'), 6) AS subset_local,
      round(avg(dir_ok::INT), 6) AS direction_accuracy,
      round(avg(nm::INT) FILTER (WHERE gm IS NOT NULL), 4) AS no_match_rate
    FROM jj GROUP BY route, view) s
  JOIN (SELECT route, view, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS macro_f1
    FROM (SELECT route, view, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
        SELECT route, view, gc AS label, (coalesce(pc, '') = gc)::INT AS tp, 0 AS fp, (coalesce(pc, '') <> gc)::INT AS fn FROM jj
        UNION ALL SELECT route, view, coalesce(pc, ''), 0, (coalesce(pc, '') <> gc)::INT, 0 FROM jj)
      GROUP BY ALL) GROUP BY route, view) f USING (route, view)
  LEFT JOIN (SELECT g.route, 'ideal_cache' AS view, round(avg(abs(t - coalesce(p, 0.0))), 6) AS kpi_mae,
      round(avg((abs(t - coalesce(p, 0.0)) / greatest(abs(t), 1e-9) <= 0.01)::INT), 6) AS kpi_within_1pct
    FROM (SELECT route, customer_id, {Q.norm_merchant('gm')} AS m, round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS t
          FROM jj WHERE view = 'ideal_cache' AND gm IS NOT NULL GROUP BY ALL) g
    LEFT JOIN (SELECT route, customer_id, {Q.norm_merchant('pm')} AS m, round(sum(abs(amount)::DECIMAL(18,2)), 2)::DOUBLE AS p
          FROM jj WHERE view = 'ideal_cache' AND gm IS NOT NULL GROUP BY ALL) q USING (route, customer_id, m)
    GROUP BY g.route) k USING (route, view)"""

LEADERBOARD_CTES = [
    f"""mp AS (SELECT 'cleaner' AS route, txn_id, {Q.derive_canonical(Q.strip_processor_prefix('description'))} AS pm,
          NULL::VARCHAR AS pc, NULL::BOOLEAN AS nm FROM model
        UNION ALL SELECT 'rules_levenshtein', txn_id, canonical_merchant, category, no_match FROM rp)""",
    """allp AS (SELECT route, 'model' AS view, txn_id, pm, pc, nm FROM mp
        UNION ALL SELECT r.route, 'ideal_cache', c.txn_id, CASE WHEN c.cache_hit THEN c.cache_merchant ELSE mp.pm END,
          CASE WHEN c.cache_hit THEN c.cache_category ELSE mp.pc END, NULL
        FROM (SELECT DISTINCT route FROM mp) r, cache c LEFT JOIN mp ON mp.route = r.route AND mp.txn_id = c.rep_txn_id)""",
    f"""jj AS (SELECT p.*, g.canonical_merchant AS gm, g.category AS gc, g.origin, f.description, f.customer_id, f.amount,
          coalesce(g.noise_abbrev, FALSE) AS ab, coalesce(g.noise_trunc, FALSE) AS tr,
          (CASE WHEN f.amount > 0 THEN 'incoming' ELSE 'outgoing' END) = g.direction AS dir_ok,
          g.canonical_merchant IS NOT NULL AND NOT (p.view = 'model' AND coalesce(g.origin = 'local', FALSE)
            AND coalesce(g.noise_abbrev, FALSE)) AS head,
          {Q.merchant_ok('p.pm', 'g.canonical_merchant', 'coalesce(p.pc = g.category, FALSE)')} AS ok
        FROM allp p JOIN gold g USING (txn_id) JOIN feed f USING (txn_id))"""]


@register("d37_leaderboard_levenshtein_random", W(LEADERBOARD_SQL, _rules_lev_ctes() + LEADERBOARD_CTES))
def q_d37_lev(spark, sf_dir):
    """D37 with every column but the bootstrap half-widths, for the cleaner and the Levenshtein rules route."""
    from merchantry.operators.evaluate import evaluate
    v = _views(spark, sf_dir)
    board = evaluate({"random": v}, {"cleaner": CleanerRoute, "rules_levenshtein": lambda: RulesRoute(scorer="levenshtein")},
                     write=materialize, preds={("rules_levenshtein", "random"): _rules_lev_preds(spark, sf_dir)})
    return _round6(board.drop("split"), [f.name for f in board.schema.fields if f.dataType.simpleString() == "double"])


@register("d38_best_route_levenshtein", W(f"""SELECT 'random' AS split, arg_max(route, (merchant_norm, route)) AS best_route,
    max(merchant_norm) AS merchant_norm FROM ({LEADERBOARD_SQL}) WHERE view = 'model' AND merchant_norm IS NOT NULL""",
    _rules_lev_ctes() + LEADERBOARD_CTES))
def q_d38_lev(spark, sf_dir):
    from merchantry.operators.evaluate import best_route
    return best_route(q_d37_lev(spark, sf_dir).withColumn("split", F.lit("random")))


def _headline(spark, sf_dir, split="random"):
    """Gold of the headline merchant rows of the model view."""
    g = _views(spark, sf_dir, split).model_gold.filter(F.col("canonical_merchant").isNotNull())
    keep = F.coalesce(LB.headline_keep(F.col("origin"), F.col("noise_abbrev")), F.lit(True))
    return g.filter(keep).select("txn_id", F.col("canonical_merchant").alias("gold"), F.col("category").alias("gcat"))


def _cascade_rows(gold, rules, second):
    """Gold rows with the rules answer, the second route's and the cascade of both (names ending in ``_c`` are categories)."""
    d = (gold.join(rules.select("txn_id", F.col("canonical_merchant").alias("rules"), F.col("category").alias("rules_c"), "no_match"), "txn_id")
         .join(second.select("txn_id", F.col("canonical_merchant").alias("second"), F.col("category").alias("second_c")), "txn_id"))
    return d.withColumn("cascade", LB.cascade_select(~F.col("no_match"), "rules", "second")).withColumn(
        "cascade_c", LB.cascade_select(~F.col("no_match"), "rules_c", "second_c"))


def _right(name):
    return merchant_ok(F.col(name), F.col("gold"), LB.category_ok(F.col(f"{name}_c"), F.col("gcat")))


@register("d35_cascade_summary")
def q_d35_cascade(spark, sf_dir):
    """Rules, generator, rules-else-generator and choice-else-generator on the headline rows."""
    gen, ch = (_route_preds(spark, sf_dir, n) for n in ("generator", "choice_generator"))
    d = _cascade_rows(_headline(spark, sf_dir), _route_preds(spark, sf_dir, "rules_model"), gen)
    d = RP.pair_routes(d, ch.select("txn_id", F.col("canonical_merchant").alias("choice"), F.col("category").alias("choice_c")))
    names = {"rules": "rules", "generator": "second", "cascade": "cascade", "choice_generator": "choice"}
    return RP.cascade_summary(d, {k: _right(c) for k, c in names.items()}, ~F.col("no_match"), F.col("gold"),
                              compare=[("choice_generator", "cascade")], n_boot=N_BOOT_Q)


@register("d35_cascade_summary_levenshtein", W(f"""
  SELECT unnest(['rules', 'nearest', 'cascade']) AS name,
    unnest([round(avg(r::INT), 3), round(avg(n::INT), 3), round(avg(c::INT), 3)]) AS accuracy,
    unnest([round(sum(r::INT * w) / sum(w), 3), round(sum(n::INT * w) / sum(w), 3), round(sum(c::INT * w) / sum(w), 3)]) AS row_weighted,
    count(*) AS rows, round(avg(matched::INT), 3) AS matched_share
  FROM (SELECT NOT rp.no_match AS matched, {Q.merchant_ok('rp.canonical_merchant', 'g.canonical_merchant', 'coalesce(rp.category = g.category, FALSE)')} AS r,
      {Q.merchant_ok('near.name', 'g.canonical_merchant', 'FALSE')} AS n,
      {Q.merchant_ok('(CASE WHEN NOT rp.no_match THEN rp.canonical_merchant ELSE near.name END)', 'g.canonical_merchant',
                     'coalesce((CASE WHEN NOT rp.no_match THEN rp.category END) = g.category, FALSE)')} AS c,
      (SELECT count(*) FROM ef WHERE ef.description = m.description) AS w
    FROM rp JOIN gold g USING (txn_id) JOIN mq USING (txn_id) JOIN model m USING (txn_id) JOIN near USING (query)
    WHERE g.canonical_merchant IS NOT NULL AND NOT (coalesce(g.origin = 'local', FALSE) AND coalesce(g.noise_abbrev, FALSE)))""",
    _rules_lev_ctes() + [
        """klm AS (SELECT key, arg_max(name, kind = 'merchant') AS name, arg_max(kind, kind = 'merchant') AS kind,
             min(CASE WHEN kind = 'type' THEN 0 ELSE 1 END) AS ord_k,
             arg_min(first, (CASE WHEN kind = 'type' THEN 0 ELSE 1 END, first)) AS ord_f FROM per GROUP BY key)""",
        """near AS (SELECT query, arg_min(name, (-score, ord_k, ord_f)) AS name FROM (SELECT q.query, k.name, k.ord_k, k.ord_f,
             CASE WHEN greatest(length(q.query), length(k.key)) = 0 THEN 100.0
                  ELSE 100.0 * (1.0 - levenshtein(q.query, k.key) / greatest(length(q.query), length(k.key))) END AS score
           FROM (SELECT DISTINCT query FROM mq) q, (SELECT * FROM klm WHERE kind = 'merchant') k) GROUP BY query)"""]))
def q_d35_lev(spark, sf_dir):
    """D35 with the Levenshtein rules route and, where it does not match, the nearest listed merchant; weighted by the
    held-out rows of each descriptor."""
    v = _views(spark, sf_dir)
    near = _lev_candidates(spark, sf_dir).select(
        "txn_id", F.col("candidates")[0].alias("canonical_merchant"), F.lit(None).cast("string").alias("category"))
    weights = (v.model_feed.select("txn_id", "description")
               .join(v.eval_feed.groupBy("description").agg(F.count(F.lit(1)).alias("w")), "description"))
    d = _cascade_rows(_headline(spark, sf_dir), _rules_lev_preds(spark, sf_dir), near).join(weights, "txn_id")
    return RP.cascade_summary(d, {"rules": _right("rules"), "nearest": _right("second"), "cascade": _right("cascade")},
                              ~F.col("no_match"), F.col("gold"), weight=F.col("w"))


def _confidence_report_sql():
    picked = f"choice <> {Q.q(K.NONE_OPTION)}"
    quant = lambda c: (f"list_transform(quantile_cont(confidence, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (WHERE {picked} AND {c}), "  # noqa: E731
                       "lambda x: round(x, 3))")
    per_t = lambda f: "[" + ", ".join(f(f"({picked} AND confidence >= {Q.dbl(t)})") for t in K.CONFIDENCE_THRESHOLDS) + "]"
    return f"""WITH {CONF_SQL},
  ranked AS (SELECT dataset, setting, correct, rank() OVER (PARTITION BY dataset, setting ORDER BY confidence)
      + (count(*) OVER (PARTITION BY dataset, setting, confidence) - 1) / 2.0 AS r FROM crc WHERE {picked}),
  auc AS (SELECT dataset, setting, CASE WHEN count(*) FILTER (WHERE correct) > 0 AND count(*) FILTER (WHERE NOT correct) > 0 THEN
      round((sum(r) FILTER (WHERE correct) - count(*) FILTER (WHERE correct) * (count(*) FILTER (WHERE correct) + 1) / 2.0)
        / (count(*) FILTER (WHERE correct) * count(*) FILTER (WHERE NOT correct)), 3) END AS auroc FROM ranked GROUP BY ALL),
  main AS (SELECT dataset, setting, count(*) AS rows, round(avg((gold IN ('high', 'low'))::INT), 3) AS gold_in_list,
      round(avg((NOT ({picked}))::INT), 3) AS picked_none, count(*) FILTER (WHERE {picked} AND correct) AS accepted_right,
      count(*) FILTER (WHERE {picked} AND NOT correct) AS accepted_wrong, {quant('correct')} AS quantiles_right,
      {quant('NOT correct')} AS quantiles_wrong,
      {per_t(lambda a: f"round(count(*) FILTER (WHERE {a}) / count(*), 3)")} AS auto_accepted,
      {per_t(lambda a: f"CASE WHEN count(*) FILTER (WHERE {a}) > 0 THEN round(count(*) FILTER (WHERE {a} AND correct) / count(*) FILTER (WHERE {a}), 3) END")}
        AS precision_of_accepted,
      {per_t(lambda a: f"round((count(*) FILTER (WHERE {a}) - count(*) FILTER (WHERE {a} AND correct)) / count(*), 3)")}
        AS wrong_accepts_of_all_rows,
      {per_t(lambda a: f"round(1 - count(*) FILTER (WHERE {a}) / count(*), 3)")} AS escalated
    FROM crc GROUP BY dataset, setting)
  SELECT * FROM main LEFT JOIN auc USING (dataset, setting)"""


@register("d31_confidence_report", _confidence_report_sql())
def q_d31_full(spark, sf_dir):
    r = conf_rows(spark, sf_dir).withColumn("gold_in_list", F.col("gold").isin("high", "low"))
    return RP.confidence_report(r)


@register("d33_routing_differences")
def q_d33_diff(spark, sf_dir):
    """Rule against embedding and against choice, clustered by merchant or type, and the none share."""
    ch = _route_preds(spark, sf_dir, "choice").select("txn_id", F.col("category").alias("choice"), "none")
    emb = _route_preds(spark, sf_dir, "embedding").select("txn_id", F.col("category").alias("embedding"))
    g = _gold_model(spark, sf_dir).select("txn_id", F.col("category").alias("gold"), "canonical_merchant", "txn_type")
    d = RP.pair_routes(ch, emb).join(g, "txn_id").withColumn("rule", LB.cascade_select(F.col("none"), "choice", "embedding"))
    return RP.routing_differences(d, [("rule", "embedding"), ("rule", "choice")], "gold", F.col("none"),
                                  LB.routing_key(F.col("canonical_merchant"), F.col("txn_type")), n_boot=N_BOOT_Q)


EMBED_GATES = (0.6, 0.7, 0.8, 0.9)


def _statement_preds(spark, sf_dir):
    """R15's prediction table, one row per labelled debit descriptor: text (D9), fuzzy top-1, nearest vector and choice
    against the full and the realistic list (labels of at least two descriptors, D27), generator; ``held``: the
    label is not on the realistic list; ``literal``: the label is the cleaned text itself."""
    key = ("statement_preds", _sid(spark), sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    from merchantry.operators.fuzzy import fuzzy_topk
    from merchantry.operators.vectors import nearest_vector
    feed, w = fg(spark, sf_dir)[0], wide(spark, sf_dir)
    spend = AG.spend_by_descriptor(statement(feed))
    first = AG.first_per_group(w.select("txn_id", "description", "canonical_merchant"), "description", "txn_id",
                               ["canonical_merchant"]).filter(F.col("canonical_merchant").isNotNull())
    names = first.groupBy("canonical_merchant").agg(F.min("txn_id").alias("ord"), F.count(F.lit(1)).alias("n_desc")).select(
        TX.clean_description("canonical_merchant").alias("key"), F.col("canonical_merchant").alias("name"), "ord", "n_desc")
    names = materialize(names, "statement_names")
    lists = {"known": names, "hold": names.filter("n_desc >= 2")}
    d = first.drop("txn_id").join(spend, "description", "left").join(
        names.select(F.col("name").alias("canonical_merchant"), (F.col("n_desc") < 2).alias("held")), "canonical_merchant")
    derive = TX.derive_canonical(TX.strip_processor_prefix("description"))
    d = d.select("description", "canonical_merchant", "held", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("spend", F.lit(0.0)).alias("spend"),
                 F.col("spend").isNotNull().alias("has_spend"), derive.alias("derive"), query_text("description").alias("query"),
                 (TX.norm_merchant(derive) == TX.norm_merchant("canonical_merchant")).alias("literal"))
    d = materialize(d, "statement_rows")
    asks = d.select(F.col("description").alias("txn_id"), "description", F.lit(-1.0).alias("amount"))
    gen = GeneratorRoute(echo_generator, categories=K.CATEGORIES)
    gen.categories, gen.default = list(K.CATEGORIES), K.DEFAULT_CATEGORY
    out = d.join(gen.transform(asks).select(F.col("txn_id").alias("description"), F.col("canonical_merchant").alias("generator")), "description")
    texts = d.select("query").distinct().withColumn("vec", TX.letter_counts("query"))
    for tag, lst in lists.items():
        fuzzy = fuzzy_topk(d.select("query"), lst, 1).select("query", F.get("candidates", F.lit(0)).alias(f"fuzzy_{tag}"),
                                                             F.get("scores", F.lit(0)).alias(f"fuzzy_{tag}_score"))
        vocab = lst.select("name").withColumn("vec", TX.letter_counts("name"))
        near = nearest_vector(texts, vocab, id_col="query").select("query", F.col("name").alias(f"embed_{tag}"),
                                                                   F.col("cosine").alias(f"embed_{tag}_cos"))
        ch = ChoiceRoute(first_candidate_chooser)
        ch.names, ch.categories, ch.default = lst, list(K.CATEGORIES), K.DEFAULT_CATEGORY
        picked = ch.transform(asks).select(F.col("txn_id").alias("description"),
                                           F.when(~F.col("none"), F.col("canonical_merchant")).alias(f"choice_{tag}"))
        out = out.join(fuzzy, "query", "left").join(near, "query", "left").join(picked, "description", "left")
    _CACHE[key] = materialize(out, "statement_preds")
    return _CACHE[key]


@register("r15_statement_scores")
def q_r15_full(spark, sf_dir):
    """R15 in full: every prediction and cascade (embedding gates, choice-else-generator, fuzzy-else-generator), scored five ways
    (D24) on all, held-out and non-literal descriptors, with the share sent on and, for gates, the held-out
    share wrongly kept."""
    p = _statement_preds(spark, sf_dir)
    preds = {c: F.col(c) for c in ("derive", "generator", "fuzzy_known", "fuzzy_hold", "embed_known", "embed_hold", "choice_known", "choice_hold")}
    kept = {f"cascade_embed{t}": F.coalesce(F.col("embed_hold_cos") >= t, F.lit(False)) for t in EMBED_GATES}
    kept |= {"cascade_choice": F.col("choice_hold").isNotNull(), "cascade_fuzzy": F.coalesce(F.col("fuzzy_hold_score") >= K.FUZZY_CUTOFF, F.lit(False))}
    first = lambda name: F.col("embed_hold" if "embed" in name else "choice_hold" if "choice" in name else "fuzzy_hold")
    preds |= {name: LB.cascade_select(gate, first(name), F.col("generator")) for name, gate in kept.items()}
    accepted = LB.accepted_names(F.col("canonical_merchant"))
    rows = p.withColumn("_accepted", accepted).select(
        "canonical_merchant", "n", "spend", "_accepted",
        F.explode(F.array(*[F.struct(F.lit(k).alias("prediction"), v.alias("pred"), (
            ~kept[k] if k in kept else F.lit(None).cast("boolean")).alias("sent")) for k, v in preds.items()])).alias("x"),
        F.array_compact(F.array(F.lit("all"), F.when(F.col("held"), "held"), F.when(~F.col("literal"), "non_literal"))).alias("subsets"))
    rows = rows.select("canonical_merchant", "n", "spend", "x.*", F.explode("subsets").alias("subset"),
                       F.array_contains("_accepted", TX.norm_merchant("x.pred")).alias("ok"))
    scores = M.weighted_scores(rows, group=["prediction", "subset"])
    sent = rows.groupBy("prediction", "subset").agg(F.count(F.lit(1)).alias("descriptors"), F.avg(F.col("sent").cast("double")).alias("sent_on"))
    return _round6(scores.join(sent, ["prediction", "subset"]),
                   ["distinct", "row_weighted", "macro_merchant", "spend_weighted", "spend_weighted_no_top", "sent_on"])


@register("r15_statement_counts")
def q_r15_counts(spark, sf_dir):
    """R15's counts: spend coverage, list sizes, the choice model's none rate on held-out and listed descriptors, the share of the
    largest descriptor (D26) of all and of labelled spend."""
    p = _statement_preds(spark, sf_dir)
    raw = AG.spend_by_descriptor(statement(fg(spark, sf_dir)[0]))
    all_ = raw.agg(F.max_by(F.struct("description", "spend"), F.struct("spend", "description")).alias("t"), F.sum("spend").alias("s"),
                   F.count(F.lit(1)).alias("raw_descriptors"), F.sum("n").alias("raw_rows")).first()
    top = all_["t"]
    none = F.col("choice_hold").isNull().cast("double")
    return p.agg(
        F.count(F.lit(1)).alias("labelled_descriptors"), F.sum("n").alias("labelled_rows"),
        F.countDistinct("canonical_merchant").alias("merchants"), F.countDistinct(F.when(F.col("held"), F.col("canonical_merchant"))).alias("held_merchants"),
        F.round(F.avg(F.col("has_spend").cast("double")), 3).alias("spend_join_coverage"),
        F.round(F.avg(F.when(F.col("held"), none)), 3).alias("none_rate_held"), F.round(F.avg(F.when(~F.col("held"), none)), 3).alias("none_rate_listed"),
        F.lit(all_["raw_descriptors"]).alias("raw_descriptors"), F.lit(all_["raw_rows"]).alias("raw_rows"),
        F.lit(top["description"] if top else None).cast("string").alias("top_description"),
        F.lit(round(float(top["spend"]) / float(all_["s"]), 3) if top and all_["s"] else None).cast("double").alias("top_share_of_raw"),
        F.round(F.sum(F.when(F.col("description") == F.lit(top["description"] if top else None), F.col("spend")))
                / F.nullif(F.sum("spend"), F.lit(0.0)), 3).alias("top_share_of_labelled"))


@register("r16_significance_set")
def q_r16(spark, sf_dir):
    """The primary and exploratory comparisons: merchant (headline rows, clustered by merchant) and category (all rows, merchant or
    type) on the random split, and the statement ones, plain, row-weighted and without the merchant with most rows."""
    head, gold = _headline(spark, sf_dir), _gold_model(spark, sf_dir)
    def merchant(name, col):
        return head.join(_route_preds(spark, sf_dir, name), "txn_id").select(
            "txn_id", F.col("gold").alias("cluster"), merchant_ok(F.col("canonical_merchant"), F.col("gold"),
                                                                  LB.category_ok(F.col("category"), F.col("gcat"))).alias(col))
    def category(name, col):
        g = gold.select("txn_id", F.col("category").alias("gcat"), LB.cluster_key(F.col("canonical_merchant"), F.col("txn_type")).alias("cluster"))
        return g.join(_route_preds(spark, sf_dir, name), "txn_id").select("txn_id", "cluster", LB.category_ok(F.col("category"), F.col("gcat")).alias(col))
    def pair(kind, a, b):
        return RP.pair_routes(kind(a, "a"), kind(b, "b").drop("cluster"))
    st = _statement_preds(spark, sf_dir)
    ok = lambda c: F.array_contains("_accepted", TX.norm_merchant(c))
    st = st.withColumn("_accepted", LB.accepted_names(F.col("canonical_merchant"))).select(
        F.col("canonical_merchant").alias("cluster"), "n", ok(F.coalesce("choice_hold", "generator")).alias("a"), ok(F.col("generator")).alias("b"),
        ok(F.col("choice_known")).alias("ck"), ok(F.col("embed_known")).alias("ek"))
    st = materialize(st, "statement_pairs")
    most = st.groupBy("cluster").agg(F.sum("n").alias("n")).agg(F.max_by("cluster", F.struct("n", "cluster"))).first()[0]
    comps = [("choice_generator_minus_generator_merchant", pair(merchant, "choice_generator", "generator"), "a", "b", None),
             ("choice_minus_embedding_merchant", pair(merchant, "choice", "embedding"), "a", "b", None),
             ("embedding_minus_choice_category", pair(category, "embedding", "choice"), "a", "b", None),
             ("statement_choice_generator_minus_generator", st, "a", "b", None),
             ("statement_choice_generator_minus_generator_row_weighted", st, "a", "b", "n"),
             ("statement_row_weighted_without_largest_merchant", st.filter(F.col("cluster") != most), "a", "b", "n"),
             ("statement_choice_minus_embedding_full_list", st, "ck", "ek", None)]
    return RP.significance_report([{"name": n, "df": d, "a": a, "b": b, "cluster": "cluster", "weight": w} for n, d, a, b, w in comps],
                                  n_boot=N_BOOT_Q)


@register("f9_valid_split_exact", W(f"""SELECT txn_id, CASE WHEN row_number() OVER (ORDER BY {ORDER_U}, txn_id) - 1
    >= (SELECT CAST(floor(0.9 * count(*)) AS BIGINT) FROM feed) THEN 'valid' ELSE 'train' END AS split FROM feed"""))
def q_f9(spark, sf_dir):
    return SP.valid_split(fg(spark, sf_dir)[0].select("txn_id"), exact=True).select("txn_id", "split")


@register("d39_model_view_by_origin", W("""SELECT g.origin, count(DISTINCT g.canonical_merchant) AS merchants,
    count(DISTINCT f.family) AS families, count(*) AS rows FROM gold g JOIN fam f ON g.canonical_merchant = f.name
  WHERE g.txn_id IN (SELECT txn_id FROM model) GROUP BY g.origin""", _families_sql() + _views_sql(RANDOM_MEM_SQL), recursive=True))
def q_d39_model(spark, sf_dir):
    """D39 on the model view: merchants, families (of the whole feed's merchants) and rows by origin."""
    fam = FM.brand_families(fg(spark, sf_dir)[1].select(F.col("canonical_merchant").alias("name")))
    g = _gold_model(spark, sf_dir).join(fam.withColumnRenamed("name", "canonical_merchant"), "canonical_merchant")
    return g.groupBy("origin").agg(F.countDistinct("canonical_merchant").alias("merchants"),
                                   F.countDistinct("family").alias("families"), F.count(F.lit(1)).alias("rows"))


@register("r8_cosine_else_generator")
def q_r8_cosine(spark, sf_dir):
    """R8 with the cosine gate: the nearest name from 0.6 on, else the generator's."""
    emb, gen = _route_preds(spark, sf_dir, "embedding"), _route_preds(spark, sf_dir, "generator")
    return cascade(emb, gen, F.coalesce(F.col("f_cosine") >= EMBED_GATES[0], F.lit(False)), cols=("canonical_merchant", "category"))
