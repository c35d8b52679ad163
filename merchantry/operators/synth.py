"""Dataset synthesis as DataFrame plans.

No driver loop and no row dicts: a raw labelled frame becomes feed + gold through
column expressions on hash draws, two small aggregates joined back (first row per
label, rows per name) and two joins against bounded lookup tables (Zipf CDF, local
merchant list), whose sizes are fixed by parameters, not by the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions import synth as S
from merchantry.functions.hashing import hash52, hkey, in_eval, pick, uniform
from merchantry.functions.labels import gold_merchant
from merchantry.functions.text import derive_canonical, name_tokens
from merchantry.session import discard, materialize

ZIPF_SCALE = 10 ** 9


def _zipf_weight(k: Column, s: float) -> Column:
    r = (k + 1).cast("double")
    if s == 1.0:
        den = r
    elif s == 1.5:
        den = r * F.sqrt(r)          # sqrt is exactly rounded in every engine
    else:
        den = F.pow(r, F.lit(s))
    return F.floor(F.lit(float(ZIPF_SCALE)) / den).cast("bigint")


def zipf_table(spark: SparkSession, max_n: int, s: float) -> DataFrame:
    """Per n <= max_n the integer CDF (``cdf``, its last value ``total``) of ranks 0..n-1 with weight
    ``1/(k+1)^s``.

    ``max_n`` rows with up to ``max_n`` numbers (200 rows for the location cap): a bounded
    table, so broadcasting it is safe at any data size.
    """
    zero = F.lit(0).cast("bigint")
    ranks = F.sequence(zero, F.col("n") - 1)
    sums = F.aggregate(ranks, F.array(zero), lambda a, k: F.concat(
        a, F.array(F.element_at(a, -1) + _zipf_weight(k, s))))
    return (spark.range(1, max_n + 1).withColumnRenamed("id", "n").withColumn("cdf", F.slice(sums, F.lit(2), F.col("n").cast("int")))
            .withColumn("total", F.element_at("cdf", -1)))


ZIPF_STEPS = 16                # halvings: lists of up to 65,535 ranks


def zipf_pick(df: DataFrame, n_col: str, key: Column, out: str, table: DataFrame) -> DataFrame:
    """Add ``out`` = a Zipf-distributed rank in [0, n) drawn from ``key``: one row of the table per n, the rank
    by bisection of its CDF."""
    t = F.broadcast(table.select(F.col("n").alias("_zn"), F.col("cdf").alias("_zcdf"), F.col("total").alias("_ztot")))
    d = df.join(t, df[n_col] == F.col("_zn"), "left").withColumn("_zh", F.pmod(hash52(key), F.col("_ztot")))
    middle = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    below = lambda a: F.get("_zcdf", middle(a)) <= F.col("_zh")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(ZIPF_STEPS)), F.struct(F.lit(0).alias("lo"), F.size("_zcdf").alias("hi")),
        lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(
            F.when(below(a), middle(a) + 1).otherwise(a["lo"]).alias("lo"),
            F.when(below(a), a["hi"]).otherwise(middle(a)).alias("hi"))),
        lambda a: a["lo"])
    rank = F.when(F.col("_ztot").isNotNull(), found.cast("bigint"))
    return d.withColumn(out, rank).drop("_zh", "_zn", "_zcdf", "_ztot")


# ---------------------------------------------------------------- local merchants
MAX_OVERSAMPLE = 256
LOCAL_CATEGORIES = [c for c in K.CATEGORIES if c in K.LOCAL_NOUNS]


def _by_category(cat: Column, mapping: dict, idx_fn) -> Column:
    out = None
    for c, items in mapping.items():
        v = S.choose(items, idx_fn(len(items)))
        out = F.when(cat == c, v) if out is None else out.when(cat == c, v)
    return out


def local_merchants(spark: SparkSession, source_labels: DataFrame, n: int = K.LOCAL_MERCHANTS_N,
                    seed: int = K.SEED, oversample: int = 4) -> DataFrame:
    """H1: ``n`` fictional (name, category, rank) with an even quota over the eight local
    categories. Candidates come from templates over word lists, picked by hash of
    (seed, category, i); a name sharing any token with a source label is rejected
    (G6 as an anti join on exploded tokens); duplicates keep the smallest i.
    ``source_labels`` has one column ``label``. The candidate pool grows until every quota
    is met; if even the largest pool can't meet it, a ValueError is raised."""
    while True:
        found = _local_pool(spark, source_labels, n, seed, oversample)
        if found.count() == n:
            return found
        if oversample >= MAX_OVERSAMPLE:
            raise ValueError(f"the vocabulary gives fewer than {n} local merchants that share no word with a label")
        oversample *= 4


def _local_pool(spark: SparkSession, source_labels: DataFrame, n: int, seed: int, oversample: int) -> DataFrame:
    kc = len(LOCAL_CATEGORIES)
    per = n // kc + 1
    m = per * oversample
    cats = F.array(*[F.lit(c) for c in LOCAL_CATEGORIES])
    cand = spark.range(0, kc * m).select(
        F.element_at(cats, (F.col("id") % kc + 1).cast("int")).alias("category"),
        (F.col("id") / kc).cast("bigint").alias("i"),
        F.col("id").alias("cid"))
    cat = F.col("category")
    key = lambda tag: hkey(str(seed), cat, F.col("i"), tag)
    ns = len(K.LOCAL_SURNAMES)
    s_idx = pick(key("s"), ns)
    s2_idx = F.pmod(s_idx + 1 + pick(key("s2"), ns - 1), F.lit(ns))
    templ = _by_category(cat, K.LOCAL_TEMPLATES, lambda L: pick(key("t"), L))
    noun = _by_category(cat, K.LOCAL_NOUNS, lambda L: pick(key("n"), L))
    name = templ
    for ph, val in [("{s2}", S.choose(K.LOCAL_SURNAMES, s2_idx)),
                    ("{s}", S.choose(K.LOCAL_SURNAMES, s_idx)),
                    ("{p}", S.choose(K.LOCAL_PLACES, pick(key("p"), len(K.LOCAL_PLACES)))),
                    ("{a}", S.choose(K.LOCAL_ADJECTIVES, pick(key("a"), len(K.LOCAL_ADJECTIVES)))),
                    ("{x}", S.choose(K.LOCAL_ANIMALS, pick(key("x"), len(K.LOCAL_ANIMALS)))),
                    ("{n}", noun)]:
        name = F.replace(name, F.lit(ph), val)
    cand = cand.withColumn("name", name)
    banned = (source_labels.select(F.explode(name_tokens("label")).alias("tok")).distinct())
    bad = (cand.select("cid", F.explode(name_tokens("name")).alias("tok"))
           .join(banned, "tok", "left_semi").select("cid").distinct())
    ok = cand.join(bad, "cid", "left_anti")
    first = ok.groupBy("name").agg(F.min("cid").alias("cid"))
    ok = ok.join(first, ["name", "cid"], "left_semi")
    quota = F.element_at(F.array(*[F.lit(n // kc + (1 if ci < n % kc else 0))
                                   for ci in range(kc)]),
                         F.array_position(cats, cat).cast("int"))
    w = Window.partitionBy("category").orderBy("i")
    return (ok.withColumn("rank", F.row_number().over(w) - 1)
            .filter(F.col("rank") < quota)
            .select("name", "category", "rank"))


# ---------------------------------------------------------------- feed synthesis
def assign_origin(base: DataFrame, locals_df: DataFrame, zipf_local: DataFrame,
                  share: float = K.LOCAL_MERCHANT_SHARE, write=None) -> DataFrame:
    """H2: ``base`` has (row_id, txn_id, category, merchant, txn_type, canonical). ``write`` (a table, a
    name) keeps the first rows per label, so that the join knows their size. Adds ``name`` (gold label), ``text`` (descriptor source text) and ``origin``.
    A stable-hash share of merchant rows moves to a same-category local merchant
    picked Zipf(s=1) by rank; the first row (smallest row_id) of a label never moves."""
    first = (base.filter(F.col("merchant").isNotNull())
             .groupBy("merchant").agg(F.min("row_id").alias("_first")))
    first = write(first, "synth_first") if write else first
    n_local = locals_df.groupBy("category").agg(F.count(F.lit(1)).alias("_nloc"))
    # broadcast sides below are bounded by parameters: <= 8 categories, <= n locals
    d = (base.join(first, "merchant", "left")
         .join(F.broadcast(n_local), "category", "left"))
    move = (F.col("merchant").isNotNull() & F.col("_nloc").isNotNull()
            & (F.col("row_id") != F.col("_first"))
            & in_eval(F.concat(F.lit("local|"), F.col("txn_id")), share))
    d = d.withColumn("_move", move)
    d = zipf_pick(d, "_nloc", hkey("localpick", F.col("txn_id")), "_lrank", zipf_local)
    loc = F.broadcast(locals_df.select(F.col("category").alias("_lcat"),
                                       F.col("rank").alias("_lrank2"),
                                       F.col("name").alias("_lname")))
    d = d.join(loc, d["_move"] & (d["category"] == loc["_lcat"])
               & (d["_lrank"] == loc["_lrank2"]), "left")
    return (d.withColumn("origin", F.when(F.col("_move"), "local")
                         .when(F.col("merchant").isNotNull(), "source"))
            .withColumn("name", F.when(F.col("_move"), F.col("_lname"))
                        .otherwise(F.coalesce("merchant", "txn_type")))
            .withColumn("text", F.when(F.col("_move"), F.col("_lname"))
                        .otherwise(F.col("canonical")))
            .drop("_first", "_nloc", "_move", "_lrank", "_lcat", "_lrank2", "_lname"))


def hard_descriptors(d: DataFrame, zipf_loc: DataFrame, write=None) -> DataFrame:
    """H3: ``min(200, ceil(rows/3))`` locations per name, a Zipf(1.5) location per row,
    one fixed descriptor per (name, location) computed from a hash of that pair. ``write`` (a table, a
    name) keeps the rows per name and the descriptors, so that their joins know their size."""
    write = write or (lambda table, _: table)
    counts = write(d.groupBy("name").agg(F.count(F.lit(1)).alias("_cnt")), "synth_counts")
    d = d.join(counts, "name", "left").withColumn(
        "_nloc", F.least(F.lit(K.LOCATIONS_CAP),
                         F.ceil(F.col("_cnt") / F.lit(K.LOCATIONS_ROWS_PER))).cast("bigint"))
    d = zipf_pick(d, "_nloc", hkey("loc", F.col("txn_id")), "location", zipf_loc)
    # the first row of a (name, location) fixes its text (merged labels can differ)
    # and its noise, which is drawn once for the pair and joined to its rows. The first row is looked for
    # among the first ones of every text: rows meet in a hash aggregate, which min_by of a string is not
    texts = d.groupBy("name", "location", "text").agg(F.min("row_id").alias("_row"))
    rep = texts.groupBy("name", "location").agg(F.min_by("text", "_row").alias("_text"))
    rep = rep.withColumn("_nkey", F.concat_ws("|", F.col("name"), F.col("location").cast("string")))
    rep = write(S.with_noisy_descriptor(rep, "_text", "_nkey").drop("_nkey", "_text"), "synth_descriptors")
    own = [c for c in d.columns if c not in ("description", "noise_abbrev", "noise_trunc", "_cnt", "_nloc")]
    return d.select(*own).join(rep, ["name", "location"], "left")


N_CUSTOMERS = 1500
SYNTH_YEAR = 2026


BUCKET_ROWS = 1 << 18
COPY_ROWS = 1 << 16


def number_rows(df: DataFrame, bucket_rows: int = BUCKET_ROWS, copy_rows: int = COPY_ROWS) -> DataFrame:
    """Adds ``row_id``, 0 to n-1 without gaps, in the order of a hash of the row. Equal rows are counted, not
    numbered: distinct rows get the number they start at (the rows in lower hash buckets and before
    them in their own), and their copies are laid out again from the count, very many of one row by
    several tasks."""
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_row", F.xxhash64(*df.columns))
    distinct = materialize(distinct, "distinct_rows")
    buckets = distinct.count() // bucket_rows + 1
    distinct = distinct.withColumn("_bk", F.pmod("_row", F.lit(buckets)))
    # one row per bucket
    before = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy("_bk").agg(F.sum("_n").alias("_sz")).select(
        "_bk", F.coalesce(F.sum("_sz").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bk").orderBy("_row", *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    d = distinct.join(offsets, "_bk").withColumn("_start", start)
    zero = F.lit(0).cast("bigint")
    many = (d.filter(F.col("_n") > copy_rows)
            .select("*", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / copy_rows))).alias("_part"))
            .repartition("_row", "_part"))
    d = d.filter(F.col("_n") <= copy_rows).withColumn("_part", zero).unionByName(many)
    first = F.col("_part") * copy_rows
    return (d.select("*", F.explode(F.sequence(first, F.least(F.col("_n"), first + copy_rows) - 1)).alias("_i"))
            .select(*df.columns, (F.col("_start") + F.col("_i")).alias("row_id")))


def complete_raw(raw: DataFrame, seed: int = K.SEED, n_customers: int = N_CUSTOMERS) -> DataFrame:
    """Fill what a bare labelled set (description, category, country, currency) lacks:
    ``row_id`` (``number_rows``: it does not depend on how the set is split into files), ``customer_no`` (hash pick in [0, n_customers)),
    ``amount_abs`` (B17 lognormal by category) and ``posted_date`` (day 1-28, month
    1-12 of SYNTH_YEAR from hash draws)."""
    d = raw
    if "row_id" not in d.columns:
        d = number_rows(raw)
    key = lambda tag: hkey(str(seed), tag, F.col("row_id"))
    if "customer_no" not in d.columns:
        d = d.withColumn("customer_no", pick(key("customer"), n_customers))
    if "amount_abs" not in d.columns:
        d = d.withColumn("amount_abs", S.lognormal_amount(F.col("category"), key("amount")))
    if "posted_date" not in d.columns:
        d = d.withColumn("posted_date", F.make_date(
            F.lit(SYNTH_YEAR), (pick(key("month"), 12) + 1).cast("int"), (pick(key("day"), 28) + 1).cast("int")))
    return d


def build_feed(spark: SparkSession, raw: DataFrame, hard: bool = True, seed: int = K.SEED
               ) -> tuple[DataFrame, DataFrame]:
    """H4: raw labelled rows -> (feed, gold) keyed by txn_id (see ``build_feed_wide``)."""
    return split_feed_gold(build_feed_wide(spark, raw, hard, seed))


def build_feed_wide(spark: SparkSession, raw: DataFrame, hard: bool = True, seed: int = K.SEED,
                    write_intermediate: bool = True) -> DataFrame:
    """H4: raw labelled rows -> one frame with the feed and the gold columns.

    ``raw`` has (row_id BIGINT, transaction_description, category, country, currency,
    customer_no BIGINT, amount_abs DOUBLE, posted_date DATE). Labels come from B3+B4 on
    the raw description, so they are identical with and without descriptor noise."""
    raw = complete_raw(raw, seed)
    base = (raw.withColumn("txn_id", S.txn_code(F.col("row_id")))
            .withColumn("canonical", derive_canonical("transaction_description"))
            .withColumn("_gm", gold_merchant(F.col("canonical"), F.col("category")))
            .withColumn("merchant", F.col("_gm.merchant"))
            .withColumn("txn_type", F.col("_gm.txn_type")).drop("_gm"))
    write = materialize if write_intermediate else (lambda table, _: table)
    # base feeds three branches (labels, first rows, the rows themselves): write it
    # once instead of re-running the scan, join and regex chain three times
    base = write(base, "synth_base")
    labels = write(base.select(F.coalesce("merchant", "txn_type").alias("label")).distinct(), "synth_labels")
    locals_df = local_merchants(spark, labels, seed=seed)
    locals_df = write(locals_df, "synth_locals")
    zl = zipf_table(spark, K.LOCAL_MERCHANTS_N // len(LOCAL_CATEGORIES) + 1, K.LOCAL_ZIPF_S)
    d = assign_origin(base, locals_df, zl, write=write)
    if hard:
        # the names feed three branches too (counts, descriptors, the rows)
        d = write(d.drop("transaction_description", "canonical", "merchant", "txn_type"), "synth_named")
        discard(base)
        d = hard_descriptors(d, zipf_table(spark, K.LOCATIONS_CAP, K.LOCATIONS_ZIPF_S), write=write)
        desc, ab, tr = F.col("description"), F.col("noise_abbrev"), F.col("noise_trunc")
    else:
        desc = F.when(F.col("origin") == "local", F.col("name")).otherwise(
            F.col("transaction_description"))
        ab, tr = F.lit(False), F.lit(False)
    tid = F.col("txn_id")
    dirn = S.refund_flip(F.when(F.col("category") == "Income", "incoming").otherwise("outgoing"),
                         hkey(str(seed), "refund", tid))
    d = (d.withColumn("description", desc).withColumn("noise_abbrev", ab)
         .withColumn("noise_trunc", tr).withColumn("direction", dirn)
         .withColumn("payment_method",
                     S.weighted_choice(F.col("category"), uniform(hkey(str(seed), "pm", tid))))
         )
    wide = d.select(
        "txn_id",
        S.customer_code(F.col("customer_no")).alias("customer_id"),
        "description",
        S.type_code(F.col("payment_method"), F.col("direction")).alias("transaction_type_code"),
        S.noisy_mcc(F.col("category"), hkey(str(seed), "mcc", tid)).alias("mcc"),
        F.when(F.col("direction") == "incoming", F.col("amount_abs"))
         .otherwise(-F.col("amount_abs")).alias("amount"),
        "payment_method", "posted_date", "country", "currency",
        "category",
        F.when(F.col("origin").isNotNull(), F.col("name")).alias("canonical_merchant"),
        F.when(F.col("origin").isNull(), F.col("name")).alias("txn_type"),
        "direction", "origin", "noise_abbrev", "noise_trunc")
    return wide


FEED_COLUMNS = ["txn_id", "customer_id", "description", "transaction_type_code", "mcc", "amount",
                "payment_method", "posted_date", "country", "currency"]
GOLD_COLUMNS = ["txn_id", "category", "canonical_merchant", "txn_type", "direction", "origin",
                "noise_abbrev", "noise_trunc"]


def split_feed_gold(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feed, gold) projections of one wide synthesis frame (the feed never carries a
    label column)."""
    return wide.select(*FEED_COLUMNS), wide.select(*GOLD_COLUMNS)


def stratified_sample(df: DataFrame, n: int, by: list[str], u: Column) -> DataFrame:
    """per stratum keep ``min(size, max(1, bround(n*size/total)))`` rows (half-to-even):
    those with the smallest hash uniform ``u``; the whole frame when total <= n.

    A hot stratum is never ranked whole: rows are first cut at a per-stratum threshold
    on ``u`` that keeps a few more rows than needed; strata where the cut kept too few
    (rare) fall back to threshold 1, so the result stays exact."""
    if not by:
        raise ValueError("stratified_sample needs at least one stratum column")
    d = df.withColumn("_u", u)
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    if total <= n:
        return df
    take = F.least(F.col("_size"), F.greatest(F.lit(1), F.bround(
        F.lit(n) * F.col("_size") / F.lit(total), 0).cast("bigint")))
    sizes = (sizes.withColumn("_take", take)
             .withColumn("_thr", F.least(F.lit(1.0), (F.col("_take") + F.sqrt(F.col("_take")) * 5
                                                      + 10) / F.col("_size"))))
    kept = (d.join(sizes, by)
            .filter(F.col("_u") < F.col("_thr")).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("_kept")))
    sizes = (sizes.join(kept, by, "left")
             .withColumn("_thr", F.when(F.coalesce("_kept", F.lit(0)) < F.col("_take"), F.lit(1.01))
                         .otherwise(F.col("_thr"))).drop("_kept"))
    w = Window.partitionBy(*by).orderBy("_u")
    return (d.join(sizes, by).filter(F.col("_u") < F.col("_thr"))
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= F.col("_take"))
            .drop("_size", "_take", "_thr", "_rn", "_u"))
