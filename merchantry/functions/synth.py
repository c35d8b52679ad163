"""Synthesis column functions.

Every draw is a hash uniform of a key (functions.hashing), so a row's values do not
depend on partitioning or on which other rows exist.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.hashing import hkey, int_between, pick, uniform
from merchantry.functions.text import abbreviate, bound


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def direction(amount) -> Column:
    """``incoming`` when the signed amount is positive, else ``outgoing``."""
    return F.when(_c(amount) > 0, "incoming").otherwise("outgoing")


def type_code(method, dirn) -> Column:
    """``I``/``O`` + ``-`` + payment-method code."""
    code = F.create_map(*[x for kv in K.METHOD_CODES.items() for x in map(F.lit, kv)])
    return F.concat(F.when(_c(dirn) == "incoming", "I").otherwise("O"), F.lit("-"),
                    F.try_element_at(code, _c(method)))


def choose(items, idx: Column) -> Column:
    """Element ``idx`` (0-based) of a literal list."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), idx.cast("int") + 1)


def weighted_choice(category, u: Column, priors=K.METHOD_PRIORS,
                    fallback=K.PAYMENT_METHODS) -> Column:
    """Inverse-CDF pick from the category's weights; uniform over ``fallback``."""
    return bound(u, lambda u: _weighted(_c(category), u, priors, fallback))


def _weighted(category: Column, u: Column, priors, fallback) -> Column:
    out = None
    for cat, weights in priors.items():
        acc, ladder = 0.0, None
        items = list(weights.items())
        for i, (m, w) in enumerate(items):
            acc += w
            cond = u < F.lit(acc) if i < len(items) - 1 else F.lit(True)
            ladder = F.when(cond, m) if ladder is None else ladder.when(cond, m)
        branch = ladder
        out = F.when(category == cat, branch) if out is None else out.when(category == cat, branch)
    n = len(fallback)
    return out.otherwise(choose(fallback, F.floor(u * n)))


def mcc_for(category, key: Column) -> Column:
    """A code of the category, picked by hash; null when the category is unknown."""
    out = None
    for cat, codes in K.CATEGORY_MCC.items():
        v = F.element_at(F.array(*[F.lit(c) for c in codes]), (pick(key, len(codes)) + 1).cast("int"))
        out = F.when(_c(category) == cat, v) if out is None else out.when(_c(category) == cat, v)
    return out


def noisy_mcc(category, key: Column, coverage=K.MCC_COVERAGE, noise=K.MCC_NOISE) -> Column:
    """Present on ``coverage`` of merchant-category rows, a share ``noise`` of them
    drawn from another category."""
    cats = K.CATEGORIES
    cat_idx = F.array_position(F.array(*[F.lit(c) for c in cats]), _c(category)) - 1
    j = pick(hkey(key, "other"), len(cats) - 1)
    other = bound(j, lambda j: choose(cats, j + F.when(j >= cat_idx, 1).otherwise(0)))
    mcc_cat = F.when(uniform(hkey(key, "noise")) < noise, other).otherwise(_c(category))
    present = (~_c(category).isin("Income", "Financial Services")
               & (uniform(hkey(key, "present")) < coverage))
    return F.when(present, bound(mcc_cat, lambda c: mcc_for(c, hkey(key, "code")))).cast("int")


def lognormal_amount(category, key: Column, sigma: float = 0.6) -> Column:
    """``round(exp(N(ln median, sigma)), 2)`` with a Box-Muller normal."""
    med = F.create_map(*[x for kv in K.AMOUNT_MEDIAN.items() for x in map(F.lit, kv)])
    mu = F.log(F.coalesce(F.try_element_at(med, _c(category)), F.lit(50.0)))
    u1 = F.greatest(uniform(hkey(key, "n1")), F.lit(1e-300))
    u2 = uniform(hkey(key, "n2"))
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
    return F.round(F.exp(mu + F.lit(sigma) * z), 2)


def refund_flip(dirn, key: Column, rate=K.REFUND_RATE) -> Column:
    """A share ``rate`` of outgoing rows becomes incoming."""
    return F.when((_c(dirn) == "outgoing") & (uniform(key) < rate), "incoming").otherwise(_c(dirn))


def _code(letter: str, digits: int, n: Column) -> Column:
    """``letter`` and ``n`` with at least ``digits`` digits."""
    n = n.cast("bigint")
    text = n.cast("string")
    return (F.when(n >= 10 ** digits, F.concat(F.lit(letter), text))
            .when(n >= 0, F.concat(F.lit(letter), F.lpad(text, digits, "0")))
            .otherwise(F.format_string(f"{letter}%0{digits}d", n)))


def customer_code(n: Column) -> Column:
    """``C%05d``; longer numbers keep all their digits."""
    return _code("C", 5, n)


def txn_code(n: Column) -> Column:
    """``T%08d``; longer numbers keep all their digits."""
    return _code("T", 8, n)


def with_noisy_descriptor(df, text: str, key: str):
    """B14 + B19 on a DataFrame: adds ``description``, ``noise_abbrev``, ``noise_trunc``.

    In order: drop ``',.&`` (p=.5); upper-case (p=.8); abbreviate (p=.15); store id
    (p=.5); city (p=.5, region p=.6 of those); phone-like number (p=.15); truncate to
    20-25 chars (p=.5, flagged only when it cuts the name); wrapper prefix (p=.45);
    squash spaces (p=.2); trim. Every draw comes from ``key`` (name|location), so all
    rows of one location get the same bytes. Steps are staged as columns so no
    sub-expression is generated twice."""
    P = K.NOISE_P
    k = F.col(key)
    u = lambda tag: uniform(hkey(k, tag))
    d = df.withColumn("_m0", F.when(u("punct") < P["drop_punct"],
                                    F.regexp_replace(F.col(text), "[',.&]", "")).otherwise(F.col(text)))
    d = d.withColumn("_m1", F.when(u("upper") < P["upper"], F.upper("_m0")).otherwise(F.col("_m0")))
    d = (d.withColumn("_ab", abbreviate("_m1"))
         .withColumn("_do_ab", u("abbrev") < K.ABBREV_P))
    d = (d.withColumn("noise_abbrev", F.col("_do_ab") & (F.col("_ab") != F.col("_m1")))
         .withColumn("_m", F.when(F.col("_do_ab"), F.col("_ab")).otherwise(F.col("_m1"))))
    has_city = u("city") < P["city"]
    d = d.withColumn("_d0", F.concat_ws(
        " ", F.col("_m"),
        F.when(u("store") < P["store_id"], F.concat(
            choose(K.ID_SUFFIX_MARKS, pick(hkey(k, "mark"), len(K.ID_SUFFIX_MARKS))),
            int_between(hkey(k, "storeno"), 100, 99999).cast("string"))),
        F.when(has_city, choose(K.HARD_CITIES, pick(hkey(k, "cityname"), len(K.HARD_CITIES)))),
        F.when(has_city & (u("region") < P["region"]),
               choose(K.HARD_REGIONS, pick(hkey(k, "regionname"), len(K.HARD_REGIONS)))),
        F.when(u("phone") < P["phone"], F.concat(
            int_between(hkey(k, "area"), 200, 999).cast("string"),
            int_between(hkey(k, "line"), 1000000, 9999999).cast("string")))))
    d = (d.withColumn("_do_cut", u("trunc") < P["truncate"])
         .withColumn("_cut", int_between(hkey(k, "cut"), 20, 25)))
    d = (d.withColumn("noise_trunc", F.col("_do_cut") & (F.col("_cut") < F.length("_m")))
         .withColumn("_d1", F.when(F.col("_do_cut"), F.col("_d0").substr(F.lit(1), F.col("_cut")))
                     .otherwise(F.col("_d0"))))
    d = d.withColumn("_d2", F.when(u("prefix") < P["prefix"], F.concat(
        choose(K.HARD_PREFIXES, pick(hkey(k, "prefixname"), len(K.HARD_PREFIXES))), F.col("_d1")))
        .otherwise(F.col("_d1")))
    d = d.withColumn("description", F.regexp_replace(
        F.when(u("squash") < P["squash"], F.regexp_replace("_d2", r"\s+", "")).otherwise(F.col("_d2")),
        r"^\s+|\s+$", ""))
    return d.drop("_m0", "_m1", "_ab", "_do_ab", "_m", "_d0", "_do_cut", "_cut", "_d1", "_d2")
