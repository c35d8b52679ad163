"""Label rules and correctness predicates.

Rule tables are small literal maps (fixed values), so lookups are ``element_at`` on a
map literal inside codegen rather than joins.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry import constants as K
from merchantry.functions.text import norm_merchant


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def gold_merchant(canonical, category) -> Column:
    """``struct(merchant, txn_type)``: a non-merchant label goes to txn_type; else a
    category split (``Frontier``), else a merge (``Cane's``), else the text itself."""
    canonical, category = _c(canonical), _c(category)
    is_type = canonical.isin(*K.NON_MERCHANT_LABELS)
    split = None
    for label, by_cat in K.CATEGORY_SPLIT_LABELS.items():
        v = F.try_element_at(_map(by_cat), category)
        cond = (canonical == label)
        split = F.when(cond, v) if split is None else split.when(cond, v)
    merged = F.coalesce(F.try_element_at(_map(K.LABEL_MERGES), canonical), canonical)
    merchant = F.when(is_type, F.lit(None).cast("string")).otherwise(
        F.coalesce(split, merged))
    return F.struct(merchant.alias("merchant"),
                    F.when(is_type, canonical).alias("txn_type"))


def parent_of(gold) -> Column:
    return F.try_element_at(_map({k: v[0] for k, v in K.PARENT_BRANDS.items()}), _c(gold))


def same_line(gold) -> Column:
    return F.try_element_at(_map({k: v[1] for k, v in K.PARENT_BRANDS.items()}), _c(gold))


def category_ok(pred, gold) -> Column:
    """Non-null equality; a null prediction is wrong."""
    return F.coalesce(_c(pred) == _c(gold), F.lit(False))


def merchant_ok(pred, gold, cat_ok=None) -> Column:
    """False on null gold; normalised equality (of the names themselves where nothing is left
    of them, as in other scripts; a missing prediction is never right); or the gold's parent brand when it is
    the same line of business or the category is right. A child is never credited
    for its parent."""
    p, g = norm_merchant(pred), norm_merchant(gold)
    par = parent_of(gold)
    ok_parent = (par.isNotNull() & (p == norm_merchant(par))
                 & (F.coalesce(same_line(gold), F.lit(False))
                    | (F.coalesce(cat_ok, F.lit(False)) if cat_ok is not None else F.lit(False))))
    return F.when(_c(gold).isNull(), F.lit(False)).otherwise(
        ((p == g) & ((g != "") | F.coalesce(_c(pred) == _c(gold), F.lit(False)))) | ok_parent)


def accepted_names(gold, aliases=None) -> Column:
    """Normalised gold, its pipe-separated aliases and its same-line parent."""
    base = F.array(norm_merchant(gold))
    if aliases is not None:
        base = F.array_union(base, F.transform(F.split(F.coalesce(_c(aliases), F.lit("")), r"\|"),
                                               lambda a: norm_merchant(F.trim(a))))
    par = F.when(F.coalesce(same_line(gold), F.lit(False)), norm_merchant(parent_of(gold)))
    base = F.when(par.isNotNull(), F.array_union(base, F.array(par))).otherwise(base)
    return F.filter(base, lambda x: x != "")


def guard_category(pred, allowed, default) -> Column:
    """A category outside the allowed list becomes ``default``."""
    return F.when(_c(pred).isin(*allowed), _c(pred)).otherwise(_c(default) if not isinstance(
        default, str) else F.lit(default))


def guard_merchant(pred, fallback) -> Column:
    """A missing or empty merchant becomes ``fallback``."""
    return F.coalesce(F.nullif(F.trim(_c(pred)), F.lit("")), _c(fallback))


def cluster_key(merchant, txn_type, missing: str | None = "?") -> Column:
    """The resampling cluster of a row: merchant, else its type, else ``missing``."""
    parts = [_c(merchant), _c(txn_type)] + ([F.lit(missing)] if missing is not None else [])
    return F.coalesce(*parts)


def routing_key(merchant, txn_type) -> Column:
    """B28 (routing form): ``type:``-prefixed for merchant-less rows."""
    return F.coalesce(_c(merchant), F.concat(F.lit("type:"), _c(txn_type)))


def headline_keep(origin, noise_abbrev) -> Column:
    """Drop local rows whose descriptor was abbreviated (null flag counts false)."""
    return ~((_c(origin) == "local") & F.coalesce(_c(noise_abbrev), F.lit(False)))


def cascade_select(gate: Column, first, fallback) -> Column:
    """Take ``first`` where the gate holds, else ``fallback``."""
    return F.when(F.coalesce(gate, F.lit(False)), _c(first)).otherwise(_c(fallback))
