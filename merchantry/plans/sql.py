"""DuckDB SQL twins of the column functions, used only by ``oracle_sql()``.

Each helper takes SQL expression text and returns SQL expression text. They are the
independent second implementation the correctness gate compares against, written
against DuckDB's dialect (RE2 regex, ``'g'`` flag for global replace, ``lambda``).
"""
from __future__ import annotations

from merchantry import constants as K
from merchantry.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def arr(items) -> str:
    return "[" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in items) + "]"


def choose(items, idx: str) -> str:
    return f"({arr(items)})[({idx}) + 1]"


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def hkey(*parts) -> str:
    return "concat_ws(':', " + ", ".join(p if isinstance(p, Sql) else q(str(p))
                                         for p in parts) + ")"


class Sql(str):
    """Marks a string as SQL expression text (not a literal) inside ``hkey``."""


def hash52(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT)"


def uniform(key: str) -> str:
    return f"({hash52(key)} / 4503599627370496.0e0)"


def pick(key: str, n) -> str:
    return f"({hash52(key)} % ({n}))"


def int_between(key: str, lo: int, hi: int) -> str:
    return f"({lo} + {pick(key, hi - lo + 1)})"


def sha1_mod(key: str, m: int = 1000) -> str:
    h = f"sha1({key})"
    r = "0::BIGINT"
    for i in range(5):
        chunk = f"(('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT)"
        r = f"(({r} * 4294967296 + {chunk}) % {m})"
    return r


def in_eval(key: str, frac: float) -> str:
    return f"({sha1_mod(key)} < {dbl(frac * 1000)})"


# ------------------------------------------------------------------ text functions
def strip_ws(e: str) -> str:
    return rx(e, T.EDGE_WS, "")


def strip_processor_prefix(e: str) -> str:
    return strip_ws(f"regexp_replace({e}, {q(T.PROCESSOR_PREFIX)}, '\\1')")


def clean_description(e: str) -> str:
    return strip_ws(rx(f"lower({rx(e, T.IDS, ' ')})", r"\s+", " "))


def derive_canonical(e: str) -> str:
    s = rx(e, T.PAREN, " ")
    s = rx(s, T.IDS, " ")
    for i, name in enumerate(K.PROTECTED_NAMES):
        s = rx(s, "(?i)" + T.regex_escape(name), f"{T.PARK}{i}{T.PARK}")
    s = rx(s, T.TIME_RE, " ")
    s = rx(s, T.FORMAT_RE, " ")
    s = rx(s, T.COUNTRY_RE, " ")
    for i, name in enumerate(K.PROTECTED_NAMES):
        s = f"replace({s}, {q(f'{T.PARK}{i}{T.PARK}')}, {q(name)})"
    s = f"replace({s}, ' - ', ' ')"
    s = rx(s, r"\s+", " ")
    s = strip_ws(rx(s, T.DANGLING, ""))
    s = f"regexp_replace({q(T.HOSPITAL_MARK)} || {s}, {q(T.TRAILING_HOSPITAL)}, '\\1\\2')"
    return f"replace({s}, {q(T.HOSPITAL_MARK)}, '')"


def norm_merchant(e: str) -> str:
    return rx(f"lower(coalesce({e}, ''))", T.NON_ALNUM, "")


def name_tokens_sorted(e: str) -> str:
    """Sorted distinct name tokens (DuckDB's list_distinct does not keep order)."""
    s = rx(f"lower({e})", T.POSSESSIVE, "")
    stop = arr(K.NAME_STOP_WORDS)
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({s}, '([a-z0-9]+)', 1), "
            f"lambda t: NOT list_contains({stop}, t))))")


def abbreviate(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, ' '), lambda w: CASE WHEN "
            f"length(w) > 4 THEN substr(w, 1, 1) || regexp_replace(substr(w, 2), "
            f"'[aeiouAEIOU]', '', 'g') ELSE w END), ' ')")


def initcap_words(e: str) -> str:
    """Spark ``initcap`` for single-space separated words."""
    return (f"array_to_string(list_transform(string_split(lower({e}), ' '), lambda w: "
            f"upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


# ------------------------------------------------------------------ label rules
def case_map(e: str, mapping: dict, default: str = "NULL") -> str:
    parts = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items())
    return f"(CASE {e} {parts} ELSE {default} END)"


def gold_merchant_sql(canon: str, cat: str) -> tuple[str, str]:
    non = ", ".join(q(x) for x in K.NON_MERCHANT_LABELS)
    split_parts = []
    for label, by_cat in K.CATEGORY_SPLIT_LABELS.items():
        split_parts.append(f"WHEN {canon} = {q(label)} THEN "
                           + case_map(cat, {c: q(v) for c, v in by_cat.items()}))
    split = f"(CASE {' '.join(split_parts)} ELSE NULL END)"
    merged = f"coalesce({case_map(canon, {k: q(v) for k, v in K.LABEL_MERGES.items()})}, {canon})"
    merchant = f"(CASE WHEN {canon} IN ({non}) THEN NULL ELSE coalesce({split}, {merged}) END)"
    txn_type = f"(CASE WHEN {canon} IN ({non}) THEN {canon} END)"
    return merchant, txn_type


def parent_of(g: str) -> str:
    return case_map(g, {k: q(v[0]) for k, v in K.PARENT_BRANDS.items()})


def same_line(g: str) -> str:
    return case_map(g, {k: ("TRUE" if v[1] else "FALSE") for k, v in K.PARENT_BRANDS.items()})


def merchant_ok(p: str, g: str, cat_ok: str = "FALSE") -> str:
    par = parent_of(g)
    return (f"(CASE WHEN {g} IS NULL THEN FALSE ELSE ({norm_merchant(p)} = {norm_merchant(g)} "
            f"AND ({norm_merchant(g)} <> '' OR coalesce({p} = {g}, FALSE))) "
            f"OR ({par} IS NOT NULL AND {norm_merchant(p)} = {norm_merchant(par)} AND "
            f"(coalesce({same_line(g)}, FALSE) OR coalesce({cat_ok}, FALSE))) END)")


def category_ok(p: str, g: str) -> str:
    return f"coalesce({p} = {g}, FALSE)"


# ------------------------------------------------------------------ synthesis
def weighted_choice(cat: str, u: str) -> str:
    parts = []
    for c, weights in K.METHOD_PRIORS.items():
        acc, ladder = 0.0, []
        items = list(weights.items())
        for i, (m, w) in enumerate(items):
            acc += w
            ladder.append(f"WHEN {u} < {dbl(acc)} THEN {q(m)}" if i < len(items) - 1
                          else f"ELSE {q(m)}")
        parts.append(f"WHEN {cat} = {q(c)} THEN (CASE {' '.join(ladder)} END)")
    n = len(K.PAYMENT_METHODS)
    return (f"(CASE {' '.join(parts)} ELSE "
            f"{choose(K.PAYMENT_METHODS, f'floor({u} * {n})::BIGINT')} END)")


def type_code(method: str, dirn: str) -> str:
    return (f"((CASE WHEN {dirn} = 'incoming' THEN 'I' ELSE 'O' END) || '-' || "
            f"{case_map(method, {k: q(v) for k, v in K.METHOD_CODES.items()})})")


def mcc_for(cat: str, key: str) -> str:
    parts = " ".join(f"WHEN {cat} = {q(c)} THEN ({arr(codes)})[{pick(key, len(codes))} + 1]"
                     for c, codes in K.CATEGORY_MCC.items())
    return f"(CASE {parts} END)"


def noisy_mcc(cat: str, key: str) -> str:
    cats = K.CATEGORIES
    cat_idx = f"(list_position({arr(cats)}, {cat}) - 1)"
    j = pick(hkey(Sql(key), "other"), len(cats) - 1)
    other = choose(cats, f"{j} + (CASE WHEN {j} >= {cat_idx} THEN 1 ELSE 0 END)")
    mcc_cat = (f"(CASE WHEN {uniform(hkey(Sql(key), 'noise'))} < {dbl(K.MCC_NOISE)} "
               f"THEN {other} ELSE {cat} END)")
    present = (f"({cat} NOT IN ('Income', 'Financial Services') AND "
               f"{uniform(hkey(Sql(key), 'present'))} < {dbl(K.MCC_COVERAGE)})")
    return f"(CASE WHEN {present} THEN {mcc_for(mcc_cat, hkey(Sql(key), 'code'))} END)::INTEGER"


def refund_flip(dirn: str, key: str) -> str:
    return (f"(CASE WHEN {dirn} = 'outgoing' AND {uniform(key)} < {dbl(K.REFUND_RATE)} "
            f"THEN 'incoming' ELSE {dirn} END)")


def noisy_descriptor_stages(text: str, key: str) -> list[list[str]]:
    """B14 as CTE stages: each inner list is a SELECT list computed on the previous stage
    (``*`` is implied), so no sub-expression is repeated textually."""
    P = K.NOISE_P
    u = lambda tag: uniform(hkey(Sql(key), tag))
    punct = "[" + chr(39) + ",.&]"
    return [
        [f"CASE WHEN {u('punct')} < {dbl(P['drop_punct'])} THEN {rx(text, punct, '')} "
         f"ELSE {text} END AS _m0"],
        [f"CASE WHEN {u('upper')} < {dbl(P['upper'])} THEN upper(_m0) ELSE _m0 END AS _m1"],
        [f"{abbreviate('_m1')} AS _ab", f"{u('abbrev')} < {dbl(K.ABBREV_P)} AS _do_ab"],
        ["_do_ab AND _ab <> _m1 AS noise_abbrev",
         "CASE WHEN _do_ab THEN _ab ELSE _m1 END AS _m"],
        [f"CASE WHEN {u('store')} < {dbl(P['store_id'])} THEN "
         f"{choose(K.ID_SUFFIX_MARKS, pick(hkey(Sql(key), 'mark'), len(K.ID_SUFFIX_MARKS)))} || "
         f"{int_between(hkey(Sql(key), 'storeno'), 100, 99999)}::VARCHAR END AS _store",
         f"{u('city')} < {dbl(P['city'])} AS _has_city",
         f"{u('region')} < {dbl(P['region'])} AS _has_region",
         f"CASE WHEN {u('phone')} < {dbl(P['phone'])} THEN "
         f"{int_between(hkey(Sql(key), 'area'), 200, 999)}::VARCHAR || "
         f"{int_between(hkey(Sql(key), 'line'), 1000000, 9999999)}::VARCHAR END AS _phone",
         f"{u('trunc')} < {dbl(P['truncate'])} AS _do_cut",
         f"{int_between(hkey(Sql(key), 'cut'), 20, 25)} AS _cut",
         f"{u('prefix')} < {dbl(P['prefix'])} AS _do_prefix",
         f"{choose(K.HARD_PREFIXES, pick(hkey(Sql(key), 'prefixname'), len(K.HARD_PREFIXES)))} AS _prefix",
         f"{u('squash')} < {dbl(P['squash'])} AS _do_squash",
         f"{choose(K.HARD_CITIES, pick(hkey(Sql(key), 'cityname'), len(K.HARD_CITIES)))} AS _cityname",
         f"{choose(K.HARD_REGIONS, pick(hkey(Sql(key), 'regionname'), len(K.HARD_REGIONS)))} AS _regionname"],
        ["concat_ws(' ', _m, _store, CASE WHEN _has_city THEN _cityname END, "
         "CASE WHEN _has_city AND _has_region THEN _regionname END, _phone) AS _d0",
         "_do_cut AND _cut < length(_m) AS noise_trunc"],
        ["CASE WHEN _do_cut THEN substr(_d0, 1, _cut) ELSE _d0 END AS _d1"],
        ["CASE WHEN _do_prefix THEN _prefix || _d1 ELSE _d1 END AS _d2"],
        [f"{strip_ws(f'CASE WHEN _do_squash THEN {rx(chr(95) + 'd2', r'\s+', '')} ELSE _d2 END')} "
         f"AS description"],
    ]
