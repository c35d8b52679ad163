"""DuckDB twin of the test-data mapping: CTEs that define ``raw``, ``feed`` and ``gold``
from the pre-registered tables, exactly as ``plans/testdata.py`` does on Spark."""
from __future__ import annotations

from merchantry import constants as K
from merchantry.operators.synth import LOCAL_CATEGORIES, ZIPF_SCALE
from merchantry.plans import sql as Q
from merchantry.plans.sql import Sql, arr, choose, dbl, hash52, hkey, int_between, pick, q, uniform
from merchantry.plans.testdata import (CURRENCY, DECOR_P, MERCHANT_CATEGORIES, PAREN_HINTS,
                                       TYPE_CATEGORY, TYPE_LABELS)

SEED = str(K.SEED)


def _zipf_sql(max_n: int, s: float) -> str:
    r = "(k + 1)::DOUBLE"
    den = r if s == 1.0 else (f"({r} * sqrt({r}))" if s == 1.5 else f"pow({r}, {dbl(s)})")
    return f"""(
  SELECT n, k, hi - w AS lo, hi, total FROM (
    SELECT n, k, w,
           sum(w) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
           sum(w) OVER (PARTITION BY n) AS total
    FROM (SELECT n, k, floor({dbl(float(ZIPF_SCALE))} / {den})::BIGINT AS w
          FROM (SELECT n, unnest(range(0, n)) AS k FROM (SELECT range AS n FROM range(1, {max_n + 1}))))))"""


def _raw_ctes() -> list[str]:
    eid = Sql("event_id::VARCHAR")
    u = lambda tag: uniform(hkey("decor", tag, eid))
    tcat = Q.case_map("_tlabel", {k: q(v) for k, v in TYPE_CATEGORY.items()})
    cur = Q.case_map("country", {k: q(v) for k, v in CURRENCY.items()})
    return [
        "_nparts AS (SELECT count(*) AS n FROM part)",
        f"""_ev AS (SELECT event_id, ts, user_id, event_type, value,
              {hash52(hkey('part', eid))} % (SELECT n FROM _nparts) AS _pk FROM events)""",
        f"""_r0 AS (SELECT e.*, {Q.initcap_words('p.p_name')} AS _name,
              event_type = 'signup' AS _is_type,
              {choose(TYPE_LABELS, pick(hkey('type', eid), len(TYPE_LABELS)))} AS _tlabel,
              {choose(K.COUNTRIES, pick(hkey('country', eid), len(K.COUNTRIES)))} AS country
            FROM _ev e JOIN part p ON e._pk = p.p_partkey)""",
        f"""_r1 AS (SELECT *, CASE WHEN _is_type THEN _tlabel ELSE _name END AS label,
              CASE WHEN _is_type THEN {tcat} ELSE
                {choose(MERCHANT_CATEGORIES, pick(hkey('category', Sql('_name')), len(MERCHANT_CATEGORIES)))}
              END AS category FROM _r0)""",
        f"""raw AS (SELECT event_id AS row_id,
              label
              || CASE WHEN {u('store')} < {dbl(DECOR_P['store'])} THEN ' #' || {int_between(hkey('storeno', eid), 100, 9999)}::VARCHAR ELSE '' END
              || CASE WHEN {u('country')} < {dbl(DECOR_P['country'])} THEN ' - ' || country ELSE '' END
              || CASE WHEN {u('format')} < {dbl(DECOR_P['format'])} THEN ' ' || {choose(K.FORMAT_WORDS, pick(hkey('formatword', eid), len(K.FORMAT_WORDS)))} ELSE '' END
              || CASE WHEN {u('time')} < {dbl(DECOR_P['time'])} THEN ' - ' || {choose(K.TIME_PHRASES, pick(hkey('timeword', eid), len(K.TIME_PHRASES)))} ELSE '' END
              || CASE WHEN {u('paren')} < {dbl(DECOR_P['paren'])} THEN ' (' || {choose(PAREN_HINTS, pick(hkey('parenword', eid), len(PAREN_HINTS)))} || ')' ELSE '' END
              AS transaction_description,
              category, country, {cur} AS currency, user_id AS customer_no,
              value AS amount_abs, CAST(ts AS DATE) AS posted_date FROM _r1)""",
    ]


def _locals_ctes() -> list[str]:
    kc = len(LOCAL_CATEGORIES)
    n = K.LOCAL_MERCHANTS_N
    m = (n // kc + 1) * 4
    key = lambda tag: hkey(SEED, Sql("category"), Sql("i::VARCHAR"), tag)
    ns = len(K.LOCAL_SURNAMES)

    def by_cat(mapping, tag):
        parts = " ".join(f"WHEN category = {q(c)} THEN {choose(items, pick(key(tag), len(items)))}"
                         for c, items in mapping.items())
        return f"(CASE {parts} END)"

    s_idx = pick(key("s"), ns)
    name = by_cat(K.LOCAL_TEMPLATES, "t")
    for ph, val in [("{s2}", choose(K.LOCAL_SURNAMES, f"(({s_idx}) + 1 + {pick(key('s2'), ns - 1)}) % {ns}")),
                    ("{s}", choose(K.LOCAL_SURNAMES, s_idx)),
                    ("{p}", choose(K.LOCAL_PLACES, pick(key("p"), len(K.LOCAL_PLACES)))),
                    ("{a}", choose(K.LOCAL_ADJECTIVES, pick(key("a"), len(K.LOCAL_ADJECTIVES)))),
                    ("{x}", choose(K.LOCAL_ANIMALS, pick(key("x"), len(K.LOCAL_ANIMALS)))),
                    ("{n}", by_cat(K.LOCAL_NOUNS, "n"))]:
        name = f"replace({name}, {q(ph)}, {val})"
    quota = Q.case_map("category", {c: str(n // kc + (1 if ci < n % kc else 0))
                                    for ci, c in enumerate(LOCAL_CATEGORIES)})
    return [
        f"""_cand0 AS (SELECT range AS cid, {arr(LOCAL_CATEGORIES)}[(range % {kc}) + 1] AS category,
              range // {kc} AS i FROM range(0, {kc * m}))""",
        f"_cand AS (SELECT *, {name} AS name FROM _cand0)",
        f"""_banned AS (SELECT DISTINCT unnest({Q.name_tokens_sorted('label')}) AS tok
              FROM (SELECT DISTINCT coalesce(merchant, txn_type) AS label FROM _base))""",
        f"""_bad AS (SELECT DISTINCT cid FROM (SELECT cid, unnest({Q.name_tokens_sorted('name')}) AS tok
              FROM _cand) WHERE tok IN (SELECT tok FROM _banned))""",
        "_ok AS (SELECT * FROM _cand WHERE cid NOT IN (SELECT cid FROM _bad))",
        "_ok2 AS (SELECT * FROM _ok WHERE cid IN (SELECT min(cid) FROM _ok GROUP BY name))",
        f"""_locals AS (SELECT name, category, rank FROM (SELECT *, row_number() OVER
              (PARTITION BY category ORDER BY i) - 1 AS rank FROM _ok2) WHERE rank < {quota})""",
    ]


def feed_ctes(hard: bool = True) -> str:
    """CTE list (without ``WITH``) defining raw, feed and gold."""
    merchant, txn_type = Q.gold_merchant_sql("canonical", "category")
    ctes = _raw_ctes()
    ctes += [
        f"""_base0 AS (SELECT *, printf('T%08d', row_id::BIGINT) AS txn_id,
              {Q.derive_canonical('transaction_description')} AS canonical FROM raw)""",
        f"_base AS (SELECT *, {merchant} AS merchant, {txn_type} AS txn_type FROM _base0)",
    ]
    ctes += _locals_ctes()
    nl = K.LOCAL_MERCHANTS_N // len(LOCAL_CATEGORIES) + 1
    ctes += [
        f"_zipf_local AS {_zipf_sql(nl, K.LOCAL_ZIPF_S)}",
        f"_zipf_loc AS {_zipf_sql(K.LOCATIONS_CAP, K.LOCATIONS_ZIPF_S)}",
        """_first AS (SELECT merchant, min(row_id) AS _first FROM _base WHERE merchant IS NOT NULL
              GROUP BY merchant)""",
        "_nlocal AS (SELECT category, count(*) AS _nloc FROM _locals GROUP BY category)",
        f"""_o1 AS (SELECT b.*, f._first, n._nloc,
              (b.merchant IS NOT NULL AND n._nloc IS NOT NULL AND b.row_id <> f._first
               AND {Q.in_eval("'local|' || b.txn_id", K.LOCAL_MERCHANT_SHARE)}) AS _move,
              {hash52(hkey('localpick', Sql('b.txn_id')))} AS _zh
            FROM _base b LEFT JOIN _first f ON b.merchant = f.merchant
            LEFT JOIN _nlocal n ON b.category = n.category)""",
        """_o2 AS (SELECT o.*, z.k AS _lrank FROM _o1 o LEFT JOIN _zipf_local z
              ON o._nloc = z.n AND o._zh % z.total >= z.lo AND o._zh % z.total < z.hi)""",
        """_o3 AS (SELECT o.*, l.name AS _lname FROM _o2 o LEFT JOIN _locals l
              ON o._move AND o.category = l.category AND o._lrank = l.rank)""",
        """_o4 AS (SELECT *, CASE WHEN _move THEN 'local' WHEN merchant IS NOT NULL THEN 'source' END AS origin,
              CASE WHEN _move THEN _lname ELSE coalesce(merchant, txn_type) END AS name,
              CASE WHEN _move THEN _lname ELSE canonical END AS text FROM _o3)""",
    ]
    if hard:
        ctes += [
            "_cnt AS (SELECT name, count(*) AS _cnt FROM _o4 GROUP BY name)",
            f"""_h1 AS (SELECT o.*, least({K.LOCATIONS_CAP}, ceil(c._cnt / {K.LOCATIONS_ROWS_PER}))::BIGINT AS _nl,
                  {hash52(hkey('loc', Sql('o.txn_id')))} AS _zh2
                FROM _o4 o LEFT JOIN _cnt c ON o.name = c.name)""",
            """_h2 AS (SELECT h.*, z.k AS location FROM _h1 h LEFT JOIN _zipf_loc z
                  ON h._nl = z.n AND h._zh2 % z.total >= z.lo AND h._zh2 % z.total < z.hi)""",
            "_rep AS (SELECT name, location, arg_min({'t': text}, row_id).t AS _text FROM _h2 GROUP BY name, location)",
            """_n0 AS (SELECT h.*, r._text, h.name || '|' || h.location::VARCHAR AS _nkey FROM _h2 h
                  LEFT JOIN _rep r ON h.name = r.name AND h.location = r.location)""",
        ]
        prev = "_n0"
        for i, stage in enumerate(Q.noisy_descriptor_stages("_text", "_nkey")):
            ctes.append(f"_n{i + 1} AS (SELECT *, {', '.join(stage)} FROM {prev})")
            prev = f"_n{i + 1}"
    else:
        ctes.append("""_n0 AS (SELECT *, CASE WHEN origin = 'local' THEN name ELSE transaction_description END
                          AS description, FALSE AS noise_abbrev, FALSE AS noise_trunc FROM _o4)""")
        prev = "_n0"
    dirn0 = "CASE WHEN category = 'Income' THEN 'incoming' ELSE 'outgoing' END"
    ctes += [
        f"""_f AS (SELECT *, {Q.refund_flip(f'({dirn0})', hkey(SEED, 'refund', Sql('txn_id')))} AS direction,
              {Q.weighted_choice('category', uniform(hkey(SEED, 'pm', Sql('txn_id'))))} AS payment_method
            FROM {prev})""",
        f"""feed AS (SELECT txn_id, printf('C%05d', customer_no::BIGINT) AS customer_id, description,
              {Q.type_code('payment_method', 'direction')} AS transaction_type_code,
              {Q.noisy_mcc('category', hkey(SEED, 'mcc', Sql('txn_id')))} AS mcc,
              CASE WHEN direction = 'incoming' THEN amount_abs ELSE -amount_abs END AS amount,
              payment_method, posted_date, country, currency FROM _f)""",
        """gold AS (SELECT txn_id, category,
              CASE WHEN origin IS NOT NULL THEN name END AS canonical_merchant,
              CASE WHEN origin IS NULL THEN name END AS txn_type,
              direction, origin, noise_abbrev, noise_trunc FROM _f)""",
    ]
    return ",\n".join(ctes)


def with_feed(select: str, extra_ctes: list[str] | None = None, hard: bool = True,
              recursive: bool = False) -> str:
    body = feed_ctes(hard)
    if extra_ctes:
        body += ",\n" + ",\n".join(extra_ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"
