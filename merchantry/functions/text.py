"""Descriptor text functions as Spark Column expressions.

All of them are chains of built-in string/regex/array functions, so they stay inside
whole-stage codegen and never leave the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry import constants as K

# Regex patterns shared with the SQL twins (plans/sql.py). They avoid look-around so
# the same pattern runs under Java regex and RE2.
PROCESSOR_PREFIX = (r"(?i)^\s*(?:(?:SQ|TST|PP|PAYPAL|SP)\s*\*\s*"
                    r"|(?:POS\s*DEBIT|DEBIT\s*CARD\s*PURCHASE|PURCHASE|ACH)($|[^A-Za-z0-9]))")
IDS = r"(?i)(#\d+|TXN\d+)"
PAREN = r"\([^)]*\)"
EDGE_WS = r"^\s+|\s+$"
WS = " \t\n\x0b\f\r"        # what \s matches in Java
DANGLING = r"^[\s\-]+|[\s\-]+$"
# Drops a trailing "Hospital" after another token, except when the whole text is a
# hospital merchant (exact, case-sensitive). \x01 anchors the exception at the start.
HOSPITAL_MARK = "\x01"
NON_ALNUM = r"[^a-z0-9]"
POSSESSIVE = r"['’]s\b"
PARK = "\ue000"  # private-use marker that parks protected names

_REGEX_SPECIAL = set(".^$*+?()[]{}|\\")


def regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in s)


def words_pattern(words) -> str:
    return r"(?i)\b(" + "|".join(regex_escape(w) for w in words) + r")\b"


TRAILING_HOSPITAL = ("^" + HOSPITAL_MARK + "(" + "|".join(regex_escape(h) for h in K.HOSPITAL_MERCHANTS)
                     + r")$|(?i:(\S)\s+Hospital)$")
TIME_RE = words_pattern(K.TIME_PHRASES)
FORMAT_RE = words_pattern(K.FORMAT_WORDS)
COUNTRY_RE = words_pattern(K.COUNTRIES)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _holds(s: Column, words) -> Column:
    """True when the text holds one of ``words``, ASCII letters in either case: a cheap condition that every match
    of a case-insensitive pattern with these words meets."""
    low, found = F.lower(s), None
    for w in dict.fromkeys(w.lower() for w in words):
        hit = F.contains(low, F.lit(w))
        found = hit if found is None else found | hit
    return found


def _replaced(c: Column, needs, pattern: str, by: str) -> Column:
    """``regexp_replace`` that looks only at texts for which ``needs`` holds (every text with a match)."""
    return bound(c, lambda s: F.when(needs(s), F.regexp_replace(s, pattern, by)).otherwise(s))


def strip_ws(c) -> Column:
    """Trim every ASCII whitespace character at both ends (``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), EDGE_WS, "")


def strip_processor_prefix(c) -> Column:
    """B1: drop one leading payment wrapper (``SQ *``, ``PP*``, ``POS DEBIT`` ...)."""
    return strip_ws(F.regexp_replace(_c(c), PROCESSOR_PREFIX, "$1"))


def clean_description(c) -> Column:
    """B2: drop ``#123``/``TXN123`` ids, lower-case, collapse whitespace, trim."""
    s = F.lower(F.regexp_replace(_c(c), IDS, " "))
    return strip_ws(F.regexp_replace(s, r"\s+", " "))


def derive_canonical(c) -> Column:
    """Best-effort canonical merchant name from a noisy source description."""
    holds = lambda *words: lambda s: _holds(s, words)
    s = _replaced(_c(c), holds("("), PAREN, " ")
    s = _replaced(s, holds("#", "TXN"), IDS, " ")
    for i, name in enumerate(K.PROTECTED_NAMES):
        s = _replaced(s, holds(name), "(?i)" + regex_escape(name), f"{PARK}{i}{PARK}")
    s = _replaced(s, holds(*K.TIME_PHRASES), TIME_RE, " ")
    s = _replaced(s, holds(*K.FORMAT_WORDS), FORMAT_RE, " ")
    s = _replaced(s, holds(*K.COUNTRIES), COUNTRY_RE, " ")
    for i, name in enumerate(K.PROTECTED_NAMES):
        s = F.replace(s, F.lit(f"{PARK}{i}{PARK}"), F.lit(name))
    s = F.replace(s, F.lit(" - "), F.lit(" "))
    s = _replaced(s, holds("  ", *WS.strip(" ")), r"\s+", " ")
    # Java's $ also matches before a last line end, and not all of these are ASCII
    s = bound(s, lambda t: F.when(F.length(t) == F.octet_length(t), F.btrim(t, F.lit(WS + "-"))).otherwise(
        strip_ws(F.regexp_replace(t, DANGLING, ""))))
    s = bound(s, lambda t: F.when(_holds(t, ["Hospital"]), F.regexp_replace(
        F.concat(F.lit(HOSPITAL_MARK), t), TRAILING_HOSPITAL, "$1$2")).otherwise(t))
    return F.replace(s, F.lit(HOSPITAL_MARK), F.lit(""))


def residual_noise(c) -> Column:
    """True when a canonical text still carries an id, a parenthetical or a country."""
    c = _c(c)
    return c.rlike(IDS) | c.rlike(PAREN) | c.rlike(COUNTRY_RE)


def norm_merchant(c) -> Column:
    """Lower-case, keep only ``[a-z0-9]``; null becomes ''."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), NON_ALNUM, "")


def name_tokens(c) -> Column:
    """Distinct lower-case alphanumeric tokens after dropping possessive 's."""
    s = F.regexp_replace(F.lower(_c(c)), POSSESSIVE, "")
    toks = F.regexp_extract_all(s, F.lit(r"([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(w) for w in K.NAME_STOP_WORDS])
    return F.array_distinct(F.array_except(toks, stop))


def abbreviate(c) -> Column:
    """Words longer than 4 chars keep their first letter and lose later vowels."""
    return F.array_join(F.transform(F.split(_c(c), " "), lambda w: F.when(
        F.length(w) > 4,
        F.concat(F.substring(w, 1, 1),
                 F.regexp_replace(F.substring(w, 2, 1 << 30),
                                  "[aeiouAEIOU]", ""))).otherwise(w)), " ")


def letter_counts(c) -> Column:
    """26 counts of the letters a-z in the lower-cased text (a toy encoder)."""
    s = F.lower(_c(c))
    return F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))).cast("float")
                     for ch in "abcdefghijklmnopqrstuvwxyz"])


def ws_tokens(c) -> Column:
    """Distinct whitespace-separated words (the token-set scorer's tokens)."""
    s = strip_ws(_c(c))
    return F.array_distinct(F.filter(F.split(s, r"\s+"), lambda w: w != ""))


def conflict_key(merchant, txn_type) -> Column:
    """Merchant and txn_type joined by the unit separator."""
    return F.concat(F.coalesce(_c(merchant), F.lit("")), F.lit("\x1f"),
                    F.coalesce(_c(txn_type), F.lit("")))


def relative_error(a, b) -> Column:
    """``|a-b| / max(|a|, 1e-9)``."""
    return F.abs(_c(a) - _c(b)) / F.greatest(F.abs(_c(a)), F.lit(1e-9))
