"""Fuzzy joins against a known-name list (C5 top-1 with cutoff, C6 top-k, C7 scorer).

Scorer (C7) = token-set ratio: tokens are distinct whitespace words; with I the
shared tokens and x / y the sorted leftover words of each side joined by a space,
s = len(" ".join(I)), la = s + [s>0] + |x|, lb = s + [s>0] + |y|:
  * either side without tokens -> 0; I non-empty and x or y empty -> 100;
  * r0 = 100 - 100 * (|x| + |y| - 2 LCS(x, y)) / (la + lb);
  * if s > 0 also 100 - 100 (1+|x|)/(s+la) and 100 - 100 (1+|y|)/(s+lb);
  * score = the maximum.
``token_set_score`` is that formula as a Column expression over two token arrays
(native array functions plus an Arrow UDF for LCS) for scoring given pairs.

C5 is an index join (``NameIndex``). With c the cutoff / 100, A and B the lengths of the sorted
token strings, a pair that reaches the cutoff does so in one of three ways, each with a probe key
that both sides share:
  * kind 0, by r0: at most (1-c)(A+B) characters differ, so the numbered character pairs (a space
    at both ends) share at least (A+B)(0.5 - 1.5(1-c)) + 1 (a deletion destroys two pairs, an
    insertion one), the lengths differ by at most (1-c)(A+B), and the rarest pairs of both sides, as many as
    that bound asks for, have one in common (prefix filter);
  * kind 1, by |x|: the query's tokens are in the entry, or 1+|x| <= 2(1-c)/c s; of the query's
    rarest tokens, up to the length that may be left over, one is in the entry;
  * kind 2, by |y|: the same from the entry's side.
Probes and postings meet in one equi join on (kind, key); length, overlap and left-over bounds are
checked in the join's output, a pair of kind 0 goes on only at its first common key, and only survivors
reach the LCS kernel. The best entry per query is an aggregate. Rarity is the place among the list's
FREQUENT most frequent keys, a bounded literal; any order gives the same result.

C6 has no cutoff, so every entry is a candidate: the list is checked for size and broadcast, and every
partition of distinct queries is scored against it by one kernel, as are cutoffs below JOIN_CUTOFF
and the other scorers:
  * pairs sharing a token come from an inverted token index and are scored exactly;
  * for pairs without a shared token the score is 100 - 100 (|X| + |Y| - 2 LCS(X, Y)) /
    (|X| + |Y|) on the sorted-token strings. For queries up to 63 characters LCS is
    computed against the whole list at once (bit-parallel, one uint64 lane per list
    entry, numpy); longer queries are pruned with the letter-bag bound
    (LCS <= sum_c min(count_X(c), count_Y(c))) and scored exactly in bound order
    while the bound can still beat the cutoff or the current k-th best.
All are exact (ties: earliest list entry). A list longer than the broadcast limit is
scored in chunks whose winners are merged by an aggregation. The U7 alternative
scorers are ``levenshtein`` (bit-parallel edit distance across the list, 1 - d / max
length) and ``jaccard`` (token sets); both also exist as native Column scorers.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantry import constants as K
from merchantry.functions.text import ws_tokens
from merchantry.session import materialize

MAX_BROADCAST_LIST = 200_000   # list entries per broadcast chunk (C6)
JOIN_CUTOFF = 70.0             # least cutoff of the index join; its overlap bound needs more than 66.7
SCAN_ROWS = 1 << 10            # most queries of a task of C6
FREQUENT = 256                 # keys of a kind whose rarity is told apart
EPS = 1e-9


# ------------------------------------------------------------------ LCS kernel
def lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        m = masks.get(ch)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_len(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


# ------------------------------------------------------------------ scorer
def _score_parts(ta: Column, tb: Column):
    inter = F.array_intersect(ta, tb)
    dab = F.array_sort(F.array_except(ta, tb))
    dba = F.array_sort(F.array_except(tb, ta))
    return inter, dab, dba


def token_set_score(ta: Column, tb: Column, lcs: Column | None = None) -> Column:
    """C7 from token arrays; ``lcs`` = LCS of the joined leftovers (computed by
    ``lcs_udf`` when not given)."""
    inter, dab, dba = _score_parts(ta, tb)
    x, y = F.array_join(dab, " "), F.array_join(dba, " ")
    lx, ly = F.length(x).cast("double"), F.length(y).cast("double")
    s = F.when(F.size(inter) > 0, F.length(F.array_join(inter, " "))).otherwise(0).cast("double")
    sp = F.when(s > 0, 1.0).otherwise(0.0)
    la, lb = s + sp + lx, s + sp + ly
    lcs = (lcs if lcs is not None else lcs_udf(x, y)).cast("double")
    r0 = F.lit(100.0) - F.lit(100.0) * (lx + ly - 2 * lcs) / (la + lb)
    r1 = F.when(s > 0, F.lit(100.0) - F.lit(100.0) * (1 + lx) / (s + la)).otherwise(0.0)
    r2 = F.when(s > 0, F.lit(100.0) - F.lit(100.0) * (1 + ly) / (s + lb)).otherwise(0.0)
    return (F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
            .when((F.size(inter) > 0) & ((F.size(dab) == 0) | (F.size(dba) == 0)), F.lit(100.0))
            .otherwise(F.greatest(r0, r1, r2)))


def levenshtein_score(a: Column, b: Column) -> Column:
    """U7 scorer (native): 100 * (1 - levenshtein / max length); 100 for two empty strings."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / m))


def jaccard_score(ta: Column, tb: Column) -> Column:
    """U7 scorer (native): 100 * |A n B| / |A u B| over distinct tokens; 0 when both empty."""
    u = F.size(F.array_union(ta, tb))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.size(F.array_intersect(ta, tb)) / u)


def levenshtein_py(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def score_py(scorer: str, a: str, b: str) -> float:
    """Plain-Python scorers by name (token_set, levenshtein, jaccard)."""
    if scorer == "token_set":
        return token_set_ratio_py(a, b)
    if scorer == "levenshtein":
        m = max(len(a), len(b))
        return 100.0 if m == 0 else 100.0 * (1.0 - levenshtein_py(a, b) / m)
    if scorer == "jaccard":
        ta, tb = set(a.split()), set(b.split())
        u = len(ta | tb)
        return 0.0 if u == 0 else 100.0 * len(ta & tb) / u
    raise ValueError(f"unknown scorer {scorer!r}")


def token_set_ratio_py(a: str, b: str) -> float:
    """Plain-Python restatement of C7 (used by tests and by the C6 kernel)."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = ta & tb
    dab, dba = sorted(ta - tb), sorted(tb - ta)
    if inter and (not dab or not dba):
        return 100.0
    x, y = " ".join(dab), " ".join(dba)
    s = len(" ".join(sorted(inter)))
    sp = 1 if s else 0
    la, lb = s + sp + len(x), s + sp + len(y)
    best = 100.0 - 100.0 * (len(x) + len(y) - 2 * lcs_len(x, y)) / (la + lb)
    if s:
        best = max(best, 100.0 - 100.0 * (1 + len(x)) / (s + la),
                   100.0 - 100.0 * (1 + len(y)) / (s + lb))
    return best


# ------------------------------------------------------------------ list kernel
class ListIndex:
    """The broadcast side of C5/C6: token postings and a letter-count matrix."""

    def __init__(self, keys: list[str], names: list[str], scorer: str = "token_set"):
        self.names = names
        self.keys = [k or "" for k in keys]
        self.scorer = scorer
        self.tok = [frozenset((k or "").split()) for k in keys]
        self.sx = [" ".join(sorted(t)) for t in self.tok]
        self.lens = np.array([len(x) for x in self.sx], dtype=np.float64)
        alphabet = sorted({ch for x in self.sx for ch in x})
        self.col = {ch: i for i, ch in enumerate(alphabet)}
        self.counts = np.zeros((len(keys), max(len(alphabet), 1)), dtype=np.int32)
        for r, x in enumerate(self.sx):
            for ch in x:
                self.counts[r, self.col[ch]] += 1
        width = max((len(x) for x in self.sx), default=0)
        self.codes = np.full((len(keys), max(width, 1)), -1, dtype=np.int32)
        for r, x in enumerate(self.sx):
            for j, ch in enumerate(x):
                self.codes[r, j] = self.col[ch]
        self.klens = np.array([len(x) for x in self.keys], dtype=np.float64)
        if scorer == "levenshtein":   # raw-key code matrix only where the scorer needs it
            kalpha = sorted({ch for x in self.keys for ch in x})
            self.kcol = {ch: i for i, ch in enumerate(kalpha)}
            kwidth = max((len(x) for x in self.keys), default=0)
            self.kcodes = np.full((len(keys), max(kwidth, 1)), -1, dtype=np.int32)
            for r, x in enumerate(self.keys):
                for j, ch in enumerate(x):
                    self.kcodes[r, j] = self.kcol[ch]
        self.post: dict[str, list[int]] = {}
        for r, t in enumerate(self.tok):
            for w in t:
                self.post.setdefault(w, []).append(r)
        self.empty = np.array([len(t) == 0 for t in self.tok])

    def lcs_all(self, q: str) -> np.ndarray:
        """LCS of ``q`` (<= 63 chars) with every sorted-token string of the list at once:
        bit-parallel LCS with one uint64 lane per list entry."""
        n_alpha = self.counts.shape[1]
        masks = np.zeros(n_alpha + 1, dtype=np.uint64)
        for i, ch in enumerate(q):
            c = self.col.get(ch)
            if c is not None:
                masks[c] |= np.uint64(1 << i)
        full = np.uint64((1 << len(q)) - 1)
        v = np.full(len(self.names), full, dtype=np.uint64)
        for j in range(self.codes.shape[1]):
            c = self.codes[:, j]
            m = masks[np.where(c >= 0, c, n_alpha)]
            u = v & m
            v = ((v + u) | (v - u)) & full
        return len(q) - np.bitwise_count(v).astype(np.int64)

    def lev_all(self, q: str) -> np.ndarray:
        """Levenshtein distance of ``q`` (1..63 chars) to every raw key at once
        (bit-parallel, Hyyrö 2003; one uint64 lane per list entry)."""
        m = len(q)
        masks = np.zeros(len(self.kcol) + 1, dtype=np.uint64)
        for i, ch in enumerate(q):
            c = self.kcol.get(ch)
            if c is not None:
                masks[c] |= np.uint64(1 << i)
        full = np.uint64((1 << m) - 1)
        top = np.uint64(1 << (m - 1))
        one = np.uint64(1)
        n = len(self.names)
        pv = np.full(n, full, dtype=np.uint64)
        mv = np.zeros(n, dtype=np.uint64)
        score = np.full(n, m, dtype=np.int64)
        for j in range(self.kcodes.shape[1]):
            c = self.kcodes[:, j]
            live = c >= 0
            eq = masks[np.where(live, c, len(self.kcol))]
            xv = eq | mv
            xh = ((((eq & pv) + pv) & full) ^ pv) | eq
            ph = (mv | ~(xh | pv)) & full
            mh = pv & xh
            score = np.where(live, score + ((ph & top) != 0) - ((mh & top) != 0), score)
            ph = ((ph << one) | one) & full
            mh = (mh << one) & full
            npv = (mh | ~(xv | ph)) & full
            nmv = ph & xv
            pv = np.where(live, npv, pv)
            mv = np.where(live, nmv, mv)
        return score

    def best(self, query: str, k: int, cutoff: float | None) -> list[tuple[float, int]]:
        """Top-k (score, index) for one query, score desc then index; only scores >=
        cutoff when a cutoff is given."""
        n = len(self.names)
        tq = frozenset((query or "").split())
        if n == 0:
            return []
        if self.scorer == "levenshtein" and 0 < len(query or "") <= 63:
            mlen = np.maximum(len(query), self.klens)
            sc = np.where(mlen == 0, 100.0, 100.0 * (1.0 - self.lev_all(query) / np.maximum(mlen, 1)))
            keep = np.nonzero(sc >= cutoff)[0] if cutoff is not None else np.arange(n)
            order = keep[np.lexsort((keep, -sc[keep]))][:k]
            return [(float(sc[r]), int(r)) for r in order]
        if self.scorer != "token_set":
            sc = np.array([score_py(self.scorer, query or "", k) for k in self.keys])
            keep = np.nonzero(sc >= cutoff)[0] if cutoff is not None else np.arange(n)
            order = keep[np.lexsort((keep, -sc[keep]))][:k]
            return [(float(sc[r]), int(r)) for r in order]
        if not tq:
            return [] if cutoff is not None and cutoff > 0 else [(0.0, i) for i in range(min(k, n))]
        shared = sorted({r for w in tq for r in self.post.get(w, ())})
        scored = {r: token_set_ratio_py(query, " ".join(self.tok[r])) for r in shared}
        xq = " ".join(sorted(tq))
        if 0 < len(xq) <= 63:
            tot = len(xq) + self.lens
            r0 = 100.0 - 100.0 * (tot - 2 * self.lcs_all(xq)) / tot
            r0[self.empty] = 0.0
            if shared:
                sh = np.array(shared)
                r0[sh] = np.array([scored[r] for r in shared])
            keep = np.nonzero(r0 >= cutoff)[0] if cutoff is not None else np.arange(n)
            order = keep[np.lexsort((keep, -r0[keep]))][:k]
            return [(float(r0[r]), int(r)) for r in order]
        qv = np.zeros(self.counts.shape[1], dtype=np.int32)
        for ch in xq:
            c = self.col.get(ch)
            if c is not None:
                qv[c] += 1
        bag = np.minimum(self.counts, qv).sum(axis=1)
        tot_all = len(xq) + self.lens
        upper = 100.0 - 100.0 * (tot_all - 2 * bag) / tot_all  # same float path as the exact score
        upper[self.empty] = 0.0
        if shared:
            upper[np.array(shared)] = -1.0          # already exact
        order = np.lexsort((np.arange(n), -upper))
        floor = cutoff if cutoff is not None else -1.0

        def kth():
            if len(scored) < k:
                return floor
            return max(floor, sorted(scored.values(), reverse=True)[k - 1])
        for r in order:
            ub = upper[r]
            if ub < 0:
                break
            if ub < kth():
                break
            tot = len(xq) + len(self.sx[r])
            scored[r] = 100.0 - 100.0 * (tot - 2 * lcs_len(xq, self.sx[r])) / tot
        res = sorted(((sc, r) for r, sc in scored.items() if cutoff is None or sc >= cutoff),
                     key=lambda t: (-t[0], t[1]))
        if cutoff is None and len(res) < k:
            seen = {r for _, r in res}
            res += [(float(scored.get(r, 0.0)), r) for r in range(n) if r not in seen][: k - len(res)]
            res.sort(key=lambda t: (-t[0], t[1]))
        return res[:k]


def _broadcast_chunks(names: DataFrame, max_broadcast: int, scorer: str = "token_set"):
    """Yield ListIndex broadcasts of the list in ``ord`` order. One bounded collect
    (``max_broadcast + 1`` rows) both checks the size and serves the usual single-chunk
    case; only a longer list is counted and read chunk by chunk."""
    spark = names.sparkSession
    ordered = names.select("key", "name", "ord").orderBy("ord")
    rows = ordered.limit(max_broadcast + 1).collect()
    if len(rows) <= max_broadcast:
        yield spark.sparkContext.broadcast(ListIndex([r["key"] for r in rows], [r["name"] for r in rows], scorer))
        return
    n = names.count()
    for start in range(0, n, max_broadcast):
        part = ordered.offset(start).limit(max_broadcast).collect()
        yield spark.sparkContext.broadcast(ListIndex([r["key"] for r in part], [r["name"] for r in part], scorer))


def _scan(queries: DataFrame, names: DataFrame, k: int, cutoff, max_broadcast: int,
          scorer: str = "token_set") -> DataFrame:
    schema = "query string, _chunk int, _pos array<int>, candidates array<string>, scores array<double>"
    q = materialize(queries.select("query").distinct(), "queries")
    # a short table of texts is many scores: it is dealt to tasks by rows, not by bytes
    cores = q.sparkSession.sparkContext.defaultParallelism
    n = q.count()
    q = q.repartition(max(-(-n // SCAN_ROWS), min(4 * cores, n // 64 + 1)))
    parts = []
    for ci, bc in enumerate(_broadcast_chunks(names, max_broadcast, scorer)):
        def run(it, bc=bc, ci=ci):
            idx = bc.value
            for pdf in it:
                out = {"query": [], "_chunk": [], "_pos": [], "candidates": [], "scores": []}
                for qv in pdf["query"]:
                    best = idx.best(qv, k, cutoff)
                    out["query"].append(qv)
                    out["_chunk"].append(ci)
                    out["_pos"].append([r for _, r in best])
                    out["candidates"].append([idx.names[r] for _, r in best])
                    out["scores"].append([float(sc) for sc, _ in best])
                yield pd.DataFrame(out)
        parts.append(q.mapInPandas(run, schema))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    if len(parts) == 1:
        return res.drop("_chunk", "_pos")
    flat = res.select("query", "_chunk", F.posexplode(F.arrays_zip("candidates", "scores", "_pos")))
    top = flat.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("col.scores")).alias("s"), F.col("_chunk").alias("c"), F.col("col._pos").alias("p"),
        F.col("col.candidates").alias("n")))).alias("all"))
    return top.select("query", F.transform(F.slice("all", 1, k), lambda x: x["n"]).alias("candidates"),
                      F.transform(F.slice("all", 1, k), lambda x: -x["s"]).alias("scores"))


# ------------------------------------------------------------------ index join
def _numbered_pairs(x: Column) -> Column:
    """The character pairs of " x " as longs, equal ones numbered: two code points and the number."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    code = lambda i: F.ascii(F.substr(padded, i, F.lit(1))).cast("long")
    pairs = F.transform(F.sequence(F.lit(1), F.length(x) + 1),
                        lambda i: F.shiftleft(code(i), 42) + F.shiftleft(code(i + 1), 21))
    return pairs


def _sides(df: DataFrame, text: str, tag: str) -> DataFrame:
    """Adds ``{tag}_toks``, ``{tag}_len`` (of the sorted token string) and ``{tag}_pairs``; texts without tokens go."""
    d = df.withColumn(f"{tag}_toks", ws_tokens(text)).filter(F.size(f"{tag}_toks") > 0)
    d = d.withColumn("_x", F.array_join(F.array_sort(f"{tag}_toks"), " ")).withColumn(f"{tag}_len", F.length("_x"))
    d = d.withColumn("_p", F.array_sort(_numbered_pairs(F.col("_x"))))
    number = F.transform("_p", lambda p, i: p + i + 1 - F.array_position("_p", p))
    return d.withColumn(f"{tag}_pairs", number).drop("_x", "_p")


def _rarest_first(keys: Column, frequent: list) -> Column:
    """``keys`` with those outside ``frequent`` (most frequent first) before it, then from its end."""
    if not frequent:
        return F.array_sort(keys)
    place = F.array(*[F.lit(k) for k in frequent])
    rank = lambda k: -F.coalesce(F.nullif(F.array_position(place, k), F.lit(0)), F.lit(len(frequent) + 1))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(rank(k).alias("r"), k.alias("k")))), lambda s: s["k"])


class NameIndex:
    """C5's list side, written once: a posting (kind, key) per probe key of every entry, and the list's
    most frequent keys, which order rarity on both sides."""

    def __init__(self, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF):
        if cutoff < JOIN_CUTOFF:
            raise ValueError(f"the index join needs a cutoff of at least {JOIN_CUTOFF}")
        self.cutoff, self.miss = float(cutoff), 1 - cutoff / 100
        side = materialize(_sides(names.select("key", "name", "ord"), "key", "l"), "name_side")
        most = lambda col: [r[0] for r in side.select(F.explode(col).alias("k")).groupBy("k").agg(
            F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(FREQUENT).collect()]
        self.pairs, self.tokens = most("l_pairs"), most("l_toks")
        self.postings = materialize(self._keys(side, "l").drop("key"), "name_postings")

    def _keys(self, side: DataFrame, tag: str) -> DataFrame:
        """A row per probe key: kind 0 the rarest pairs, kinds 1 and 2 tokens, the query's rarest and all the
        entry's for 1, the other way round for 2."""
        size, ratio = F.col(f"{tag}_len"), 2 * self.miss / (1 - self.miss)
        # least overlap of a pair that reaches the cutoff, whatever the other side's length
        least = (0.5 - 1.5 * self.miss) * (1 + (1 - self.miss) / (1 + self.miss)) * size + 1
        prefix = F.slice(_rarest_first(F.col(f"{tag}_pairs"), self.pairs), F.lit(1),
                         F.greatest(F.lit(1), size + 2 - F.ceil(least - EPS)).cast("int"))
        none = F.slice(F.col(f"{tag}_toks"), 1, 0)
        rare = F.aggregate(
            _rarest_first(F.col(f"{tag}_toks"), self.tokens), F.struct(none.alias("k"), F.lit(-1).alias("n")),
            lambda a, t: F.when(a["n"] + 1 > ratio * (size - a["n"] - 1) + EPS, a).otherwise(
                F.struct(F.concat(a["k"], F.array(t)).alias("k"), (a["n"] + 1 + F.length(t)).alias("n"))),
            lambda a: a["k"])
        own, other = (1, 2) if tag == "q" else (2, 1)
        keyed = lambda kind, keys, f: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), f(k).alias("k")))
        side = side.withColumn(f"{tag}_prefix", prefix)
        keys = F.concat(keyed(0, F.col(f"{tag}_prefix"), lambda k: k), keyed(own, rare, lambda t: F.xxhash64(t)),
                        keyed(other, F.col(f"{tag}_toks"), lambda t: F.xxhash64(t)))
        return side.select("*", F.inline(keys))

    def survivors(self, queries: DataFrame) -> DataFrame:
        """(query, q_toks, name, ord, l_toks): every pair that can reach the cutoff, and few others; a pair may
        be there once per kind."""
        probes = self._keys(_sides(queries.select("query").distinct(), "query", "q"), "q")
        both = F.col("q_len") + F.col("l_len")
        near = F.abs(F.col("q_len") - F.col("l_len")) <= self.miss * both + EPS
        overlap = F.size(F.array_intersect("q_pairs", "l_pairs")) >= (0.5 - 1.5 * self.miss) * both + 1 - EPS
        first = F.array_intersect("q_prefix", "l_prefix")[0] == F.col("k")
        shared = F.length(F.array_join(F.array_intersect("q_toks", "l_toks"), " "))
        rest = F.when(F.col("kind") == 1, F.col("q_len")).otherwise(F.col("l_len")) - shared      # 1 + |x|, 0 without x
        covered = rest <= 2 * self.miss / (1 - self.miss) * shared + EPS
        j = probes.join(self.postings, ["kind", "k"])
        return j.filter(F.when(F.col("kind") == 0, near & overlap & first).otherwise(covered)).select(
            "query", "q_toks", "name", "ord", "l_toks")

    def best(self, queries: DataFrame) -> DataFrame:
        scored = self.survivors(queries).withColumn("score", token_set_score(F.col("q_toks"), F.col("l_toks")))
        return (scored.filter(F.col("score") >= self.cutoff).groupBy("query")
                .agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("b"))
                .select("query", "b.name", "b.score"))


def fuzzy_top1(queries: DataFrame, names: DataFrame | NameIndex, cutoff: float = K.FUZZY_CUTOFF,
               max_broadcast: int = MAX_BROADCAST_LIST, scorer: str = "token_set") -> DataFrame:
    """Best list entry scoring >= ``cutoff`` for every distinct query (earliest list
    entry on ties). ``queries``: (query); ``names``: (key, name, ord), or a ``NameIndex`` made for the cutoff.
    Returns (query, name, score) for matched queries only."""
    if isinstance(names, NameIndex):
        return names.best(queries)
    if scorer == "token_set" and cutoff >= JOIN_CUTOFF:
        return NameIndex(names, cutoff).best(queries)
    res = _scan(queries, names, 1, float(cutoff), max_broadcast, scorer)
    return (res.filter(F.size("candidates") > 0)
            .select("query", F.col("candidates")[0].alias("name"), F.col("scores")[0].alias("score")))


def fuzzy_topk(queries: DataFrame, names: DataFrame, k: int = K.TOP_K,
               max_broadcast: int = MAX_BROADCAST_LIST, scorer: str = "token_set") -> DataFrame:
    """The ``k`` best list names per distinct query (score desc, then list order),
    no cutoff. Returns (query, candidates, scores)."""
    return _scan(queries, names, k, None, max_broadcast, scorer)


def fuzzy_top1_rows(df: DataFrame, query_col: str, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF,
                    out: str = "_match", max_broadcast: int = MAX_BROADCAST_LIST) -> DataFrame:
    """C5 row by row: adds ``out`` (best name >= cutoff or null) to every row, keeping all
    columns. No distinct and no join back, so it also runs on a stream (S4)."""
    chunks = list(_broadcast_chunks(names, max_broadcast))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, `{out}` string, `{out}_score` double"

    def run(it):
        idxs = [bc.value for bc in chunks]
        for pdf in it:
            names_out, scores_out = [], []
            for qv in pdf[query_col]:
                best = None
                for idx in idxs:
                    b = idx.best(qv, 1, float(cutoff))
                    if b and (best is None or b[0][0] > best[0]):
                        best = (b[0][0], idx.names[b[0][1]])
                names_out.append(best[1] if best else None)
                scores_out.append(best[0] if best else None)
            pdf = pdf.copy()
            pdf[out] = names_out
            pdf[f"{out}_score"] = scores_out
            yield pdf
    return df.mapInPandas(run, schema)
