"""Exact top-k by inner product (pivot table, bounds, candidates in bound order).

Components are turned into ``floor(scale * x)``. Distances to a few pivots are computed once per
vector; for a query q, a vector x and a pivot p, ``|d(q,p) - d(x,p)|`` is a lower bound of
``d(q,x)``, the largest over all pivots (the origin is always one) is used, and with
``q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2`` it gives an upper bound of the score. A query's
candidates are evaluated in the order of that bound until it falls below the k-th best score, so
the result is exact; ties stay in because only a smaller bound stops the search.

Vectors and queries are dealt by hash to a grid of cells: at most about ``CELL_VECTORS`` vectors and
``CELL_QUERIES`` queries meet in one cell, the k best of each cell are merged per query. Nothing
but the pivots (``PIVOTS`` vectors with the smallest id hash) passes through the driver.

Defined cases: null vectors and vectors with a null, NaN or infinite component take no part, nor do
rows with a null id; components are held as 64-bit integers, and vectors so long that an inner product might not fit 64 bits
raise an error; only vectors of the same length are
compared; rows with a query's own id are no candidates; other repeated rows each count; a repeated
query row is one query, a query id with different vectors is a query for each of them, ranked apart
(``query_id`` then has ranks 1 to k once per vector); a query without candidates has no rows; empty
tables give no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.session import materialize, ship_package

PIVOTS = 16
CELL_VECTORS = 1 << 18
CELL_QUERIES = 1 << 16
FIRST = 64                     # candidates evaluated to get a threshold
BLOCK = 256                    # candidates evaluated between two looks at the bound
SLACK = 1e-9                   # share of |q|^2 + |x|^2 that covers rounding of the bounds


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, vec): ``vec`` holds little-endian 64-bit integers."""
    def run(it):
        for batch in it:
            ids, dims, vecs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.cast(pa.float64()))
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                vecs.append(np.clip(np.floor(scale * x), -2.0 ** 62, 2.0 ** 62).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                ["vec_id", "dim", "vec"])
    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(
        run, "vec_id long, dim int, vec binary")


def _matrix(table: pa.Table, dim: int, id_col: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.asarray(table["dim"]) == dim)
    part = table.take(pa.array(at))
    raw = b"".join(part["vec"].to_pylist())
    return np.asarray(part[id_col]), np.frombuffer(raw, dtype="<i8").reshape(len(at), dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the origin and the pivots, a column each."""
    cols = [np.sqrt((x * x).sum(axis=1))]
    cols += [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]
    return np.stack(cols, axis=1)


def best_in_cell(qid, nth, q, xid, x, pivots, k: int):
    """(query id, number, vector id, score) of the k best of ``x`` for every row of ``q``; ``nth`` has
    the numbers that tell the rows of one query id apart."""
    qf, xf = q.astype(float), x.astype(float)
    dq, dx = _distances(qf, pivots), _distances(xf, pivots)
    q2, x2 = dq[:, 0] ** 2, dx[:, 0] ** 2
    limit = np.sqrt(q2.max(initial=0) * x2.max(initial=0))
    if limit >= 2.0 ** 62:
        raise ValueError("inner products may need more than 64 bits; use a smaller scale")
    left = xf if limit < 2.0 ** 52 else x          # products of doubles are exact below 2**53
    out = []
    for i in range(len(q)):
        own = qf[i] if left is xf else q[i]
        gap = np.abs(dx - dq[i]).max(axis=1)
        bound = (q2[i] + x2 - gap * gap) / 2 + SLACK * (q2[i] + x2) + 1e-6
        bound[xid == qid[i]] = -np.inf
        n = int(np.isfinite(bound).sum())
        if not n:
            continue
        order = np.argpartition(-bound, min(FIRST, n) - 1)[:min(FIRST, n)]
        ids, scores = xid[order], left[order] @ own
        ids, scores = _top(ids, scores, k)
        if n > FIRST:
            floor = scores[k - 1] if len(scores) == k else -np.inf
            bound[order] = -np.inf
            rest = np.flatnonzero(bound >= floor)
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            for a in range(0, len(rest), BLOCK):
                if len(scores) == k and bound[rest[a]] < scores[k - 1]:
                    break
                part = rest[a:a + BLOCK]
                part = part[np.isfinite(bound[part])]
                ids, scores = _top(np.concatenate([ids, xid[part]]),
                                   np.concatenate([scores, left[part] @ own]), k)
        out.extend(zip([int(qid[i])] * len(ids), [int(nth[i])] * len(ids), ids.tolist(), [int(s) for s in scores]))
    return out


def _top(ids, scores, k):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    ship_package(spark)
    data = materialize(quantised(vectors, id_col, vector_col, scale), "quantised")
    of_id = Window.partitionBy("vec_id").orderBy("dim", "vec")
    queries = data.filter(is_query).distinct().withColumn("nth", F.row_number().over(of_id))
    n = data.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    rows = max(2 * spark.sparkContext.defaultParallelism, -(-n[0] // cell_vectors))
    cols = max(1, -(-n[1] // cell_queries))
    pivots = [(r["dim"], r["vec"]) for r in data.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "vec").limit(PIVOTS).collect()]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for dim in sorted(set(left["dim"].to_pylist()) & set(right["dim"].to_pylist())):
            xid, x = _matrix(left, dim)
            qid, q = _matrix(right, dim)
            nth, _ = _matrix(right, dim, "nth")
            own = np.array([np.frombuffer(v, "<i8") for d, v in pivots if d == dim], dtype=float).reshape(-1, dim)
            out += best_in_cell(qid, nth, q, xid, x, own, k)
        a, n, b, c = zip(*out) if out else ((), (), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "nth": pa.array(n, pa.int32()),
                         "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    row = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(rows)).alias("row")
    col = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(cols)).alias("col")
    left = data.select("*", row, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    right = queries.select("*", col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"))
    found = (left.groupBy("row", "col").cogroup(right.groupBy("row", "col"))
             .applyInArrow(cell, "query_id long, nth int, vec_id long, score long"))
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
