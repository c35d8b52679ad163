"""Nearest-vector join (C8) and vocabulary centroids.

Queries and vocabulary are dealt to a grid of cells by hash; a cell holds at most about QUERY_ROWS by
VOCABULARY_ROWS vectors and multiplies them in tiles of TILE numbers, keeping a running arg-max, so
its memory does not depend on the table sizes. The best of each cell meet in an aggregate
(``min_by`` on cosine, then name). Nothing passes through the driver but the two counts.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS = 1 << 15
VOCABULARY_ROWS = 1 << 15
TILE = 1 << 20                 # cosines held at once (8 MB)


def centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Per-label mean vector (label, vec ARRAY<DOUBLE>); groups are label x dimension."""
    per = (df.select(label, F.posexplode(vec).alias("i", "v"))
           .groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v")))
    return (per.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_iv"))
            .select(label, F.transform("_iv", lambda x: x["v"]).alias(vec)))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def best_in_tiles(queries: np.ndarray, vocabulary: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Per query the row of ``vocabulary`` with the largest product, the first one on ties, and that product."""
    best, top = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), -np.inf)
    wide = min(len(vocabulary), max(1, int(tile ** 0.5)))
    high = max(1, tile // wide)
    for a in range(0, len(queries), high):
        rows = slice(a, a + high)
        for b in range(0, len(vocabulary), wide):
            cos = queries[rows] @ vocabulary[b:b + wide].T
            at = cos.argmax(axis=1)
            value = cos[np.arange(len(at)), at]
            better = value > top[rows]
            best[rows] = np.where(better, at + b, best[rows])
            top[rows] = np.where(better, value, top[rows])
    return best, top


def nearest_vector(queries: DataFrame, vocab: DataFrame, id_col: str = "id", vec_col: str = "vec",
                   name_col: str = "name", max_broadcast: int = VOCABULARY_ROWS) -> DataFrame:
    """For every query row the vocabulary name with the highest cosine (ties: the
    first name in sorted order). Returns (id, name, cosine), nulls when the vocabulary is empty.
    ``max_broadcast`` is the number of vocabulary rows in a cell."""
    id_type = queries.schema[id_col].dataType.simpleString()
    q = queries.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    words = vocab.select(F.col(name_col).alias("name"), F.col(vec_col).alias("_w"))
    n_words, n_queries = words.count(), q.count()
    if not n_words:
        return q.select(F.col("_id").alias(id_col), F.lit(None).cast("string").alias("name"),
                        F.lit(None).cast("double").alias("cosine"))
    rows = -(-n_words // max_broadcast)
    cols = max(1, -(-n_queries // QUERY_ROWS), min(n_queries // 64, 2 * q.sparkSession.sparkContext.defaultParallelism))
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    # a query keeps its place in its column of cells: ids may repeat
    q = q.withColumn("_row", F.monotonically_increasing_id()).withColumn("_c", F.pmod(F.hash("_row"), F.lit(cols)))
    left = q.select("_id", "_row", "_v", "_c", every(rows, "_r"))
    right = words.select("name", "_w", F.pmod(F.hash("name"), F.lit(rows)).alias("_r"), every(cols, "_c"))

    def cell(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or others.empty:
            return pd.DataFrame({"_id": [], "_row": [], "name": [], "cosine": []})
        others = others.sort_values("name", kind="stable")
        best, top = best_in_tiles(_unit(mine["_v"]), _unit(others["_w"]))
        return pd.DataFrame({"_id": mine["_id"].to_numpy(), "_row": mine["_row"].to_numpy(),
                             "name": others["name"].to_numpy()[best], "cosine": top})

    # as many partitions as leave cells apart, whatever few bytes they are
    left, right = (side.repartition(2 * rows * cols, "_r", "_c") for side in (left, right))
    found = left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInPandas(
        cell, f"_id {id_type}, _row long, name string, cosine double")
    best = found.groupBy("_row").agg(F.min_by(F.struct("_id", "name", "cosine"), F.struct(-F.col("cosine"), F.col("name"))).alias("b"))
    return best.select(F.col("b._id").alias(id_col), "b.name", "b.cosine")
