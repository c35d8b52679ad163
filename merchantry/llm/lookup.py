"""Keeping or dropping documents by id without moving their texts when the ids are few."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1 << 21        # at most 2 million ids (16 MB of longs) are broadcast


def by_ids(docs: DataFrame, ids: DataFrame, keep: bool = True, key: str | list[str] = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is (or, with ``keep`` false, is not) in ``ids``. The ids'
    number is counted: up to BROADCAST_IDS they are broadcast, beyond that the join shuffles.
    Rows with a null key are never in ``ids``."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_semi" if keep else "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (one row per key), with the columns of ``ids``;
    broadcast or shuffled as in ``by_ids``."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key)
