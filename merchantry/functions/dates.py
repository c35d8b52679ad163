"""Date parsing and buckets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dmy(c) -> Column:
    """``dd/MM/yyyy`` text -> DATE (statement exports)."""
    return F.to_date(_c(c), "dd/MM/yyyy")


def year_bucket(c) -> Column:
    return F.year(_c(c))


def month_bucket(c) -> Column:
    """DATE -> ``yyyy-MM``."""
    return F.date_format(_c(c), "yyyy-MM")
