"""Windows over hit tables (a bounded number of rows per query)."""

from __future__ import annotations

from pyspark.sql import Window as W


def by_query(*more: str):
    return W.partitionBy("query_id", *more)
