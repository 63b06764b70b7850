"""Counts per code prefix, where one id may fall under several prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patents_per_prefix(cpc: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(prefix, patent_count), also for prefixes that match nothing.

    The prefix tests run first as a filter, which reaches the parquet scan. Each row then explodes
    to the prefixes it matches, so no join with a range or LIKE condition is needed. (An array
    ``filter`` with a lambda would say the same, but leaves generated code.)
    """
    code = F.col("cpc_group")
    matching = cpc.where(reduce(or_, (code.startswith(p) for p in prefixes)))
    tested = F.array(*(F.when(code.startswith(p), F.lit(p)) for p in prefixes))
    hits = matching.select("patent_id", F.explode(tested).alias("prefix")).where(
        F.col("prefix").isNotNull()
    )
    counts = hits.groupBy("prefix").agg(F.countDistinct("patent_id").alias("patent_count"))
    table = F.array(*(F.lit(p) for p in prefixes))
    every = cpc.sparkSession.range(1).select(F.explode(table).alias("prefix"))
    found = every.join(counts, "prefix", "left")
    return found.select("prefix", F.coalesce("patent_count", F.lit(0)).alias("patent_count"))
