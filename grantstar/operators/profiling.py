"""Null profiles, computed in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.functions.ratios import percent


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_rows(row: DataFrame, entries: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Turn one aggregate row into one row per entry; entries are SQL expressions over the row."""
    structs = [
        "named_struct(" + ", ".join(f"{sql_text(n)}, {e}" for n, e in zip(names, entry)) + ")"
        for entry in entries
    ]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def null_summary(df: DataFrame, table: str, expected_below: float = 70.0) -> DataFrame:
    """(table, column, nulls, pct, expected) for the columns that hold nulls."""
    counts = [f"count_if(`{c}` is null) as n{i}" for i, c in enumerate(df.columns)]
    row = df.selectExpr("count(1) as rows", *counts)
    entries = [(sql_text(table), sql_text(c), f"n{i}", "rows") for i, c in enumerate(df.columns)]
    nulls = to_rows(row, entries, ["table", "column", "nulls", "rows"]).where("nulls > 0")
    return nulls.select(
        "table",
        "column",
        "nulls",
        percent(F.col("nulls"), F.col("rows"), 1).alias("pct"),
        (100 * F.col("nulls") < expected_below * F.col("rows")).alias("expected"),
    )


def missing_share(df: DataFrame, column: str, table: str) -> DataFrame:
    """One row: rows, rows without the column, and their percentage."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col(column).isNull()).alias("missing"))
    share = percent(F.col("missing"), F.col("rows"), 1).alias("missing_pct")
    return row.select(F.lit(table).alias("table"), "rows", "missing", share)
