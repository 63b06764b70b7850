"""Read a stored star."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from grantstar.schemas import STAR_SCHEMAS, Star
from grantstar.sources.feeds import by_header, files_over_lines, list_files
from grantstar.sources.wrapped import parsed, records


def read_star(spark: SparkSession, folder: str) -> Star:
    """A star written by ``sinks.tables.write_star``."""
    return Star(
        **{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in STAR_SCHEMAS.items()}
    )


def read_star_csv(spark: SparkSession, folder: str, multiline: bool | None = None) -> Star:
    """A star exported as CSV (header, quoted text), with the declared types.

    ``multiline`` says whether values run over lines; by default the files are looked through. Either way every file
    is split. A file with other columns than declared is an error.
    """

    def load(name: str, schema: T.StructType) -> DataFrame:
        files = list_files(spark, f"{folder}/{name}")
        wrapped = files_over_lines(spark, files, ",") if multiline is None else files if multiline else []
        frames = []
        for header, over_lines, own in by_header(spark, files, wrapped, ","):
            if list(header) != schema.names:
                raise ValueError(f"{own[0]} has the columns {', '.join(header)}")
            if over_lines:
                frames.append(parsed(records(spark, own, ","), schema.toDDL(), ","))
            else:
                frames.append(spark.read.schema(schema).option("header", True).option("escape", '"').csv(own))
        return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)

    return Star(**{n: load(n, s) for n, s in STAR_SCHEMAS.items()})


def star_from_catalog(spark: SparkSession, database: str = "default") -> Star:
    """A star saved by ``sinks.tables.save_tables``."""
    return Star(**{n: spark.table(f"{database}.{n}") for n in STAR_SCHEMAS})
