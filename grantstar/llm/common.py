"""What several operators share: stored stages, word patterns, normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.session import scratch_folder

#: The six ASCII white-space characters; a word is a run of anything else.
WHITE = " \t\n\x0b\x0c\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the folder all executors share, and read again.

    Cuts the lineage at a table that outlives lost executors. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark, 'llm')}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed.

    Pure ASCII takes the fast ``lower``; other texts need a translation by character.
    """
    translated = F.translate(text, _UPPER, _UPPER.lower())
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(translated)


def words(text: Column) -> Column:
    """All words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")
