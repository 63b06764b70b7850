"""Write the star as parquet, CSV or catalog tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Observation

from grantstar.operators.checksums import Content, content_columns
from grantstar.schemas import CONTRACT_BY_NAME, STAR_SCHEMAS, Feeds, Star
from grantstar.session import concurrently

# The columns the queries filter or join on.
CLUSTER_KEYS = {
    "patents": ("year", "patent_id"),
    "inventors": ("country", "inventor_id"),
    "companies": ("country", "company_id"),
    "relations": ("patent_id", "inventor_id"),
}
BUCKET_KEYS = {
    "patents": "patent_id",
    "inventors": "inventor_id",
    "companies": "company_id",
    "relations": "patent_id",
}


def write_star(star: Star, folder: str, cluster: bool = False) -> dict[str, Content]:
    """Parquet under ``folder/<table>``; returns what went into each, as observed while it was written. The folder
    must not be one the star is read from.

    ``cluster`` range-partitions each table on its keys first, so that file statistics let a scan
    skip files: the counterpart of building indexes after a load.
    """

    def write(name: str, df: DataFrame) -> tuple[str, Content]:
        if cluster:
            df = df.repartitionByRange(*CLUSTER_KEYS[name]).sortWithinPartitions(*CLUSTER_KEYS[name])
        seen = Observation()
        df = df.observe(seen, *content_columns(STAR_SCHEMAS[name].names))
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return name, Content.of(seen.get)

    return dict(concurrently(*(partial(write, name, df) for name, df in star.items())))


def write_star_csv(star: Star, folder: str) -> None:
    """CSV with header under ``folder/<table>``, one part file per partition."""
    for name, df in star.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(
            f"{folder}/{name}"
        )


def write_feeds_tsv(feeds: Feeds, folder: str) -> None:
    """The raw feeds as tab-separated text, under the names ``sources.feeds.feed_paths`` expects."""

    def write(name: str, df: DataFrame) -> None:
        writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
        for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
            writer = writer.option(side, False)
        writer.option("escape", '"').csv(f"{folder}/{CONTRACT_BY_NAME[name].file}")

    concurrently(*(partial(write, name, df) for name, df in feeds.items()))


def save_tables(star: Star, database: str = "default", buckets: int | None = None) -> None:
    """Catalog tables, replaced as a whole; with ``buckets`` joins on the ids need no shuffle.

    Rows are dealt out by bucket first, so each bucket is one file. Joins without a shuffle cannot be
    split by the planner: leave the buckets out where one id may hold a large part of a table.
    """
    for name, df in star.items():
        if buckets:
            df = df.repartition(buckets, BUCKET_KEYS[name])
        writer = df.write.mode("overwrite").format("parquet")
        if buckets:
            writer = writer.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        writer.saveAsTable(f"{database}.{name}")


def write_result_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with header: one file for results that are short by construction (a top-k, a report),
    a file per partition with ``one_file=False`` for uncapped ones."""
    df = df.coalesce(1) if one_file else df
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON line per row, nulls written out; for short results, as it makes one file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
