"""Short profiles of the feeds and the entity tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.functions.text import strip
from grantstar.operators.checksums import EMPTY, Content, content_columns
from grantstar.operators.counting import value_counts
from grantstar.operators.linking import only_known
from grantstar.operators.profiling import missing_share
from grantstar.operators.ranking import top_k
from grantstar.plans.clean import GREEN_TRANSPORT, class_ids
from grantstar.schemas import STAR_SCHEMAS, Feeds, Star
from grantstar.session import files_below, in_parallel, parquet_schema


def patent_type_counts(feeds: Feeds) -> DataFrame:
    """(patent_type, rows) over the whole patent feed."""
    return value_counts(feeds.patent, "patent_type")


def withdrawn_counts(feeds: Feeds, prefix: str = GREEN_TRANSPORT) -> DataFrame:
    """(withdrawn, rows) among the utility patents of the class."""
    utility = feeds.patent.where(F.col("patent_type") == "utility")
    chosen = only_known(utility, class_ids(feeds.cpc, prefix), "patent_id")
    return value_counts(chosen.withColumn("withdrawn", strip(F.col("withdrawn"))), "withdrawn")


def profile_entities(star: Star) -> DataFrame:
    """(table, rows, missing, missing_pct): how many entities have no country."""
    inventors = missing_share(star.inventors, "country", "inventors")
    return inventors.unionByName(missing_share(star.companies, "country", "companies"))


def most_common_countries(entities: DataFrame, k: int = 5) -> DataFrame:
    """(country, rows): the k countries with most entities."""
    return top_k(value_counts(entities, "country"), k, "country", by="rows")


def verify_tables(star: Star) -> DataFrame:
    """(table, rows, columns_ok): what a load has brought.

    Compares the columns and types of the frames as they are. Frames read with a declared schema show
    that schema whatever the files hold: for stored tables use ``verify_stored``.
    """
    checks = []
    for name, df in star.items():
        expected = [(f.name, f.dataType) for f in STAR_SCHEMAS[name]]
        actual = [(f.name, f.dataType) for f in df.schema]
        checks.append(
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(actual == expected).alias("columns_ok")
            )
        )
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class PartColumns:
    """How the columns of one part file differ from the declared ones."""

    file: str
    missing: tuple[str, ...]
    retyped: tuple[str, ...]
    extra: tuple[str, ...]

    @property
    def ok(self) -> bool:
        return not (self.missing or self.retyped or self.extra)


def part_columns(spark: SparkSession, folder: str, name: str) -> list[PartColumns]:
    """Every part of a stored table against its declared columns, by the schema in its own footer. Footers are read side
    by side, as files are listed, without a job."""
    declared = {f.name: f.dataType for f in STAR_SCHEMAS[name]}
    try:
        files = [file for file, _, _ in files_below(spark, f"{folder}/{name}")]
    except FileNotFoundError:
        return []

    def compare(file: str) -> PartColumns:
        own = {f.name: f.dataType for f in parquet_schema(spark, file)}
        retyped = (n for n, kind in declared.items() if own.get(n, kind) != kind)
        missing, extra = (n for n in declared if n not in own), (n for n in own if n not in declared)
        return PartColumns(file, tuple(missing), tuple(retyped), tuple(extra))

    return in_parallel(compare, files)


def verify_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(table, part, missing_columns, retyped_columns, extra_columns, ok) of all part files of a stored star."""
    rows = [
        (name, p.file.rsplit("/", 1)[1], *(",".join(c) for c in (p.missing, p.retyped, p.extra)), p.ok)
        for name in Star.NAMES
        for p in part_columns(spark, folder, name)
    ]
    columns = "missing_columns string, retyped_columns string, extra_columns string"
    return spark.createDataFrame(rows, f"table string, part string, {columns}, ok boolean")


def verify_stored(spark: SparkSession, folder: str, written: dict[str, Content]) -> DataFrame:
    """(table, rows, columns_ok, rows_ok, content_ok) of the parquet tables in a folder.

    ``written`` is what ``write_star`` has observed. Columns are compared part by part, by the footers. Rows and contents
    are counted again in one pass over the files; parts in which a column has another type cannot be read as declared
    and count as lost. So a missing table, a missing, renamed, added or retyped column in any part, lost or added
    rows, and a changed value all show, and none is an error here.
    """
    checks = []
    for name in Star.NAMES:
        schema, expected = STAR_SCHEMAS[name], written.get(name, EMPTY)
        parts = part_columns(spark, folder, name)
        readable = [p.file for p in parts if not p.retyped]
        df = spark.read.schema(schema).parquet(*readable) if readable else spark.createDataFrame([], schema)
        checks.append(
            df.agg(*content_columns(schema.names)).select(
                F.lit(name).alias("table"),
                "rows",
                F.lit(bool(parts) and all(p.ok for p in parts)).alias("columns_ok"),
                (F.col("rows") == F.lit(expected.rows)).alias("rows_ok"),
                ((F.col("rows") == F.lit(expected.rows)) & expected.same()).alias("content_ok"),
            )
        )
    return reduce(DataFrame.unionByName, checks)
