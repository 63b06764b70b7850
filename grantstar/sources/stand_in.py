"""Stand-ins for the raw feeds and for a dirty star, derived from the benchmark tables.

Orders play the patents, suppliers the inventors, customers the owners, line items the links and
part brands the classes. All rows of the tables take part. The benchmark tables hold no nulls, so
some values are blanked by rules on their keys, to give the filters and repairs something to find.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantstar.schemas import Feeds, Star

# The parent class and some subclasses among the brands.
CLASS_PREFIX = "Brand#1"
SUBCLASS_PREFIXES = ("Brand#1", "Brand#10", "Brand#12", "Brand#19", "Brand#3", "Brand#99")


class BenchmarkTables:
    """The parquet tables of one scale factor, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        self.__dict__[name] = table
        return table


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _blank_every(key: str, step: int, value: Column, blank: Column | None = None) -> Column:
    return F.when(F.col(key) % step == 0, F.lit(None) if blank is None else blank).otherwise(value)


def _order_title() -> Column:
    title = F.concat(F.lit(" Order "), F.col("o_orderpriority"), F.lit(" "))
    return _blank_every("o_orderkey", 97, title, F.lit("  "))


def _place_id(name: str) -> Column:
    return F.concat(F.lit("n"), _text(name))


class StandInFeeds(Feeds):
    """The six raw feeds over the benchmark tables, all text."""

    TABLES = "customer documents lineitem nation orders part region supplier".split()

    def __init__(self, spark: SparkSession, folder: str):
        self._tables = BenchmarkTables(spark, folder)

    @cached_property
    def patent(self) -> DataFrame:
        held_back = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)
        draft = F.col("o_orderpriority") == "4-NOT SPECIFIED"
        date = F.col("o_orderdate").cast("date").cast("string")
        return self._tables.orders.select(
            _text("o_orderkey").alias("patent_id"),
            _order_title().alias("patent_title"),
            _blank_every("o_orderkey", 101, date).alias("patent_date"),
            F.when(draft, F.lit("design")).otherwise(F.lit("utility")).alias("patent_type"),
            F.when(held_back, F.lit("1")).otherwise(F.lit(" 0")).alias("withdrawn"),
        )

    @cached_property
    def abstract(self) -> DataFrame:
        return self._tables.documents.select(
            _text("doc_id").alias("patent_id"), F.col("text").alias("patent_abstract")
        )

    @cached_property
    def inventor(self) -> DataFrame:
        t = self._tables
        links = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return links.select(
            _text("l_orderkey").alias("patent_id"),
            _text("s_suppkey").alias("inventor_id"),
            F.substring("s_name", 1, 8).alias("disambig_inventor_name_first"),
            _blank_every("s_suppkey", 10, F.substring("s_name", 9, 20)).alias(
                "disambig_inventor_name_last"
            ),
            _place_id("s_nationkey").alias("location_id"),
        )

    @cached_property
    def assignee(self) -> DataFrame:
        t = self._tables
        links = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        owner = F.when(F.col("o_orderpriority") != "5-LOW", _text("c_custkey"))
        return links.select(
            _text("o_orderkey").alias("patent_id"),
            owner.alias("assignee_id"),
            _blank_every("c_custkey", 3, F.col("c_name")).alias("disambig_assignee_organization"),
            _blank_every("c_custkey", 6, F.col("c_mktsegment")).alias(
                "disambig_assignee_individual_name_first"
            ),
            F.lit(None).cast("string").alias("disambig_assignee_individual_name_last"),
            _text("c_nationkey").alias("assignee_type"),
            _place_id("c_nationkey").alias("location_id"),
        )

    @cached_property
    def location(self) -> DataFrame:
        t = self._tables
        places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return places.select(
            _place_id("n_nationkey").alias("location_id"),
            F.when(F.col("n_nationkey") != 0, F.col("n_name")).alias("disambig_country"),
            F.col("r_name").alias("disambig_city"),
            F.concat(F.lit("S"), _text("r_regionkey")).alias("disambig_state"),
        )

    @cached_property
    def cpc(self) -> DataFrame:
        t = self._tables
        codes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        return codes.select(
            _text("l_orderkey").alias("patent_id"), F.col("p_brand").alias("cpc_group")
        )


class TravellingFeeds(StandInFeeds):
    """Feeds where suppliers work wherever their customers live, so inventors change country."""

    @cached_property
    def inventor(self) -> DataFrame:
        t = self._tables
        links = (
            t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        )
        return links.select(
            _text("l_orderkey").alias("patent_id"),
            _text("s_suppkey").alias("inventor_id"),
            F.lit("Supplier").alias("disambig_inventor_name_first"),
            F.col("s_name").alias("disambig_inventor_name_last"),
            _place_id("c_nationkey").alias("location_id"),
        )


def _by_nation(nation: str, first: str, second: str, third: str, rest: Column) -> Column:
    """Fixed texts for nations 1 to 3, the given column for all others."""
    key = F.col(nation)
    return (
        F.when(key == 1, F.lit(first))
        .when(key == 2, F.lit(second))
        .when(key == 3, F.lit(third))
        .otherwise(rest)
    )


def _placed(df: DataFrame, nations: DataFrame, key: str) -> DataFrame:
    """Add country, city and state, with the known wrong geocodes among them."""
    named = nations.select("n_nationkey", "n_name", "n_regionkey")
    country = F.when(F.col("n_nationkey") != 0, F.col("n_name"))
    city = F.concat(F.lit("City "), _text("n_regionkey"))
    return df.join(named, F.col(key) == F.col("n_nationkey"), "left").withColumns(
        {
            "country": _by_nation("n_nationkey", "UG", "CM", "JP", country),
            "city": _by_nation("n_nationkey", "Amuru", "Somalomo", "Amuru", city),
            "state": F.concat(F.lit("S"), _text("n_regionkey")),
        }
    )


def _lost(rule: Column, key: Column) -> Column:
    """The key, or where the rule holds one that no entity has."""
    return F.when(rule, F.concat(F.lit("lost"), key)).otherwise(key)


def _twice(df: DataFrame, balance: str) -> DataFrame:
    """Repeat the rows with a negative balance under another name."""
    second = df.where(F.col(balance) < 0).withColumn("name", F.lit("~copy"))
    return df.unionByName(second)


class DirtyStar(Star):
    """A star as no cleaning has touched it: repeated ids, blanks, wrong places and orphans.

    Every row of the tables takes part. Links of orders without a priority, and those of some suppliers
    and customers, carry ids that no entity has. Urgent orders and entities with a negative balance
    appear twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._tables = BenchmarkTables(spark, folder)

    @cached_property
    def patents(self) -> DataFrame:
        t = self._tables
        orders = t.orders
        misread = F.when(F.col("o_totalprice") > 450000, 100).otherwise(0)
        texts = t.documents.select("doc_id", "text")
        first = orders.join(texts, F.col("o_orderkey") == F.col("doc_id"), "left").select(
            _text("o_orderkey").alias("patent_id"),
            _order_title().alias("title"),
            F.col("text").alias("abstract"),
            _blank_every("o_orderkey", 101, F.col("o_orderdate").cast("date")).alias("filing_date"),
            (F.year("o_orderdate") + misread).alias("year"),
        )
        again = orders.where(F.col("o_orderpriority") == "1-URGENT").select(
            _text("o_orderkey").alias("patent_id"),
            F.lit("Zweitschrift").alias("title"),
            F.lit(None).cast("string").alias("abstract"),
            F.col("o_orderdate").cast("date").alias("filing_date"),
            F.year("o_orderdate").alias("year"),
        )
        return first.unionByName(again)

    @cached_property
    def inventors(self) -> DataFrame:
        t = self._tables
        named = _placed(t.supplier, t.nation, "s_nationkey").withColumn(
            "name", _blank_every("s_suppkey", 10, F.col("s_name"))
        )
        return _twice(named, "s_acctbal").select(
            _text("s_suppkey").alias("inventor_id"), "name", "country", "city", "state"
        )

    @cached_property
    def companies(self) -> DataFrame:
        t = self._tables
        named = _placed(t.customer, t.nation, "c_nationkey").withColumn(
            "name", _blank_every("c_custkey", 6, F.col("c_name"), F.lit(" "))
        )
        return _twice(named, "c_acctbal").select(
            _text("c_custkey").alias("company_id"),
            "name",
            F.col("c_nationkey").alias("assignee_type"),
            "country",
            "city",
            "state",
        )

    @cached_property
    def relations(self) -> DataFrame:
        t = self._tables
        links = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        owner = _lost(F.col("o_custkey") % 5 == 2, _text("o_custkey"))
        return links.select(
            _lost(F.col("o_orderpriority") == "4-NOT SPECIFIED", _text("l_orderkey")).alias("patent_id"),
            _lost(F.col("l_suppkey") % 7 == 3, _text("l_suppkey")).alias("inventor_id"),
            F.when(F.col("o_orderpriority") != "5-LOW", owner).alias("company_id"),
        ).distinct()


def damaged_copy(star: Star, folder: str) -> None:
    """The tables of a star, written with one fault each but the links: one part of the patents has no title, one part of
    the companies (those with an id of even length) has the type as text, and one inventor has another name."""

    def write(name: str, *parts: DataFrame) -> None:
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/{name}")

    odd = F.length("patent_id") % 2 == 1
    write("patents", star.patents.where(odd), star.patents.where(~odd).drop("title"))
    odd = F.length("company_id") % 2 == 1
    retyped = star.companies.where(~odd).withColumn("assignee_type", F.col("assignee_type").cast("string"))
    write("companies", star.companies.where(odd), retyped)
    first = F.col("inventor_id") == star.inventors.agg(F.min("inventor_id")).scalar()
    renamed = F.when(first, F.concat("name", F.lit("~"))).otherwise(F.col("name"))
    write("inventors", star.inventors.withColumn("name", renamed))
    write("relations", star.relations)
