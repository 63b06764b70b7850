"""Corrections of known wrong places, as a table of rules: the plan is the same for two rules and for ten thousand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantstar.operators.keyed import keep_first
from grantstar.operators.profiling import sql_text


@dataclass(frozen=True)
class GeocodeRule:
    """A place the source is known to get wrong: (country, city) should be ``corrected_to``."""

    country: str
    city: str
    corrected_to: str


# Known wrong geocodes, per table.
INVENTOR_GEOCODES = (GeocodeRule("UG", "Amuru", "JP"), GeocodeRule("CM", "Somalomo", "JP"))
COMPANY_GEOCODES = (GeocodeRule("UG", "Amuru", "JP"),)
KNOWN_GEOCODES = {"inventors": INVENTOR_GEOCODES, "companies": COMPANY_GEOCODES}

RULE_COLUMNS = ("table", "country", "city", "corrected_to")


def known_rules(spark: SparkSession, rules: dict[str, Sequence[GeocodeRule]] | None = None) -> DataFrame:
    """The rule table (``RULE_COLUMNS`` and number) of rules given by name of the table they are valid for."""
    rows = [
        f"({sql_text(table)}, {sql_text(r.country)}, {sql_text(r.city)}, {sql_text(r.corrected_to)}, {number})"
        for table, own in (KNOWN_GEOCODES if rules is None else rules).items()
        for number, r in enumerate(own, 1)
    ]
    if not rows:
        return known_rules(spark).where(F.lit(False))
    return spark.sql(f"select * from values {', '.join(rows)} as rules({', '.join(RULE_COLUMNS)}, number)")


def numbered_rules(rules: DataFrame) -> DataFrame:
    """A rule table as delivered, with the rules of each table numbered in order of place. Rules that lack a value go; of
    several for one place the first by correction stays."""
    whole = rules.select(*RULE_COLUMNS).dropna()
    place = F.struct("table", "country", "city").alias("place")
    once = keep_first(whole.select(place, "corrected_to"), "place", ["corrected_to"]).select("place.*", "corrected_to")
    order = Window.partitionBy("table").orderBy("country", "city")
    return once.withColumn("number", F.row_number().over(order))


def read_geocode_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a CSV file with RULE_COLUMNS. A file without one of them is an error."""
    return numbered_rules(spark.read.option("header", True).option("escape", '"').csv(path))


def flag_geocodes(df: DataFrame, rules: DataFrame, table: str) -> DataFrame:
    """Adds ``geocode_rule``, the number of the rule that finds the row wrong, and ``geocode_country``, what it should be;
    both null on other rows.

    One join, without a hint: the planner broadcasts the rules if their measured size allows.
    """
    own = rules.where(F.col("table") == table).select(
        F.col("country").alias("_country"),
        F.col("city").alias("_city"),
        F.col("number").alias("geocode_rule"),
        F.col("corrected_to").alias("geocode_country"),
    )
    same = (F.col("country") == F.col("_country")) & (F.col("city") == F.col("_city"))
    return df.join(own, same, "left").drop("_country", "_city")


def repair_geocodes(flagged: DataFrame, rules: DataFrame, table: str) -> DataFrame:
    """Corrects the country of flagged rows and clears their city.

    The wrong city is also cleared on rows that have the right country already, but only when the
    table holds at least one wrong pair of such a rule: rules that were applied are one scalar subquery, which only rows with a
    left-over city look at.
    """
    wrong = F.col("geocode_rule").isNotNull()
    applied = flagged.where(wrong).agg(F.collect_set("geocode_rule")).scalar()
    left_over = rules.where(F.col("table") == table).groupBy("corrected_to", "city")
    left_over = left_over.agg(F.collect_set("number").alias("_rules")).select(
        F.col("corrected_to").alias("_right"), F.col("city").alias("_city"), "_rules"
    )
    same = (F.col("country") == F.col("_right")) & (F.col("city") == F.col("_city"))
    met = F.col("_rules").isNotNull() & F.arrays_overlap("_rules", applied)
    repaired = flagged.join(left_over, same, "left").withColumns(
        {
            "city": F.when(~wrong & ~F.coalesce(met, F.lit(False)), F.col("city")),
            "country": F.coalesce("geocode_country", "country"),
        }
    )
    return repaired.select(*flagged.columns)


def geocode_findings(flagged: DataFrame, rules: DataFrame, table: str, check_id: str) -> DataFrame:
    """(check_id, table, check, found) of every rule of a table, those without a hit included. Several rules get letters,
    from the 27th on numbers."""
    own = rules.where(F.col("table") == table)
    hits = flagged.where(F.col("geocode_rule").isNotNull()).groupBy("geocode_rule")
    hits = hits.agg(F.count(F.lit(1)).alias("found"))
    several = own.agg(F.count(F.lit(1)) > 1).scalar()
    letter = F.when(F.col("number") <= 26, F.char(F.col("number") + 96)).otherwise(F.concat(F.lit("."), "number"))
    return own.join(hits, F.col("number") == F.col("geocode_rule"), "left").select(
        F.concat(F.lit(check_id), F.when(several, letter).otherwise(F.lit(""))).alias("check_id"),
        "table",
        F.concat(F.lit("wrong geocode "), "country", F.lit("/"), "city").alias("check"),
        F.coalesce("found", F.lit(0).cast("long")).alias("found"),
    )
