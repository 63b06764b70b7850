"""Exact distinct counts that deliveries add to.

Patents are numbered once. For each inventor and company the numbers of its patents are kept, cut in ranges of 32,768: an entity
with a third of all patents is many short lists. A delivery is turned into such lists by itself and merged by
union. So what was delivered before is never counted again, a patent that comes again counts once, and the
patents of a country, or of any attribute found later, are a union of bitmaps over the same ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.operators.linking import only_unknown
from grantstar.operators.numbering import numbered
from grantstar.schemas import Stage, Star

_SIDES = {"inventor": "inventor_id", "company": "company_id"}
#: Links without a company are a set of their own.
NO_COMPANY = "none"


@dataclass(frozen=True)
class PatentSets:
    """``numbers`` (patent_id, number) and ``sets`` (side, id, range, patents: sorted places in the range)."""

    numbers: DataFrame
    sets: DataFrame

    def per_entity(self, side: str) -> DataFrame:
        """(id, patent_count) of one side."""
        own = self.sets.where(F.col("side") == side)
        return own.groupBy("id").agg(F.sum(F.size("patents")).cast("long").alias("patent_count"))

    def unassigned(self) -> DataFrame:
        """One row: patents with at least one link that has no company."""
        own = self.sets.where(F.col("side") == NO_COMPANY)
        return own.agg(F.coalesce(F.sum(F.size("patents")), F.lit(0)).cast("long").alias("unassigned_patents"))

    def per_attribute(self, entities: DataFrame, side: str, attribute: str | Column) -> DataFrame:
        """(value, patent_count) by an attribute of the entities (null and '' left out): each value is a bitmap for every
        range, filled on the map side; a task sends one bitmap for a value and range, however many patents it has met."""
        value = F.col(attribute) if isinstance(attribute, str) else attribute
        of = entities.select(F.col(_SIDES[side]).alias("id"), value.alias("value")).where("value != ''")
        own = self.sets.where(F.col("side") == side).join(of, "id")
        places = own.select("value", "range", F.explode("patents").alias("place"))
        maps = places.groupBy("value", "range").agg(F.bitmap_construct_agg("place").alias("map"))
        return maps.groupBy("value").agg(F.sum(F.bitmap_count("map")).alias("patent_count"))


def _sets(relations: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sets of one delivery."""
    links = relations.join(numbers, "patent_id")
    # bitmap ranges and places count from one and from nought.
    ranged = links.select(
        F.explode(
            F.array(
                F.struct(F.lit("inventor").alias("side"), F.col("inventor_id").alias("id")),
                F.struct(
                    F.when(F.col("company_id").isNull(), NO_COMPANY).otherwise("company").alias("side"),
                    F.coalesce("company_id", F.lit("")).alias("id"),
                ),
            )
        ).alias("of"),
        F.bitmap_bucket_number(F.col("number") + 1).alias("range"),
        F.bitmap_bit_position(F.col("number") + 1).alias("place"),
    )
    held = ranged.where("of.id is not null").groupBy("of.side", "of.id", "range")
    return held.agg(F.array_sort(F.collect_set("place")).alias("patents"))


def first_delivery(star: Star, stage: Stage) -> PatentSets:
    """Numbers and sets of a star. ``stage`` must write: numbers are fixed by what is stored."""
    ids = star.relations.select("patent_id").where("patent_id is not null").distinct()
    numbers = stage(numbered(ids, "patent_id", stage, "numbering_0"), "numbers_0")
    return PatentSets(numbers, stage(_sets(star.relations, numbers), "sets_0"))


def next_delivery(held: PatentSets, star: Star, stage: Stage, number: int) -> PatentSets:
    """``held`` with one more delivery, which may repeat patents and links. Only the delivery's own links are grouped; sets
    are merged by range, and those that it does not touch pass as they are."""
    ids = star.relations.select("patent_id").where("patent_id is not null").distinct()
    new = only_unknown(ids, held.numbers, "patent_id")
    first = held.numbers.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    added = numbered(new, "patent_id", stage, f"numbering_{number}", first)
    numbers = stage(held.numbers.unionByName(added), f"numbers_{number}")
    own = stage(_sets(star.relations, numbers), f"delivered_{number}")
    both = held.sets.unionByName(own).groupBy("side", "id", "range")
    merged = both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("patents")))).alias("patents"))
    return PatentSets(numbers, stage(merged, f"sets_{number}"))
