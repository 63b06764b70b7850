"""Patent counts of a star, worked out once and stored."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantstar.functions.text import has_text
from grantstar.operators.counting import patents_per_attribute, patents_per_key
from grantstar.operators.linking import only_known
from grantstar.operators.trigrams import TextIndex, read_text_index, write_text_index
from grantstar.schemas import Stage, Star
from grantstar.session import TableStage


class CountedStar(Star):
    """A star with its counts. ``stage`` stores each when it is first asked for.

    Every ranking, share, summary and report then reads these short tables; only they read the bridge,
    from which they first take the distinct (patent, inventor) and (patent, company) pairs.
    """

    def __init__(self, star: Star, stage: Stage):
        self._star, self._stage = star, stage

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._star, name)

    def _pairs(self, key: str) -> DataFrame:
        links = self._star.relations.select("patent_id", key).where(F.col(key).isNotNull())
        return self._stage(links.distinct(), f"pairs_{key}")

    @cached_property
    def inventor_pairs(self) -> DataFrame:
        return self._pairs("inventor_id")

    @cached_property
    def company_pairs(self) -> DataFrame:
        return self._pairs("company_id")

    @cached_property
    def linked_patents(self) -> DataFrame:
        """(year, patent_id) of the dated patents that have links."""
        dated = self._star.patents.where(F.col("year").isNotNull()).select("year", "patent_id")
        return self._stage(only_known(dated, self._star.relations, "patent_id"), "linked_patents")

    @cached_property
    def linked_per_year(self) -> DataFrame:
        """(year, patent_count) over ``linked_patents``."""
        counts = self.linked_patents.groupBy("year").agg(F.count(F.lit(1)).alias("patent_count"))
        return self._stage(counts, "linked_per_year")

    @cached_property
    def title_index(self) -> TextIndex | None:
        """A stored trigram index of the titles; none where nothing is stored."""
        if not isinstance(self._stage, TableStage):
            return None
        folder = f"{self._stage.root}/title_index"
        rows = self._star.patents.select("patent_id", "title", "year", "filing_date")
        write_text_index(rows, folder, "patent_id", "title", ["year"])
        return read_text_index(rows.sparkSession, folder, "patent_id")

    @cached_property
    def per_inventor(self) -> DataFrame:
        return self._stage(patents_per_key(self.inventor_pairs, "inventor_id"), "per_inventor")

    @cached_property
    def per_company(self) -> DataFrame:
        return self._stage(patents_per_key(self.company_pairs, "company_id"), "per_company")

    @cached_property
    def per_inventor_country(self) -> DataFrame:
        return self._stage(_by_country(self, self.inventor_pairs, "inventors", "inventor_id"), "per_inventor_country")

    @cached_property
    def per_company_country(self) -> DataFrame:
        return self._stage(_by_country(self, self.company_pairs, "companies", "company_id"), "per_company_country")


def _by_country(star: Star, links: DataFrame, table: str, key: str) -> DataFrame:
    located = getattr(star, table).where(has_text(F.col("country")))
    return patents_per_attribute(located, links, key, "country")


_SIDES = {"inventor": ("inventors", "inventor_id"), "company": ("companies", "company_id")}


def per_entity(star: Star, side: str) -> DataFrame:
    """(id, patent_count) of the inventors or companies that have patents."""
    if isinstance(star, CountedStar):
        return getattr(star, f"per_{side}")
    return patents_per_key(star.relations, _SIDES[side][1])


def newest_linked(star: Star, k: int) -> DataFrame:
    """(year, patent_id) of the k newest dated patents that have links.

    Where counts are stored, those per year give the oldest year that the first k can reach: a scalar subquery,
    by which older files and row groups are skipped. Nothing is joined.
    """
    order = [F.desc("year"), "patent_id"]
    if not isinstance(star, CountedStar):
        dated = star.patents.where(F.col("year").isNotNull()).select("year", "patent_id")
        return only_known(dated, star.relations, "patent_id").orderBy(*order).limit(k)
    newer = F.sum("patent_count").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("year")))
    reached = star.linked_per_year.withColumn("so_far", newer).where(F.col("so_far") >= k)
    oldest = reached.agg(F.coalesce(F.max("year"), F.lit(-(2**31)))).scalar()
    return star.linked_patents.where(F.col("year") >= oldest).orderBy(*order).limit(k)


def per_country(star: Star, side: str) -> DataFrame:
    """(country, patent_count) by where inventors live or companies sit."""
    if isinstance(star, CountedStar):
        return getattr(star, f"per_{side}_country")
    table, key = _SIDES[side]
    return _by_country(star, star.relations, table, key)
