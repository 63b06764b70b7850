"""Feed contracts, star schemas and the two containers that carry the frames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeedContract:
    """What one delimited raw feed must offer.

    ``multiline`` says whether a quoted value may hold a newline, which only free text does.
    """

    name: str
    file: str
    columns: tuple[str, ...]
    multiline: bool


# File and column names of the public PatentsView bulk download.
CONTRACTS: tuple[FeedContract, ...] = (
    FeedContract(
        "patent",
        "g_patent.tsv",
        ("patent_id", "patent_title", "patent_date", "patent_type", "withdrawn"),
        True,
    ),
    FeedContract("abstract", "g_patent_abstract.tsv", ("patent_id", "patent_abstract"), True),
    FeedContract(
        "inventor",
        "g_inventor_disambiguated.tsv",
        (
            "patent_id",
            "inventor_id",
            "disambig_inventor_name_first",
            "disambig_inventor_name_last",
            "location_id",
        ),
        True,
    ),
    FeedContract(
        "assignee",
        "g_assignee_disambiguated.tsv",
        (
            "patent_id",
            "assignee_id",
            "disambig_assignee_organization",
            "disambig_assignee_individual_name_first",
            "disambig_assignee_individual_name_last",
            "assignee_type",
            "location_id",
        ),
        True,
    ),
    FeedContract(
        "location",
        "g_location_disambiguated.tsv",
        ("location_id", "disambig_country", "disambig_city", "disambig_state"),
        True,
    ),
    FeedContract("cpc", "g_cpc_current.tsv", ("patent_id", "cpc_group"), False),
)

CONTRACT_BY_NAME = {c.name: c for c in CONTRACTS}


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PATENTS = T.StructType(
    _strings("patent_id", "title", "abstract")
    + [T.StructField("filing_date", T.DateType()), T.StructField("year", T.IntegerType())]
)
INVENTORS = T.StructType(_strings("inventor_id", "name", "country", "city", "state"))
COMPANIES = T.StructType(
    _strings("company_id", "name")
    + [T.StructField("assignee_type", T.IntegerType())]
    + _strings("country", "city", "state")
)
RELATIONS = T.StructType(_strings("patent_id", "inventor_id", "company_id"))

STAR_SCHEMAS = {
    "patents": PATENTS,
    "inventors": INVENTORS,
    "companies": COMPANIES,
    "relations": RELATIONS,
}

# A stage takes a frame and a name and hands back the frame to go on with: the same frame (lazy)
# or one read back from a table it has just written.
Stage = Callable[[DataFrame, str], DataFrame]


def lazy(df: DataFrame, name: str) -> DataFrame:
    """The stage that writes nothing."""
    return df


class Tables:
    """Named frames as attributes. Subclasses may build each one when it is first asked for, so a
    query that needs one table does not pay for planning the others."""

    NAMES: tuple[str, ...] = ()

    def __init__(self, **frames: DataFrame):
        self.__dict__.update(frames)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.NAMES]


class Feeds(Tables):
    """The six raw feeds, all columns text."""

    NAMES = tuple(CONTRACT_BY_NAME)
    patent: DataFrame
    abstract: DataFrame
    inventor: DataFrame
    assignee: DataFrame
    location: DataFrame
    cpc: DataFrame


class Star(Tables):
    """The four queried tables. Ids are unique in each entity table after the quality stage."""

    NAMES = tuple(STAR_SCHEMAS)
    patents: DataFrame
    inventors: DataFrame
    companies: DataFrame
    relations: DataFrame
    verified: DataFrame | None = None  # of a stored star: what ``profile.verify_stored`` found
    title_index = None  # a ``trigrams.TextIndex`` of the titles, where one is stored

    def create_views(self) -> None:
        """Offer the four tables to ``spark.sql`` under their own names."""
        for name, df in self.items():
            df.createOrReplaceTempView(name)
