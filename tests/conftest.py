import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grantstar.schemas import CONTRACTS, Feeds, Star  # noqa: E402
from grantstar.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def feeds(spark):
    """Builds feeds from lists of rows; feeds that are not given are empty."""

    def build(**rows) -> Feeds:
        frames = {}
        for contract in CONTRACTS:
            schema = ", ".join(f"{c} string" for c in contract.columns)
            frames[contract.name] = spark.createDataFrame(rows.get(contract.name, []), schema)
        return Feeds(**frames)

    return build


@pytest.fixture
def star(spark):
    """Builds a star from lists of rows, all text but the date, the year and the assignee type."""
    schemas = {
        "patents": "patent_id string, title string, abstract string, filing_date string, year string",
        "inventors": "inventor_id string, name string, country string, city string, state string",
        "companies": "company_id string, name string, assignee_type string, country string, "
        "city string, state string",
        "relations": "patent_id string, inventor_id string, company_id string",
    }

    def build(**rows) -> Star:
        frames = {n: spark.createDataFrame(rows.get(n, []), s) for n, s in schemas.items()}
        frames["patents"] = frames["patents"].selectExpr(
            "patent_id", "title", "abstract", "cast(filing_date as date) filing_date",
            "cast(year as int) year",
        )
        frames["companies"] = frames["companies"].selectExpr(
            "company_id", "name", "cast(assignee_type as int) assignee_type", "country", "city", "state"
        )
        return Star(**frames)

    return build


def tuples(df):
    return [tuple(r) for r in df.collect()]
