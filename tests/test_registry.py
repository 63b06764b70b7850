"""The registered queries against their SQL twins, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import registry

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from oracles.sql import ORACLES
from registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["name", "country", "patent_count"] and df.count() == 20


def test_known_sizes_of_the_stand_in(spark):
    sizes = {r.table: r.rows for r in queries()["verify_tables"](spark, SF).collect()}
    assert sizes == {"patents": 871, "inventors": 10, "companies": 124, "relations": 3102}
    assert queries()["unassigned_patents"](spark, SF).first()[0] > 0


def test_star_queries_share_one_stored_star(spark):
    """A second query reads tables in the shared folder and no benchmark table."""
    files = queries()["top_companies"](spark, SF).inputFiles()
    assert files and all(("assessed_" in f or "per_company" in f) and SF not in f for f in files)


def test_changed_tables_make_a_new_star(spark, tmp_path):
    for name in registry.StandInFeeds.TABLES:
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    before = registry._checked(spark, str(tmp_path))
    assert registry._checked(spark, str(tmp_path)) is before
    os.utime(tmp_path / "orders.parquet", (1, 1))
    assert registry._checked(spark, str(tmp_path)) is not before


def test_every_check_finds_something_in_the_dirty_star(spark):
    found = {r.check_id: r.found for r in QUERIES["quality_report"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 18 and all(found.values())


def test_report_json(spark):
    assert queries()["report_json"](spark, SF).count() == 1


_WITHOUT = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in ("{blocked}",) or name == "{blocked}":
            raise ModuleNotFoundError("No module named " + name, name=name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
from registry import QUERIES
assert set(QUERIES) == set(entry.queries()) and set(entry.oracle_sql()) == set(QUERIES)
"""


@pytest.mark.parametrize("blocked", ["public_tokenizers", "corpus_pipeline", "grantstar.llm"])
def test_the_core_does_without_the_other_part(blocked):
    """Also where only a library of that part is missing."""
    code = _WITHOUT.replace("{blocked}", blocked)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
