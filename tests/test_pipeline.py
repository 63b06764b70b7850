import csv
import glob
import json
import os
import shutil

import pytest

from conftest import tuples
from grantstar.plans import analytics as a
from grantstar.plans.counts import CountedStar
from grantstar.plans.pipeline import results, run_pipeline
from grantstar.plans.profile import verify_parts, verify_stored
from grantstar.plans.quality import quality_check
from grantstar.plans.report import report_json, summary_metrics
from grantstar.schemas import CONTRACTS
from grantstar.session import scratch_folder, shared_folder, table_stage
from grantstar.sinks.tables import save_tables, write_star, write_star_csv
from grantstar.sources.tables import read_star, read_star_csv, star_from_catalog

RAW = {
    "patent": [
        ("1", '"Hybrid ""X"" drive"', "2010-01-02", "utility", "0"),
        ("2", "Fuel cell", "2020-03-04", "utility", "0"),
        ("3", "Charging port", "2020-05-06", "utility", "0"),
        ("4", "Withdrawn", "2020-05-06", "utility", "1"),
        ("5", "Other class", "2020-05-06", "utility", "0"),
        ("6", "No date", "", "utility", "0"),
    ],
    "abstract": [("1", '"two\nlines"'), ("2", " text ")],
    "inventor": [
        ("1", "a", "Shigeo", "Y", "ug"),
        ("2", "a", "Shigeo", "Y", "ug"),
        ("2", "b", "Ann", "Lee", "us"),
        ("3", "b", "Ann", "Lee", "us"),
        ("3", "c", "", "", "us"),
        ("6", "b", "Ann", "Lee", "us"),
    ],
    "assignee": [
        ("1", "x", "Aisan", "", "", "3", "ug"),
        ("2", "x", "Aisan", "", "", "3", "ug"),
        ("2", "y", "", "Bob", "Ray", "4", "us"),
        ("3", "z", "", "", "", "4", "us"),
    ],
    "location": [("ug", "UG", "Amuru", ""), ("us", "US", "Troy", "MI")],
    "cpc": [(str(i), "Y02T10/7") for i in (1, 2, 3, 4, 6)] + [("3", "Y02T90/1"), ("5", "A01")],
}


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for contract in CONTRACTS:
        lines = ["\t".join(contract.columns)] + ["\t".join(r) for r in RAW[contract.name]]
        (folder / contract.file).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def read_csv(folder):
    (path,) = glob.glob(f"{folder}/*.csv")
    with open(path, newline="", encoding="utf-8") as file:
        return list(csv.DictReader(file))


def test_from_raw_files_to_reports(spark, raw_folder, tmp_path):
    verified = run_pipeline(spark, raw_folder, str(tmp_path))
    assert {r.table: (r.rows, r.columns_ok) for r in verified.collect()} == {
        "patents": (3, True),
        "inventors": (2, True),
        "companies": (2, True),
        "relations": (6, True),
    }
    out = tmp_path / "output"
    assert [(r["name"], r["country"], r["patent_count"]) for r in read_csv(out / "top_inventors")] == [
        ("Shigeo Y", "JP", "2"),
        ("Ann Lee", "US", "2"),
    ]
    assert read_csv(out / "yearly_trends")[-1] == {
        "year": "2020",
        "patent_count": "2",
        "cumulative_total": "3",
    }
    assert len(read_csv(out / "full_join_sample")) == 6
    summary = {r["metric"]: r["value"] for r in read_csv(out / "pipeline_summary")}
    assert len(summary) == 16
    assert summary["Total green transport patents"] == "3"
    assert summary["Growth 2010-2020 (%)"] == "100.0"
    assert summary["Top company"] == "Aisan" and summary["Geocoding errors fixed"] == "2"
    assert summary["Unassigned patents"] == "1"
    (path,) = glob.glob(f"{out}/report/*.json")
    report = json.loads(open(path, encoding="utf-8").read())
    assert report["report_title"] == "Green Transport Patent Intelligence Report"
    assert report["dataset"]["year_range"] == {"from": 2010, "to": 2020}
    assert report["dataset"]["peak_year"] == {"year": 2020, "patent_count": 2}
    assert report["y02t_subcategories"]["Y02T10_road_vehicles"] == 5
    assert report["y02t_subcategories"]["Y02T90_charging_infrastructure"] == 1
    assert [(t["rank"], t["name"]) for t in report["top_companies"]] == [(1, "Aisan"), (2, "Bob Ray")]
    assert report["top_inventors"][0] == {
        "rank": 1, "name": "Shigeo Y", "country": "JP", "city": None, "patent_count": 2,
    }
    assert report["data_quality"]["geocoding_errors_fixed"] == 2
    assert [e["fixed"] for e in report["data_quality"]["errors"]] == [1, 0, 1]
    titles = dict(tuples(read_star(spark, f"{tmp_path}/tables/star").patents.select("title", "abstract")))
    assert titles['Hybrid "X" drive'] == "two\nlines"


def test_malformed_rows_and_other_years(spark, raw_folder, tmp_path):
    shutil.copytree(raw_folder, tmp_path / "raw")
    with open(tmp_path / "raw" / "g_patent.tsv", "a", encoding="utf-8") as file:
        file.write("7\tNext year\t2026-05-06\tutility\t0\n8\tshort row\n")
    with open(tmp_path / "raw" / "g_cpc_current.tsv", "a", encoding="utf-8") as file:
        file.write("7\tY02T10/7\n")
    with pytest.raises(ValueError, match="patent: 1"):
        run_pipeline(spark, str(tmp_path / "raw"), str(tmp_path / "one"))
    verified = run_pipeline(
        spark, str(tmp_path / "raw"), str(tmp_path / "two"), years=(1976, 2026), skip_malformed=True
    )
    assert {r.table: r.rows for r in verified.collect()}["patents"] == 4
    assert read_csv(tmp_path / "two" / "output" / "yearly_trends")[-1]["year"] == "2026"


@pytest.mark.parametrize("damage", ["missing", "type", "rows", "gone"])
def test_damaged_tables_do_not_verify(spark, checked, tmp_path, damage):
    written = write_star(checked, str(tmp_path))
    assert all(r.columns_ok and r.rows_ok for r in verify_stored(spark, str(tmp_path), written).collect())
    table = spark.read.parquet(f"{tmp_path}/patents")
    if damage == "missing":
        table.drop("title").write.parquet(f"{tmp_path}/other")
    elif damage == "type":
        table.withColumn("year", table.year.cast("string")).write.parquet(f"{tmp_path}/other")
    elif damage == "rows":
        table.limit(5).write.parquet(f"{tmp_path}/other")
    shutil.rmtree(tmp_path / "patents")
    if damage != "gone":
        shutil.move(tmp_path / "other", tmp_path / "patents")
    verdict = {r.table: r for r in verify_stored(spark, str(tmp_path), written).collect()}
    assert not (verdict["patents"].columns_ok and verdict["patents"].rows_ok)
    assert verdict["relations"].columns_ok and verdict["relations"].rows_ok


@pytest.mark.parametrize("damage", ["missing", "type", "extra", "value", "pair", "moved"])
def test_a_fault_in_one_part_shows(spark, star, tmp_path, damage):
    """One of several parts is odd; nothing raises, and the part is named."""
    some = star(
        patents=[(str(i), f"T{i}", None if i % 2 else "a", "2020-01-01", "2020") for i in range(40)],
        relations=[(str(i), "a", "x") for i in range(9)],
    )
    good = str(tmp_path / "good")
    written = write_star(some, good)
    shutil.copytree(good, tmp_path / "bad")
    shutil.rmtree(tmp_path / "bad" / "patents")
    table = spark.read.parquet(f"{good}/patents")
    cut = table.patent_id.cast("int") < 20
    rest, part = table.where(~cut), table.where(cut)
    if damage == "missing":
        part = part.drop("abstract")
    elif damage == "type":
        part = part.withColumn("year", part.year.cast("string"))
    elif damage == "extra":
        part = part.withColumn("note", part.title)
    elif damage == "value":
        part = part.replace({"T3": "T4"}, subset=["title"])
    elif damage == "pair":  # other rows, as many
        seven = part.where("patent_id = '7'")
        part = part.where("patent_id not in ('8', '9')").union(seven).union(seven)
    else:  # a value moves to a null neighbour
        part = part.selectExpr("patent_id", "if(abstract is null, null, title) title", "coalesce(abstract, title) abstract", "filing_date", "year")
    rest.write.parquet(f"{tmp_path}/bad/patents")
    part.write.mode("append").parquet(f"{tmp_path}/bad/patents")
    verdict = {r.table: r for r in verify_stored(spark, str(tmp_path / "bad"), written).collect()}
    bad = verdict.pop("patents")
    assert all(r.columns_ok and r.rows_ok and r.content_ok for r in verdict.values())
    assert bad.columns_ok == (damage not in ("missing", "type", "extra")) and bad.rows_ok == (damage != "type")
    assert bad.content_ok == (damage == "extra")
    odd = [r for r in verify_parts(spark, str(tmp_path / "bad")).collect() if not r.ok]
    assert {(r.missing_columns, r.retyped_columns, r.extra_columns) for r in odd} == {
        "missing": {("abstract", "", "")}, "type": {("", "year", "")}, "extra": {("", "", "note")},
    }.get(damage, set())


def test_contents_do_not_depend_on_files_or_order(spark, checked, tmp_path):
    one = write_star(checked, str(tmp_path / "one"))
    other = write_star(checked, str(tmp_path / "two"), cluster=True)
    assert one == other and one["patents"].rows == 9
    assert all(r.content_ok for r in verify_stored(spark, str(tmp_path / "two"), one).collect())


def test_own_folders_are_marked_to_go_when_the_application_ends(spark):
    path = scratch_folder(spark, "x")
    assert path.startswith(shared_folder(spark)) and os.path.isdir(path)


def test_results_read_the_bridge_once_for_each_side(spark, checked, feeds, tmp_path):
    """Counts come from stored tables: no result joins or groups the bridge again."""
    counted = CountedStar(checked, table_stage(spark, str(tmp_path)))
    for name in ("top_inventors", "top_companies", "inventor_rankings", "cte_above_average_companies"):
        assert all("per_" in f or "pairs_" in f for f in results(counted)[name].inputFiles())


def test_broken_feeds_stop_the_run(spark, raw_folder, tmp_path):
    with pytest.raises(ValueError, match="cpc"):
        run_pipeline(spark, str(tmp_path / "nothing"), str(tmp_path / "out"))


@pytest.fixture
def checked(star):
    return quality_check(
        star(
            patents=[(str(i), f'T "{i}", x\ny', "t", "2020-01-01", "2020") for i in range(9)],
            inventors=[("a", "Ann", "US", None, None)],
            companies=[("x", "X", "2", "US", None, None)],
            relations=[(str(i), "a", "x" if i % 2 else None) for i in range(9)],
        )
    )


def same(left, right):
    for name in left.NAMES:
        mine, theirs = getattr(left, name), getattr(right, name)
        assert mine.dtypes == theirs.dtypes
        assert sorted(tuples(mine), key=str) == sorted(tuples(theirs), key=str), name


@pytest.mark.parametrize("cluster", [False, True])
def test_parquet_round_trip(spark, checked, tmp_path, cluster):
    write_star(checked, str(tmp_path), cluster)
    same(checked, read_star(spark, str(tmp_path)))


def test_csv_round_trip(spark, checked, tmp_path):
    write_star_csv(checked, str(tmp_path))
    same(checked, read_star_csv(spark, str(tmp_path)))


def test_bucketed_tables_join_without_a_shuffle(spark, checked):
    spark.sql("create database if not exists bucketed")
    save_tables(checked, "bucketed", buckets=4)
    stored = star_from_catalog(spark, "bucketed")
    same(checked, stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.patents.join(stored.relations, "patent_id")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_second_load_replaces_the_first(spark, checked, star, tmp_path):
    write_star(checked, str(tmp_path))
    write_star(star(patents=[("n", "New", "", "2020-01-01", "2020")]), str(tmp_path))
    assert read_star(spark, str(tmp_path)).patents.count() == 1


def test_summary_and_report_agree(spark, checked, feeds):
    summary = dict(tuples(summary_metrics(checked, checked.report)))
    row = report_json(checked, feeds(cpc=[("1", "Y02T10")]).cpc, checked.report, generated="now").first()
    assert summary["Total green transport patents"] == str(row.dataset.total_patents) == "9"
    assert summary["Growth 2010-2020 (%)"] is None and row.dataset.growth_2010_to_2020_pct is None
    assert row.generated == "now"
    assert row.y02t_subcategories.Y02T10_road_vehicles == 1 and row.y02t_subcategories.Y02T30_aviation_efficiency == 0


def test_report_lists_stay_in_rank_order(checked, star, feeds):
    relations = [(f"p{i}", f"n{j}", None) for j in range(12) for i in range(j + 1)]
    s = star(inventors=[(f"n{j}", f"N{j}", "US", None, None) for j in range(12)], relations=relations)
    row = report_json(s, feeds().cpc, checked.report, generated="now").first()
    assert [(t.rank, t.patent_count) for t in row.top_inventors] == [(i + 1, 12 - i) for i in range(10)]
    assert [t.name for t in row.top_inventors] == [r.name for r in a.top_inventors(s, 10).collect()]


def test_intermediate_tables_go_to_the_folder_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
