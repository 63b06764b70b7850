"""Time the build of the star and the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
``build_star`` goes from the raw tables to the stored, checked star, ``convert_tsv`` from the feeds as delimited
text to parquet (``tsv_mb_per_s``), ``write_results`` from the stored star to all result files, its count tables
included; ``count_tables`` stores the counts that the queries then share, ``search_tables`` the title index and
the linked patents by year. ``pipeline_*`` is one run over BENCH_COPIES (default 10, 0 for none) copies of the feeds and
not part of the sum. The other entries are queries on
the stored star or straight on the feeds, with all rows fetched or passed to the noop sink. Each entry is the
best of three runs (of two for the long ones), ``value`` their sum; ``cold_build_star`` is the first run in the
new JVM.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from grantstar.plans import analytics as a  # noqa: E402
from grantstar.plans.clean import filter_funnel  # noqa: E402
from grantstar.plans.counts import CountedStar  # noqa: E402
from grantstar.plans.pipeline import build_star, run_pipeline, write_results  # noqa: E402
from grantstar.plans.profile import profile_entities  # noqa: E402
from grantstar.plans.quality import star_null_summary  # noqa: E402
from grantstar.plans.report import report_json, summary_metrics  # noqa: E402
from grantstar.schemas import Feeds  # noqa: E402
from grantstar.session import build_session, files_below, shared_folder, table_stage  # noqa: E402
from grantstar.sinks.tables import write_feeds_tsv  # noqa: E402
from grantstar.sources.feeds import convert_feeds, feed_paths  # noqa: E402
from grantstar.sources.stand_in import CLASS_PREFIX, SUBCLASS_PREFIXES, StandInFeeds  # noqa: E402
from registry import CUTOFFS, GROWTH, MILESTONES  # noqa: E402

REPEATS = 3


def large_run(spark, feeds, out: str, copies: int) -> dict[str, float]:
    """From delimited text to result files over so many copies of the feeds, where a MB weighs more than a job: each copy has
    patents of its own, while inventors and owners are the same."""

    def repeated(df):
        if "patent_id" not in df.columns:
            return df
        copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")
        own = F.concat("patent_id", F.lit("-"), F.col("copy").cast("string"))
        return df.select("*", copy).withColumn("patent_id", own).drop("copy")

    if not copies:
        return {}
    write_feeds_tsv(Feeds(**{name: repeated(df) for name, df in feeds.items()}), f"{out}/large")
    mb = sum(size for _, size, _ in files_below(spark, f"{out}/large")) / 1e6
    start = time.perf_counter()
    run_pipeline(spark, f"{out}/large", f"{out}/large_out", CLASS_PREFIX)
    spent = time.perf_counter() - start
    return {"pipeline_tsv_mb": round(mb), "pipeline_sec": round(spent, 1), "pipeline_mb_per_s": round(mb / spent, 1)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = f"{shared_folder(spark)}/bench-{os.getpid()}-{int(time.time())}"
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}

    def timed(name, work, repeats=REPEATS):
        spent = []
        for _ in range(repeats):
            start = time.perf_counter()
            result = work()
            spent.append(time.perf_counter() - start)
        seconds[name], first[name] = round(min(spent), 3), spent[0]
        return result

    feeds = StandInFeeds(spark, folder)
    stored, report = timed("build_star", lambda: build_star(feeds, f"{out}/tables", CLASS_PREFIX), 2)
    write_feeds_tsv(feeds, f"{out}/tsv")
    text_mb = sum(size for _, size, _ in files_below(spark, f"{out}/tsv")) / 1e6
    timed("convert_tsv", lambda: convert_feeds(spark, feed_paths(f"{out}/tsv"), f"{out}/raw"), 2)
    timed("write_results", lambda: write_results(stored, report, feeds.cpc, f"{out}/output"), 2)

    def counted():
        star = CountedStar(stored, table_stage(spark))
        for name in ("per_inventor", "per_company", "per_inventor_country", "per_company_country"):
            getattr(star, name)
        return star

    star = timed("count_tables", counted, 2)

    def searchable():
        own = CountedStar(stored, table_stage(spark))
        _ = own.linked_per_year, own.title_index
        star.__dict__.update({n: own.__dict__[n] for n in ("linked_patents", "linked_per_year", "title_index")})

    timed("search_tables", searchable, 2)

    fetched = {
        "top_inventors": lambda: a.top_inventors(star),
        "top_inventors_by_country_filter": lambda: a.top_inventors(star, 20, ["NATION_3", "NATION_7"]),
        "top_companies": lambda: a.top_companies(star),
        "country_share_inventor": lambda: a.country_share(star, "inventor"),
        "country_share_company": lambda: a.country_share(star, "company"),
        "yearly_trends": lambda: a.yearly_trends(star),
        "patent_detail_join": lambda: a.patent_detail_join(star),
        "above_average_companies": lambda: a.above_average_companies(star),
        "inventor_rankings": lambda: a.inventor_rankings(star),
        "dataset_kpis": lambda: a.dataset_kpis(star, GROWTH),
        "milestone_trends": lambda: a.milestone_trends(star, MILESTONES),
        "cutoff_totals": lambda: a.cutoff_totals(star, CUTOFFS, lo=1996),
        "country_comparison": lambda: a.country_comparison(star),
        "search_patents": lambda: a.search_patents(star, "urgent", 1996, 2000),
        "country_options": lambda: a.country_options(star),
        "suspicious_geocodes": lambda: a.suspicious_geocodes(star, "NATION_5"),
        "profile_entities": lambda: profile_entities(star),
        "null_summary": lambda: star_null_summary(star),
        "quality_report": lambda: report,
        "summary_metrics": lambda: summary_metrics(star, report, GROWTH),
        "report_json": lambda: report_json(
            star, feeds.cpc, report, dict.fromkeys(SUBCLASS_PREFIXES, "brand"), GROWTH
        ),
        "subcategory_breakdown": lambda: a.subcategory_breakdown(feeds.cpc, SUBCLASS_PREFIXES),
        "filter_funnel": lambda: filter_funnel(feeds, CLASS_PREFIX),
    }
    counted = {
        "inventor_rankings_full": lambda: a.inventor_rankings(star, None),
        "patent_detail_join_full": lambda: a.patent_detail_join(star, None),
        "search_patents_full": lambda: a.search_patents(star, "", 1995, 2025, None),
    }
    for name, build in fetched.items():
        timed(name, lambda build=build: build().collect())
    for name, build in counted.items():
        timed(name, lambda build=build: build().write.format("noop").mode("overwrite").save())

    large = large_run(spark, feeds, out, int(os.environ.get("BENCH_COPIES", "10")))
    line = {
        "metric": "star_and_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "cold_build_star": round(first["build_star"], 3),
        "tsv_mb_per_s": round(text_mb / seconds["convert_tsv"], 1),
        **large,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    # Only the JSON line goes to stdout.
    with contextlib.suppress(BrokenPipeError):
        main()
