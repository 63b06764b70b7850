"""Eighteen checks over the star, and the repairs that go with them.

Each table is assessed once: duplicates are merged and every remaining row carries what the checks
need to know about it. Both the report and the repaired table are read off that assessed table.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantstar.functions.text import blank_to_null, to_int
from grantstar.operators.keyed import KeyFacts, keep_first, keep_first_wide
from grantstar.operators.profiling import count_if, null_summary, sql_text, to_rows
from grantstar.plans.geocodes import flag_geocodes, geocode_findings, known_rules, repair_geocodes
from grantstar.schemas import Stage, Star, lazy
from grantstar.session import concurrently

# The range of valid grant years, unless a caller names another one.
FIRST_YEAR = 1976
LAST_YEAR = 2025


Years = tuple[int, int]
VALID_YEARS: Years = (FIRST_YEAR, LAST_YEAR)


def _valid_year(years: Years) -> Column:
    return F.coalesce(F.col("year").between(*years), F.lit(False))


def _has_title() -> Column:
    return F.col("title").isNotNull()


def _has_name() -> Column:
    return F.col("name").isNotNull()


def assess_patents(patents: DataFrame, facts: KeyFacts | None = None, unique: bool = False) -> DataFrame:
    """Patents by id with ``copies``; blank titles and abstracts are null, so they lose to text.

    Ids that are known to be unique need no merging. Where ``facts`` lists the repeated ones, only those meet. Where
    nothing is known, all rows go through an aggregate: a reader that needs no copies and no abstracts then
    reads neither.
    """
    tidy = patents.select(
        "patent_id",
        blank_to_null(F.col("title")).alias("title"),
        blank_to_null(F.col("abstract")).alias("abstract"),
        F.col("filing_date"),
        to_int(F.col("year")).alias("year"),
    )
    order = ["filing_date", "title", "year"]
    if unique or (facts and facts.unique):
        return _merged(tidy, "patent_id", [*order, "abstract"], True)
    if facts:
        return keep_first_wide(tidy, "patent_id", order, ["abstract"], "copies", facts.repeated)
    return keep_first(tidy, "patent_id", order, ["abstract"], "copies")


def _merged(tidy: DataFrame, key: str, order: list[str], unique: bool) -> DataFrame:
    """One row per key with ``copies``. Nothing needs to be merged where the key is unique already."""
    if unique:
        return tidy.select(key, *order, F.lit(1).cast("long").alias("copies"))
    return keep_first(tidy, key, order, copies="copies")


def assess_inventors(inventors: DataFrame, rules: DataFrame, unique: bool = False) -> DataFrame:
    tidy = inventors.withColumn("name", blank_to_null(F.col("name")))
    merged = _merged(tidy, "inventor_id", ["name", "country", "city", "state"], unique)
    return flag_geocodes(merged, rules, "inventors")


def assess_companies(companies: DataFrame, rules: DataFrame, unique: bool = False) -> DataFrame:
    tidy = companies.withColumn("name", blank_to_null(F.col("name"))).withColumn(
        "assignee_type", to_int(F.col("assignee_type"))
    )
    order = ["name", "assignee_type", "country", "city", "state"]
    return flag_geocodes(_merged(tidy, "company_id", order, unique), rules, "companies")


def assess_relations(
    relations: DataFrame,
    patents: DataFrame,
    inventors: DataFrame,
    companies: DataFrame,
    years: Years = VALID_YEARS,
) -> DataFrame:
    """Relations with the state of their three ends, taken from the other assessed tables.

    ``inventor_named`` and ``company_named`` are null for an unknown id and false for an entity
    that goes because it has no name.
    """
    valid = patents.where(_has_title() & _valid_year(years))
    known_patents = valid.select("patent_id", F.lit(True).alias("patent_known"))
    known_inventors = inventors.select("inventor_id", _has_name().alias("inventor_named"))
    known_companies = companies.select("company_id", _has_name().alias("company_named"))
    return (
        relations.join(known_patents, "patent_id", "left")
        .join(known_inventors, "inventor_id", "left")
        .join(known_companies, "company_id", "left")
        .select(
            "patent_id",
            "inventor_id",
            "company_id",
            "patent_known",
            "inventor_named",
            "company_named",
        )
    )


def repaired_patents(assessed: DataFrame, years: Years = VALID_YEARS) -> DataFrame:
    kept = assessed.where(_has_title() & _valid_year(years))
    abstract = F.coalesce("abstract", F.lit("")).alias("abstract")
    return kept.select("patent_id", "title", abstract, "filing_date", "year")


def repaired_inventors(assessed: DataFrame, rules: DataFrame) -> DataFrame:
    kept = repair_geocodes(assessed.where(_has_name()), rules, "inventors")
    return kept.select("inventor_id", "name", "country", "city", "state")


def repaired_companies(assessed: DataFrame, rules: DataFrame) -> DataFrame:
    kept = repair_geocodes(assessed.where(_has_name()), rules, "companies")
    return kept.select("company_id", "name", "assignee_type", "country", "city", "state")


def repaired_relations(assessed: DataFrame) -> DataFrame:
    """Links with a known patent and a named inventor; other companies become null."""
    kept = assessed.where(F.col("patent_known") & F.col("inventor_named"))
    company = F.when(F.col("company_named"), F.col("company_id")).alias("company_id")
    return kept.select("patent_id", "inventor_id", company)


_REPORT = ["check_id", "table", "check", "found", "fixed", "action"]

# What a check does with what it finds. Only a report leaves the rows as they are.
_MERGE = "keep first"
_DROP = "drop row"
_CORRECT = "correct"
_NULL = "null the link"
_ONLY_REPORT = "report"


def _report_rows(
    assessed: DataFrame, table: str, checks: list[tuple[str, str, Column, str]]
) -> DataFrame:
    row = assessed.agg(*(F.coalesce(c, F.lit(0)).alias(check_id) for check_id, _, c, _ in checks))
    entries = []
    for check_id, text, _, action in checks:
        fixed = "0L" if action == _ONLY_REPORT else check_id
        texts = [sql_text(t) for t in (check_id, table, text, action)]
        entries.append((*texts[:3], check_id, fixed, texts[3]))
    return to_rows(row, entries, _REPORT)


def patent_checks(assessed: DataFrame, years: Years = VALID_YEARS) -> DataFrame:
    titled = _has_title()
    kept = titled & _valid_year(years)
    checks = [
        ("Q01", "duplicate patent_id", F.sum(F.col("copies") - 1), _MERGE),
        ("Q02", "empty title", count_if(~titled), _DROP),
        ("Q03", "empty abstract", count_if(titled & F.col("abstract").isNull()), _ONLY_REPORT),
        ("Q04", "missing or invalid year", count_if(titled & ~_valid_year(years)), _DROP),
        (
            "Q05",
            "missing filing date",
            count_if(kept & F.col("filing_date").isNull()),
            _ONLY_REPORT,
        ),
    ]
    return _report_rows(assessed, "patents", checks)


def _geocode_checks(assessed: DataFrame, rules: DataFrame, table: str, check_id: str) -> DataFrame:
    found = geocode_findings(assessed.where(_has_name()), rules, table, check_id)
    return found.select("*", F.col("found").alias("fixed"), F.lit(_CORRECT).alias("action")).select(*_REPORT)


def inventor_checks(assessed: DataFrame, rules: DataFrame) -> DataFrame:
    named = _has_name()
    no_country = count_if(named & F.col("country").isNull())
    checks = [
        ("Q06", "duplicate inventor_id", F.sum(F.col("copies") - 1), _MERGE),
        ("Q07", "empty inventor name", count_if(~named), _DROP),
        ("Q08", "missing inventor country", no_country, _ONLY_REPORT),
    ]
    places = _geocode_checks(assessed, rules, "inventors", "Q09")
    return _report_rows(assessed, "inventors", checks).unionByName(places)


def company_checks(assessed: DataFrame, rules: DataFrame) -> DataFrame:
    named = _has_name()
    no_country = count_if(named & F.col("country").isNull())
    checks = [
        ("Q10", "duplicate company_id", F.sum(F.col("copies") - 1), _MERGE),
        ("Q11", "empty company name", count_if(~named), _DROP),
        ("Q13", "missing company country", no_country, _ONLY_REPORT),
    ]
    places = _geocode_checks(assessed, rules, "companies", "Q12")
    return _report_rows(assessed, "companies", checks).unionByName(places)


def relation_checks(assessed: DataFrame) -> DataFrame:
    """Orphans, each counted among the rows that the checks before it have left."""
    named = F.col("inventor_named")
    cascaded = F.coalesce(~named, F.lit(False))
    known = F.coalesce(F.col("patent_known"), F.lit(False))
    kept = known & F.coalesce(named, F.lit(False))
    linked = F.col("company_id").isNotNull()
    unknown_company = linked & F.col("company_named").isNull()
    no_company = ~F.coalesce(F.col("company_named"), F.lit(False))
    checks = [
        ("Q14", "orphan patent_id", count_if(~cascaded & ~known), _DROP),
        ("Q15", "orphan inventor_id", count_if(known & named.isNull()), _DROP),
        ("Q16", "orphan company_id", count_if(kept & unknown_company), _NULL),
        ("Q17", "no company", count_if(kept & no_company), _ONLY_REPORT),
    ]
    return _report_rows(assessed, "relations", checks)


def star_null_summary(star: Star) -> DataFrame:
    """Check 18: nulls per column of each repaired table."""
    return reduce(DataFrame.unionByName, (null_summary(df, name) for name, df in star.items()))


class CheckedStar(Star):
    """The repaired star, and the report of checks 1 to 17.

    ``assessed_*`` hold the tables with duplicates merged, nothing dropped yet, and the flags of
    the checks. They are what a writing stage stores: the repaired tables and the report are
    filters, projections and counts over them. Tables named in ``unique`` hold each id once.
    """

    def __init__(
        self,
        star: Star,
        stage: Stage,
        years: Years = VALID_YEARS,
        unique: Collection[str] = (),
        rules: DataFrame | None = None,
    ):
        self._star, self._stage, self._unique = star, stage, frozenset(unique)
        self.years, self._rules = years, rules

    @cached_property
    def rules(self) -> DataFrame:
        """The rule table of wrong places, by default the known ones."""
        return known_rules(self._star.inventors.sparkSession) if self._rules is None else self._rules

    def _facts(self, table: str, key: str) -> KeyFacts | None:
        """What the stage knows of a table it has written; a lazy one knows nothing."""
        known = getattr(self._stage, "key_facts", None)
        return known(table, key) if known else None

    @cached_property
    def assessed_patents(self) -> DataFrame:
        patents = self._star.patents
        unique, facts = "patents" in self._unique, self._facts("patents", "patent_id")
        assessed = assess_patents(patents, facts, unique)
        # A projection of stored patents is not worth storing; merged ones are.
        return assessed if unique or (facts and facts.unique) else self._stage(assessed, "assessed_patents")

    @cached_property
    def assessed_inventors(self) -> DataFrame:
        return self._stage(
            assess_inventors(self._star.inventors, self.rules, "inventors" in self._unique), "assessed_inventors"
        )

    @cached_property
    def assessed_companies(self) -> DataFrame:
        return self._stage(
            assess_companies(self._star.companies, self.rules, "companies" in self._unique), "assessed_companies"
        )

    @cached_property
    def assessed_relations(self) -> DataFrame:
        links = self._star.relations
        entities = concurrently(
            lambda: self.assessed_patents,
            lambda: self.assessed_inventors,
            lambda: self.assessed_companies,
        )
        return self._stage(assess_relations(links, *entities, self.years), "assessed_relations")

    @cached_property
    def patents(self) -> DataFrame:
        return repaired_patents(self.assessed_patents, self.years)

    @cached_property
    def inventors(self) -> DataFrame:
        return repaired_inventors(self.assessed_inventors, self.rules)

    @cached_property
    def companies(self) -> DataFrame:
        return repaired_companies(self.assessed_companies, self.rules)

    @cached_property
    def relations(self) -> DataFrame:
        return repaired_relations(self.assessed_relations)

    @cached_property
    def report(self) -> DataFrame:
        """(check_id, table, check, found, fixed, action).

        What a check fixes is counted once: found minus fixed is what remains.
        """
        rows = (
            patent_checks(self.assessed_patents, self.years)
            .unionByName(inventor_checks(self.assessed_inventors, self.rules))
            .unionByName(company_checks(self.assessed_companies, self.rules))
            .unionByName(relation_checks(self.assessed_relations))
        )
        return self._stage(rows, "quality_report")


def quality_check(
    star: Star,
    stage: Stage = lazy,
    years: Years = VALID_YEARS,
    unique: Collection[str] = (),
    rules: DataFrame | None = None,
) -> CheckedStar:
    """Check and repair a star. The input tables are left as they are.

    Patents of other ``years`` are dropped. ``unique`` names tables that are known to hold each id
    once (inventors and companies as ``clean`` builds them); they are not grouped again. ``rules`` is a table of
    wrong places (``geocodes.read_geocode_rules``) in place of the known ones.
    """
    return CheckedStar(star, stage, years, unique, rules)
