"""Questions of users as SQL with named parameters: a term is a value, never a part of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grantstar.plans.quality import LAST_YEAR
from grantstar.schemas import Star

SEARCH = """
select distinct p.patent_id, p.title, p.year, p.filing_date, c.name as company, c.country as company_country
from {patents} p
left join {relations} r on p.patent_id = r.patent_id
left join {companies} c on r.company_id = c.company_id
where p.year between :year_from and :year_to and (:term = '' or contains(lower(p.title), lower(:term)))
order by p.year desc, p.patent_id, company nulls last, company_country nulls last
limit :k
"""

DRILL_DOWN = """
select c.name as company, c.country, c.city, p.title, p.year, i.name as inventor, i.country as inv_country
from {companies} c
join {relations} r on c.company_id = r.company_id
join {patents} p on r.patent_id = p.patent_id
join {inventors} i on r.inventor_id = i.inventor_id
where c.country = :country
order by c.company_id, p.patent_id, i.inventor_id
limit :k
"""


def ask(star: Star, text: str, **values) -> DataFrame:
    """A SQL text over the four tables, written ``{patents}`` and so on, with ``:name`` for each value. No view is left behind."""
    return star.patents.sparkSession.sql(text, args=values, **dict(star.items()))


def search_patents_sql(
    star: Star, term: str = "", year_from: int = 2015, year_to: int = LAST_YEAR, k: int = 200
) -> DataFrame:
    return ask(star, SEARCH, term=term, year_from=year_from, year_to=year_to, k=k)


def suspicious_geocodes_sql(star: Star, country: str, k: int = 10) -> DataFrame:
    return ask(star, DRILL_DOWN, country=country, k=k)
