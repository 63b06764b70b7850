"""One SQL text per registered query.

The texts share three lists of CTEs: the raw feeds, the star of the class built from them in plain
SQL, and a star left dirty on purpose. None of them uses the engine.
"""

from __future__ import annotations

_FEEDS = """
raw_patent as (
  select cast(o_orderkey as varchar) patent_id,
         case when o_orderkey % 97 = 0 then '  ' else concat(' Order ', o_orderpriority, ' ') end patent_title,
         case when o_orderkey % 101 = 0 then null else cast(o_orderdate as date) end patent_date,
         case when o_orderpriority = '4-NOT SPECIFIED' then 'design' else 'utility' end patent_type,
         case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then '1' else ' 0' end withdrawn
  from orders),
raw_cpc as (
  select cast(l_orderkey as varchar) patent_id, p_brand cpc_group
  from lineitem join part on l_partkey = p_partkey),
raw_abstract as (
  select cast(doc_id as varchar) patent_id, text patent_abstract from documents),
raw_location as (
  select concat('n', cast(n_nationkey as varchar)) location_id,
         case when n_nationkey = 0 then null else n_name end country,
         r_name city, concat('S', cast(r_regionkey as varchar)) state
  from nation join region on n_regionkey = r_regionkey),
raw_inventor as (
  select cast(l_orderkey as varchar) patent_id, cast(s_suppkey as varchar) inventor_id,
         substring(s_name, 1, 8) first_name,
         case when s_suppkey % 10 = 0 then null else substring(s_name, 9, 20) end last_name,
         concat('n', cast(s_nationkey as varchar)) location_id
  from lineitem join supplier on l_suppkey = s_suppkey),
raw_assignee as (
  select cast(o_orderkey as varchar) patent_id,
         case when o_orderpriority <> '5-LOW' then cast(c_custkey as varchar) end assignee_id,
         case when c_custkey % 3 = 0 then null else c_name end organization,
         case when c_custkey % 6 = 0 then null else c_mktsegment end first_name,
         cast(null as varchar) last_name, c_nationkey assignee_type,
         concat('n', cast(c_nationkey as varchar)) location_id
  from orders join customer on o_custkey = c_custkey),
green as (select distinct patent_id from raw_cpc where cpc_group like 'Brand#1%'),
chosen as (
  select p.patent_id, trim(p.patent_title) title, p.patent_date filing_date,
         cast(year(p.patent_date) as integer) yr
  from raw_patent p join green g on p.patent_id = g.patent_id
  where p.patent_type = 'utility' and trim(p.withdrawn) = '0' and p.patent_title is not null),
named_owner as (
  select patent_id, assignee_id company_id, assignee_type, location_id,
         coalesce(nullif(trim(organization), ''),
                  nullif(trim(concat(coalesce(trim(first_name), ''), ' ', coalesce(trim(last_name), ''))), '')) name
  from raw_assignee)"""

# Cleaned, not yet checked.
_CLEAN = (
    _FEEDS
    + """,
clean_patents as (
  select c.patent_id, c.title, coalesce(trim(a.patent_abstract, chr(9) || chr(10) || chr(13) || ' '), '') abstract,
         c.filing_date, c.yr
  from chosen c left join raw_abstract a on c.patent_id = a.patent_id),
clean_inventors as (
  select distinct r.inventor_id, trim(concat(coalesce(r.first_name, ''), ' ', coalesce(r.last_name, ''))) name,
         l.country, l.city, l.state
  from raw_inventor r join chosen p on r.patent_id = p.patent_id
  left join raw_location l on r.location_id = l.location_id),
clean_companies as (
  select distinct r.company_id, r.name, r.assignee_type, l.country, l.city, l.state
  from named_owner r join chosen p on r.patent_id = p.patent_id
  left join raw_location l on r.location_id = l.location_id
  where r.name is not null and r.company_id is not null),
clean_relations as (
  select i.patent_id, i.inventor_id, a.assignee_id company_id
  from (select distinct r.patent_id, r.inventor_id from raw_inventor r join chosen p on r.patent_id = p.patent_id) i
  left join (select distinct patent_id, assignee_id from raw_assignee) a on i.patent_id = a.patent_id)"""
)

# Checked. The stand-in feeds repeat no id and hold no blank entity name, so the checks only drop
# patents without title or year, and null the links of nameless companies.
_STAR = (
    _CLEAN
    + """,
patents as (select * from clean_patents where title <> '' and yr between 1976 and 2025),
inventors as (select * from clean_inventors),
companies as (select * from clean_companies),
relations as (
  select r.patent_id, r.inventor_id, c.company_id
  from clean_relations r join patents p on r.patent_id = p.patent_id
  left join companies c on r.company_id = c.company_id),
inventor_counts as (
  select i.inventor_id, i.name, i.country, i.city, count(distinct r.patent_id) n
  from inventors i join relations r on i.inventor_id = r.inventor_id
  where i.name is not null and i.name <> ''
  group by i.inventor_id, i.name, i.country, i.city),
company_counts as (
  select c.company_id, c.name, c.country, count(distinct r.patent_id) n
  from companies c join relations r on c.company_id = r.company_id
  where c.name is not null and c.name <> ''
  group by c.company_id, c.name, c.country),
inventor_countries as (
  select i.country, count(distinct r.patent_id) n
  from inventors i join relations r on i.inventor_id = r.inventor_id
  where i.country is not null and i.country <> '' group by i.country),
company_countries as (
  select c.country, count(distinct r.patent_id) n
  from companies c join relations r on c.company_id = r.company_id
  where c.country is not null and c.country <> '' group by c.country),
inventor_shares as (
  select country, n patent_count, round(cast(100 as double) * n / sum(n) over (), 2) pct_share from inventor_countries),
company_shares as (
  select country, n patent_count, round(cast(100 as double) * n / sum(n) over (), 2) pct_share from company_countries),
yearly as (select yr, count(*) n from patents where yr between 1976 and 2025 group by yr),
trends as (
  select yr as year, n patent_count, cast(sum(n) over (order by yr) as bigint) cumulative_total from yearly),
top20_inventors as (select * from inventor_counts order by n desc, inventor_id limit 20),
top20_companies as (select * from company_counts order by n desc, company_id limit 20),
full_rows as (
  select p.patent_id, p.title, p.yr as year, cast(p.filing_date as varchar) filing_date, r.inventor_id, r.company_id,
         i.name inventor_name, i.country inventor_country, i.city inventor_city,
         c.name company_name, c.country company_country
  from patents p join relations r on p.patent_id = r.patent_id
  join inventors i on r.inventor_id = i.inventor_id
  left join companies c on r.company_id = c.company_id
  where p.yr is not null),
found_rows as (
  select distinct p.patent_id, p.title, p.yr as year, cast(p.filing_date as varchar) filing_date,
         c.name company, c.country company_country
  from patents p left join relations r on p.patent_id = r.patent_id
  left join companies c on r.company_id = c.company_id),
peak as (select yr, n from yearly order by n desc, yr limit 1),
growth as (
  select max(case when yr = 1996 then n end) a, max(case when yr = 2000 then n end) b from yearly),
unassigned as (select count(distinct patent_id) n from relations where company_id is null),
kpis as (
  select (select count(*) from patents) total_patents, (select min(yr) from patents) first_year,
         (select max(yr) from patents) last_year, (select count(*) from inventors) total_inventors,
         (select count(*) from companies) total_companies, (select n from unassigned) unassigned_patents,
         (select yr from peak) peak_year, (select n from peak) peak_patents,
         (select round(cast(100 as double) * (b - a) / a, 1) from growth) growth_pct)"""
)

# The dirty star and its repair, one step after the other as a person would do it.
_DIRTY = """
place as (
  select n_nationkey,
         case n_nationkey when 1 then 'UG' when 2 then 'CM' when 3 then 'JP' when 0 then null else n_name end country,
         case n_nationkey when 1 then 'Amuru' when 2 then 'Somalomo' when 3 then 'Amuru'
              else concat('City ', cast(n_regionkey as varchar)) end city,
         concat('S', cast(n_regionkey as varchar)) state
  from nation),
d_patents as (
  select cast(o_orderkey as varchar) patent_id,
         case when o_orderkey % 97 = 0 then '  ' else concat(' Order ', o_orderpriority, ' ') end title,
         text abstract,
         case when o_orderkey % 101 = 0 then null else cast(o_orderdate as date) end filing_date,
         year(o_orderdate) + case when o_totalprice > 450000 then 100 else 0 end yr
  from orders left join documents on o_orderkey = doc_id
  union all
  select cast(o_orderkey as varchar), 'Zweitschrift', null, cast(o_orderdate as date), year(o_orderdate)
  from orders where o_orderpriority = '1-URGENT'),
d_supplier as (
  select cast(s_suppkey as varchar) inventor_id, case when s_suppkey % 10 = 0 then null else s_name end name,
         country, city, state, s_acctbal
  from supplier join place on s_nationkey = n_nationkey),
d_inventors as (
  select inventor_id, name, country, city, state from d_supplier
  union all
  select inventor_id, '~copy', country, city, state from d_supplier where s_acctbal < 0),
d_customer as (
  select cast(c_custkey as varchar) company_id, case when c_custkey % 6 = 0 then ' ' else c_name end name,
         c_nationkey assignee_type, country, city, state, c_acctbal
  from customer join place on c_nationkey = n_nationkey),
d_companies as (
  select company_id, name, assignee_type, country, city, state from d_customer
  union all
  select company_id, '~copy', assignee_type, country, city, state from d_customer where c_acctbal < 0),
d_relations as (
  select distinct concat(case when o_orderpriority = '4-NOT SPECIFIED' then 'lost' else '' end, l_orderkey) patent_id,
         concat(case when l_suppkey % 7 = 3 then 'lost' else '' end, l_suppkey) inventor_id,
         case when o_orderpriority <> '5-LOW'
              then concat(case when o_custkey % 5 = 2 then 'lost' else '' end, o_custkey) end company_id
  from lineitem join orders on l_orderkey = o_orderkey),
tidy_patents as (
  select patent_id, nullif(trim(title), '') title,
         nullif(trim(abstract, chr(9) || chr(10) || chr(13) || ' '), '') abstract, filing_date, cast(yr as integer) yr
  from d_patents),
first_patents as (
  select * from (
    select *, row_number() over (partition by patent_id order by filing_date asc nulls last, title asc nulls last,
                                 yr asc nulls last, abstract asc nulls last) rn
    from tidy_patents) where rn = 1),
titled as (select * from first_patents where title is not null),
r_patents as (select * from titled where yr between 1976 and 2025),
first_inventors as (
  select * from (
    select *, row_number() over (partition by inventor_id order by nullif(trim(name), '') asc nulls last,
                                 country asc nulls last, city asc nulls last, state asc nulls last) rn
    from d_inventors) where rn = 1),
named_inventors as (select * from first_inventors where trim(coalesce(name, '')) <> ''),
wrong_inventors as (
  select inventor_id, city from named_inventors
  where (country = 'UG' and city = 'Amuru') or (country = 'CM' and city = 'Somalomo')),
r_inventors as (
  select inventor_id, name,
         case when inventor_id in (select inventor_id from wrong_inventors) then 'JP' else country end country,
         case when inventor_id in (select inventor_id from wrong_inventors) then null
              when country = 'JP' and city in (select city from wrong_inventors) then null else city end city,
         state
  from named_inventors),
first_companies as (
  select * from (
    select *, row_number() over (partition by company_id order by nullif(trim(name), '') asc nulls last,
                                 assignee_type, country asc nulls last, city asc nulls last, state asc nulls last) rn
    from d_companies) where rn = 1),
named_companies as (select * from first_companies where trim(name) <> ''),
wrong_companies as (select company_id, city from named_companies where country = 'UG' and city = 'Amuru'),
r_companies as (
  select company_id, trim(name) name, assignee_type,
         case when company_id in (select company_id from wrong_companies) then 'JP' else country end country,
         case when company_id in (select company_id from wrong_companies) then null
              when country = 'JP' and city in (select city from wrong_companies) then null else city end city,
         state
  from named_companies),
links1 as (
  select * from d_relations r
  where not exists (select 1 from first_inventors f where f.inventor_id = r.inventor_id and trim(coalesce(f.name, '')) = '')),
links2 as (select * from links1 where patent_id in (select patent_id from r_patents)),
links3 as (select * from links2 where inventor_id in (select inventor_id from r_inventors)),
links4 as (
  select patent_id, inventor_id,
         case when company_id in (select company_id from first_companies where trim(name) = '') then null else company_id end company_id
  from links3),
r_relations as (
  select patent_id, inventor_id,
         case when company_id in (select company_id from r_companies) then company_id end company_id
  from links4),
report as (
  select 'Q01' check_id, 'patents' as "table", 'duplicate patent_id' as "check",
         (select count(*) from d_patents) - (select count(*) from first_patents) found, 'keep first' as action
  union all select 'Q02', 'patents', 'empty title', (select count(*) from first_patents where title is null), 'drop row'
  union all select 'Q03', 'patents', 'empty abstract', (select count(*) from titled where abstract is null), 'report'
  union all select 'Q04', 'patents', 'missing or invalid year',
                   (select count(*) from titled) - (select count(*) from r_patents), 'drop row'
  union all select 'Q05', 'patents', 'missing filing date', (select count(*) from r_patents where filing_date is null), 'report'
  union all select 'Q06', 'inventors', 'duplicate inventor_id',
                   (select count(*) from d_inventors) - (select count(*) from first_inventors), 'keep first'
  union all select 'Q07', 'inventors', 'empty inventor name',
                   (select count(*) from first_inventors) - (select count(*) from named_inventors), 'drop row'
  union all select 'Q08', 'inventors', 'missing inventor country',
                   (select count(*) from named_inventors where country is null), 'report'
  union all select 'Q09a', 'inventors', 'wrong geocode UG/Amuru',
                   (select count(*) from named_inventors where country = 'UG' and city = 'Amuru'), 'correct'
  union all select 'Q09b', 'inventors', 'wrong geocode CM/Somalomo',
                   (select count(*) from named_inventors where country = 'CM' and city = 'Somalomo'), 'correct'
  union all select 'Q10', 'companies', 'duplicate company_id',
                   (select count(*) from d_companies) - (select count(*) from first_companies), 'keep first'
  union all select 'Q11', 'companies', 'empty company name',
                   (select count(*) from first_companies) - (select count(*) from named_companies), 'drop row'
  union all select 'Q12', 'companies', 'wrong geocode UG/Amuru', (select count(*) from wrong_companies), 'correct'
  union all select 'Q13', 'companies', 'missing company country',
                   (select count(*) from named_companies where country is null), 'report'
  union all select 'Q14', 'relations', 'orphan patent_id',
                   (select count(*) from links1) - (select count(*) from links2), 'drop row'
  union all select 'Q15', 'relations', 'orphan inventor_id',
                   (select count(*) from links2) - (select count(*) from links3), 'drop row'
  union all select 'Q16', 'relations', 'orphan company_id',
                   (select count(*) from links4 where company_id is not null and company_id not in (select company_id from r_companies)), 'null the link'
  union all select 'Q17', 'relations', 'no company', (select count(*) from r_relations where company_id is null), 'report'),
full_report as (
  select check_id, "table", "check", cast(found as bigint) found,
         cast(case when action = 'report' then 0 else found end as bigint) fixed, action
  from report)"""


def _over(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select.strip()}"


def _nulls(table: str, columns: list[str], label: str) -> str:
    parts = [
        f"select '{label}' as \"table\", '{'year' if c == 'yr' else c}' as \"column\", "
        f"count(*) - count({c}) nulls, count(*) total from {table}"
        for c in columns
    ]
    return " union all ".join(parts)


_NULL_ROWS = " union all ".join(
    [
        _nulls("(select patent_id, title, coalesce(abstract, '') abstract, filing_date, yr from r_patents)",
               ["patent_id", "title", "abstract", "filing_date", "yr"], "patents"),
        _nulls("r_inventors", ["inventor_id", "name", "country", "city", "state"], "inventors"),
        _nulls("r_companies", ["company_id", "name", "assignee_type", "country", "city", "state"], "companies"),
        _nulls("r_relations", ["patent_id", "inventor_id", "company_id"], "relations"),
    ]
)

_PREFIXES = ("Brand#1", "Brand#10", "Brand#12", "Brand#19", "Brand#3", "Brand#99")

_DETAIL = """patent_id, title, year, filing_date, inventor_name, inventor_country, inventor_city,
       company_name, company_country"""

ORACLES: dict[str, str] = {}


def _star(name: str, select: str) -> None:
    ORACLES[name] = _over(_STAR, select)


_star("top_inventors", "select name, country, city, n patent_count from top20_inventors")
_star(
    "top_inventors_by_country_filter",
    """select name, country, city, n patent_count from inventor_counts
where country in ('NATION_3', 'NATION_7', 'NATION_15') order by n desc, inventor_id limit 20""",
)
_star("top_companies", "select name, country, n patent_count from top20_companies")
_star("top_companies_full", "select name, country, n patent_count from company_counts")
_star("country_share_inventor_full", "select * from inventor_shares")
_star(
    "country_share_inventor",
    "select * from inventor_shares order by patent_count desc, country limit 30",
)
_star(
    "country_share_company",
    "select * from company_shares order by patent_count desc, country limit 30",
)
_star("yearly_trends", "select * from trends order by year")
_star("yearly_trends_shown_range", "select * from trends where year between 1997 and 2000")
_star("milestone_trends", "select * from trends where year in (1995, 1997, 2000)")
_star(
    "patent_detail_join",
    f"""select {_DETAIL} from full_rows
order by year desc, patent_id, inventor_id, company_id asc nulls last limit 20""",
)
_star("patent_detail_join_full", f"select {_DETAIL} from full_rows")
_star(
    "spot_check",
    """select patent_id, substring(title, 1, 65) title, year, inventor_name inventor, inventor_country inv_country,
       company_name company, company_country comp_country
from full_rows order by year desc, patent_id, inventor_id, company_id asc nulls last limit 3""",
)
_star(
    "above_average_companies",
    """select name, country, n patent_count, round(m.mean, 2) avg_patents, round(n / m.mean, 2) multiple_of_avg
from company_counts cross join (select avg(n) mean from company_counts) m
where n > m.mean order by n desc, company_id limit 30""",
)
_star(
    "above_average_companies_1digit",
    """select name, country, n patent_count, round(n / m.mean, 1) multiple_of_avg
from company_counts cross join (select avg(n) mean from company_counts) m
where n > m.mean order by n desc, company_id limit 15""",
)
_RANKINGS = """select name, country, city, n patent_count,
       rank() over (order by n desc) overall_rank,
       dense_rank() over (partition by country order by n desc) rank_in_country,
       round(cast(100 as double) * n / sum(n) over (), 4) pct_of_total
from inventor_counts"""
_star("inventor_rankings", f"{_RANKINGS} order by n desc, inventor_id limit 50")
_star("inventor_rankings_full", _RANKINGS)
_star("dataset_kpis", "select * from kpis")
_star("unassigned_patents", "select n unassigned_patents from unassigned")
_star("peak_year", "select yr peak_year, n peak_patents from peak")
_star(
    "period_growth",
    """select a first_count, b last_count, round(cast(100 as double) * (b - a) / a, 1) growth_pct from growth""",
)
_star(
    "cutoff_totals",
    """select cast(sum(case when yr between 1996 and 1996 then n else 0 end) as bigint) patents_by_1996,
       cast(sum(case when yr between 1996 and 1998 then n else 0 end) as bigint) patents_by_1998,
       cast(sum(case when yr between 1996 and 2000 then n else 0 end) as bigint) patents_by_2000,
       (select yr from peak) peak_year, (select n from peak) peak_patents
from yearly""",
)
_star(
    "country_comparison",
    """select i.country, i.patent_count patents_inventor, i.pct_share pct_inventor,
       c.patent_count patents_company, c.pct_share pct_company, i.patent_count - c.patent_count difference
from (select * from inventor_shares order by patent_count desc, country limit 15) i
join (select * from company_shares order by patent_count desc, country limit 15) c on i.country = c.country""",
)
_star(
    "search_patents",
    """select * from found_rows where year between 1996 and 2000 and lower(title) like '%urgent%'
order by year desc, patent_id, company asc nulls last, company_country asc nulls last limit 200""",
)
_star("search_patents_full", "select * from found_rows where year between 1995 and 2025")
_star(
    "search_patents_common_term",
    """select * from found_rows where year between 1995 and 2000 and lower(title) like '% or%'
order by year desc, patent_id, company nulls last, company_country nulls last limit 50""",
)
_star("search_patents_short_term", "select * from found_rows where year between 1995 and 2025 and title like '%1-%'")
_star(
    "counts_after_a_second_delivery",
    """select 'inventor' kind, inventor_id as "key", count(distinct patent_id) patent_count from relations group by inventor_id
union all select 'company', company_id, count(distinct patent_id) from relations where company_id is not null group by company_id
union all select 'unassigned', '', count(distinct patent_id) from relations where company_id is null
union all select 'inventor country', country, n from inventor_countries
union all select 'company country', country, n from company_countries""",
)
_CODES = "(select n_name from nation where n_regionkey <> 1)"
_star("known_country_companies", f"select * from companies where country in {_CODES}")
_star("known_country_inventors", f"select * from inventors where country in {_CODES}")
_star(
    "unknown_countries",
    f"""select 'inventors' as "table", country, count(*) as rows from inventors
where country is null or country not in {_CODES} group by country
union all
select 'companies', country, count(*) from companies where country is null or country not in {_CODES} group by country""",
)
_star(
    "top_inventor_countries",
    """select country, count(*) inventors from top20_inventors where country is not null group by country""",
)
_star(
    "top_company_countries",
    """select country, cast(sum(n) as bigint) patents from top20_companies
where country is not null group by country""",
)
_star(
    "country_options",
    """select distinct i.country from inventors i join relations r on i.inventor_id = r.inventor_id
where i.country is not null""",
)
_star(
    "companies_in_country",
    "select company_id, name, country, city, state from companies where country = 'NATION_5'",
)
_star(
    "suspicious_geocodes",
    """select c.name company, c.country, c.city, p.title, p.yr as year, i.name inventor, i.country inv_country
from companies c join relations r on c.company_id = r.company_id
join patents p on r.patent_id = p.patent_id join inventors i on r.inventor_id = i.inventor_id
where c.country = 'NATION_5' order by c.company_id, p.patent_id, i.inventor_id limit 10""",
)
_star(
    "suspicious_geocodes_full",
    """select c.name company, c.country, c.city, p.title, p.yr as year, i.name inventor, i.country inv_country
from companies c join relations r on c.company_id = r.company_id
join patents p on r.patent_id = p.patent_id join inventors i on r.inventor_id = i.inventor_id
where c.country = 'NATION_5'""",
)
_star(
    "ranked_companies",
    """select row_number() over (order by n desc, name, country) as rank, name, country, n patent_count
from (select * from company_counts order by n desc, company_id limit 10)""",
)
_star(
    "verify_tables",
    """select 'patents' as "table", count(*) as rows, true columns_ok from patents
union all select 'inventors', count(*), true from inventors
union all select 'companies', count(*), true from companies
union all select 'relations', count(*), true from relations""",
)

_VERIFIED = "select '{0}' as \"table\", count(*) as rows, {1} columns_ok, {2} rows_ok, {3} content_ok from {0}"
_star(
    "verify_stored",
    " union all ".join(_VERIFIED.format(t, "true", "true", "true") for t in ("patents", "inventors", "companies", "relations")),
)
_star(
    "verify_damaged",
    " union all ".join(
        (
            _VERIFIED.format("patents", "false", "true", "false"),
            _VERIFIED.format("inventors", "true", "true", "false"),
            _VERIFIED.format("companies", "false", "false", "false") + " where length(company_id) % 2 = 1",
            _VERIFIED.format("relations", "true", "true", "true"),
        )
    ),
)
_star(
    "summary_metrics",
    """select 'Total green transport patents' metric, cast(total_patents as varchar) as value from kpis
union all select 'Year range (from)', cast(first_year as varchar) from kpis
union all select 'Year range (to)', cast(last_year as varchar) from kpis
union all select 'Unique inventors', cast(total_inventors as varchar) from kpis
union all select 'Unique companies', cast(total_companies as varchar) from kpis
union all select 'Unassigned patents', cast(unassigned_patents as varchar) from kpis
union all select 'Peak filing year', cast(peak_year as varchar) from kpis
union all select 'Peak year patent count', cast(peak_patents as varchar) from kpis
union all select 'Growth 1996-2000 (%)', cast(growth_pct as varchar) from kpis
union all (select 'Top inventor', name from inventor_counts order by n desc, inventor_id limit 1)
union all (select 'Top inventor patents', cast(n as varchar) from inventor_counts order by n desc, inventor_id limit 1)
union all (select 'Top company', name from company_counts order by n desc, company_id limit 1)
union all (select 'Top company patents', cast(n as varchar) from company_counts order by n desc, company_id limit 1)
union all (select 'Top country (inventor)', country from inventor_countries order by n desc, country limit 1)
union all (select 'Top country (company)', country from company_countries order by n desc, country limit 1)
union all select 'Geocoding errors fixed', cast((select count(*) from clean_inventors where (country = 'UG' and city = 'Amuru') or (country = 'CM' and city = 'Somalomo')) + (select count(*) from clean_companies where country = 'UG' and city = 'Amuru') as varchar)""",
)



def _ranked(rows: str, fields: str) -> str:
    """A short list of structs in rank order."""
    return f"(select list(struct_pack(rank := rn, {fields}) order by rn) from ({rows}))"


_TOP10 = "select *, row_number() over (order by n desc, {0}) rn from {1} order by n desc, {0} limit 10"
_TOP10_SHARES = (
    "select *, row_number() over (order by patent_count desc, country) rn from {0} "
    "order by patent_count desc, country limit 10"
)
_SHARE_FIELDS = "country := country, patent_count := patent_count, pct_share := pct_share"


def _wrong(table: str, country: str, city: str) -> str:
    source = {"inventors": "clean_inventors", "companies": "clean_companies"}[table]
    return (
        f"struct_pack(\"table\" := '{table}', wrong_country := '{country}', wrong_city := '{city}', corrected_to := 'JP', "
        f"fixed := (select count(*) from {source} where country = '{country}' and city = '{city}'))"
    )


_WRONG = [("inventors", "UG", "Amuru"), ("inventors", "CM", "Somalomo"), ("companies", "UG", "Amuru")]
_star(
    "report_json",
    f"""select cast(to_json(struct_pack(
  report_title := 'Green Transport Patent Intelligence Report',
  focus := 'CPC Y02T — Climate Change Mitigation in Transportation',
  generated := '1970-01-01 00:00:00',
  dataset := struct_pack(
    total_patents := total_patents, year_range := struct_pack("from" := first_year, "to" := last_year),
    total_inventors := total_inventors, total_companies := total_companies,
    unassigned_patents := unassigned_patents,
    peak_year := struct_pack("year" := peak_year, patent_count := peak_patents),
    growth_1996_to_2000_pct := growth_pct),
  y02t_subcategories := struct_pack(
    {", ".join(f'"{p}_brand" := (select count(distinct patent_id) from raw_cpc where cpc_group like {chr(39)}{p}%{chr(39)})' for p in _PREFIXES)},
    note := 'patents may appear in multiple subcategories'),
  top_inventors := {_ranked(_TOP10.format("inventor_id", "inventor_counts"), "name := name, country := country, city := city, patent_count := n")},
  top_companies := {_ranked(_TOP10.format("company_id", "company_counts"), "name := name, country := country, patent_count := n")},
  top_countries_by_inventor := {_ranked(_TOP10_SHARES.format("inventor_shares"), _SHARE_FIELDS)},
  top_countries_by_company := {_ranked(_TOP10_SHARES.format("company_shares"), _SHARE_FIELDS)},
  data_quality := struct_pack(
    geocoding_errors_fixed := 0,
    errors := [{", ".join(_wrong(*w) for w in _WRONG)}],
    missing_inventor_country_pct := (select round(cast(100 as double) * (count(*) - count(country)) / count(*), 1) from inventors),
    missing_company_country_pct := (select round(cast(100 as double) * (count(*) - count(country)) / count(*), 1) from companies),
    duplicate_records := (select count(*) - count(distinct patent_id) from clean_patents),
    orphaned_relations :=
      (select count(*) from clean_relations where patent_id not in (select patent_id from patents))
      + (select count(*) from clean_relations where patent_id in (select patent_id from patents)
         and company_id is not null and company_id not in (select company_id from companies))))) as varchar) report
from kpis""",
)
_star(
    "company_portfolio",
    """select c.company_id, c.name, count(distinct r.patent_id) patents, min(p.yr) first_patent, max(p.yr) latest_patent
from companies c join relations r on c.company_id = r.company_id join patents p on r.patent_id = p.patent_id
group by c.company_id, c.name""",
)
_star(
    "company_market_share",
    """select company_id, name, n patent_count, round(cast(100 as double) * n / sum(n) over (), 2) pct_share
from company_counts""",
)
_star(
    "listed_country_companies",
    "select * from companies where country in ('NATION_3', 'NATION_7', 'NATION_15')",
)
ORACLES["ascii_texts"] = (
    r"select doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') title from documents"
)
ORACLES["inventor_mobility"] = _over(
    _FEEDS,
    """select cast(l_suppkey as varchar) inventor_id, count(distinct l.country) countries
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join raw_location l on l.location_id = concat('n', cast(c_nationkey as varchar))
group by l_suppkey having count(distinct l.country) > 1""",
)

ORACLES["check_loaded_feeds"] = _over(
    _FEEDS,
    """select 'patent' feed, true as "exists", '' missing_columns, true ok, count(*) as rows from raw_patent
union all select 'abstract', true, '', true, count(*) from raw_abstract
union all select 'inventor', true, '', true, count(*) from raw_inventor
union all select 'assignee', true, '', true, count(*) from raw_assignee
union all select 'location', true, '', true, count(*) from raw_location
union all select 'cpc', true, '', true, count(*) from raw_cpc""",
)
ORACLES["check_sources"] = ORACLES["check_loaded_feeds"].replace(
    "count(*) as rows", "count(*) as rows, cast(0 as bigint) malformed"
).replace("count(*) from", "count(*), 0 from")
ORACLES["subcategory_breakdown"] = _over(
    _FEEDS,
    " union all ".join(
        f"select '{p}' prefix, count(distinct patent_id) patent_count from raw_cpc where cpc_group like '{p}%'"
        for p in _PREFIXES
    ),
)
ORACLES["filter_funnel"] = _over(
    _FEEDS
    + """,
f1 as (select * from raw_patent where patent_id in (select patent_id from green)),
f2 as (select * from f1 where patent_type = 'utility'),
f3 as (select * from f2 where trim(withdrawn) = '0'),
f4 as (select * from f3 where patent_title is not null),
steps as (
  select 0 step_no, 'loaded' step, count(*) as rows from raw_patent
  union all select 1, 'class', count(*) from f1
  union all select 2, 'utility', count(*) from f2
  union all select 3, 'not_withdrawn', count(*) from f3
  union all select 4, 'titled', count(*) from f4)""",
    "select step_no, step, rows, coalesce(lag(rows) over (order by step_no), rows) - rows removed from steps",
)
ORACLES["patent_type_counts"] = _over(
    _FEEDS, "select patent_type, count(*) as rows from raw_patent group by patent_type"
)
ORACLES["withdrawn_counts"] = _over(
    _FEEDS,
    """select trim(withdrawn) withdrawn, count(*) as rows from raw_patent
where patent_type = 'utility' and patent_id in (select patent_id from green) group by trim(withdrawn)""",
)
ORACLES["resolve_company_name"] = _over(
    _FEEDS, "select patent_id, company_id, name from named_owner"
)
ORACLES["bridge"] = _over(
    _FEEDS,
    """select i.patent_id, i.inventor_id, a.assignee_id company_id
from (select distinct patent_id, inventor_id from raw_inventor) i
left join (select distinct patent_id, assignee_id from raw_assignee) a on i.patent_id = a.patent_id""",
)
ORACLES["dedup_keep_first"] = _over(
    _FEEDS,
    """select patent_id, inventor_id, location_id, copies from (
  select patent_id, inventor_id, location_id,
         row_number() over (partition by patent_id order by inventor_id, location_id) rn,
         count(*) over (partition by patent_id) copies
  from raw_inventor) where rn = 1""",
)
_PATENT_ROWS = (
    "select patent_id, title, abstract, cast(filing_date as varchar) filing_date, yr as year from"
)
ORACLES["attach_abstracts"] = _over(_CLEAN, f"{_PATENT_ROWS} clean_patents")
ORACLES["clean_patents"] = _over(_CLEAN, f"{_PATENT_ROWS} clean_patents")
ORACLES["tsv_patents"] = ORACLES["clean_patents"]
ORACLES["tsv_relations"] = _over(_CLEAN, "select * from clean_relations")
ORACLES["clean_inventors"] = _over(_CLEAN, "select * from clean_inventors")
ORACLES["clean_companies"] = _over(_CLEAN, "select * from clean_companies")
ORACLES["clean_relations"] = _over(_CLEAN, "select * from clean_relations")
ORACLES["profile_entities"] = _over(
    _CLEAN,
    """select 'inventors' as "table", count(*) as rows, count(*) - count(country) missing,
       round(cast(100 as double) * (count(*) - count(country)) / count(*), 1) missing_pct from clean_inventors
union all
select 'companies', count(*), count(*) - count(country),
       round(cast(100 as double) * (count(*) - count(country)) / count(*), 1) from clean_companies""",
)
for _side in ("inventor", "company"):
    _table = {"inventor": "clean_inventors", "company": "clean_companies"}[_side]
    ORACLES[f"most_common_{_side}_countries"] = _over(
        _CLEAN,
        f"""select country, count(*) as rows from {_table} where country is not null
group by country order by count(*) desc, country limit 5""",
    )

ORACLES["quality_report"] = _over(_DIRTY, "select * from full_report")
ORACLES["quality_report_other_years"] = _over(
    _DIRTY.replace("between 1976 and 2025", "between 1996 and 1999"), "select * from full_report"
)
ORACLES["orphan_relations"] = _over(
    _DIRTY, """select * from full_report where "table" = 'relations' and found > 0"""
)
ORACLES["null_summary"] = _over(
    _DIRTY,
    f"""select "table", "column", nulls, round(cast(100 as double) * nulls / total, 1) pct,
       cast(100 as double) * nulls / total < 70 expected
from ({_NULL_ROWS}) where nulls > 0""",
)
ORACLES["repaired_patents"] = _over(
    _DIRTY,
    """select patent_id, title, coalesce(abstract, '') abstract, cast(filing_date as varchar) filing_date, yr as year
from r_patents""",
)
ORACLES["repair_geocodes"] = _over(_DIRTY, "select * from r_inventors")
ORACLES["repair_company_geocodes"] = _over(_DIRTY, "select * from r_companies")
ORACLES["cascade_empty_names"] = _over(_DIRTY, "select * from r_relations")
ORACLES["duplicate_patent_rows"] = _over(
    _DIRTY, "select count(*) - count(distinct patent_id) duplicates from d_patents"
)

ORACLES["search_patents_sql"] = ORACLES["search_patents"]
ORACLES["suspicious_geocodes_sql"] = ORACLES["suspicious_geocodes"]


def _ruled(table: str, least: int, columns: str) -> str:
    """Repair by a rule table: wrong places go to NATION_9; a city there goes if a rule for it was applied."""
    return f"""rules as (
  select n_name country, concat('City ', cast(n_regionkey as varchar)) city from nation
  where n_nationkey >= {least} and n_nationkey <> 9),
hits as (
  select e.country, e.city from named_{table} e join rules using (country, city)),
repaired as (
  select {columns},
         case when (country, city) in (select (country, city) from rules) then 'NATION_9' else country end country,
         case when (country, city) in (select (country, city) from rules) then null
              when country = 'NATION_9' and city in (select city from hits) then null else city end city,
         state
  from named_{table})"""


_FINDINGS = """select '{0}' as "table", concat('wrong geocode ', country, '/', city) as "check",
       (select count(*) from hits h where h.country = r.country and h.city = r.city) found,
       (select count(*) from hits h where h.country = r.country and h.city = r.city) fixed, 'correct' as action
from rules r"""
_INVENTOR_RULES = _DIRTY + ",\n" + _ruled("inventors", 4, "inventor_id, name")
_COMPANY_RULES = _DIRTY + ",\n" + _ruled("companies", 10, "company_id, trim(name) name, assignee_type")
ORACLES["rule_table_inventors"] = _over(_INVENTOR_RULES, "select * from repaired")
ORACLES["rule_table_companies"] = _over(_COMPANY_RULES, "select * from repaired")
ORACLES["rule_table_findings"] = (
    f"select * from ({_over(_INVENTOR_RULES, _FINDINGS.format('inventors'))}) "
    f"union all select * from ({_over(_COMPANY_RULES, _FINDINGS.format('companies'))})"
)
