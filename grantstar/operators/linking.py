"""Joins between links and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantstar.schemas import Stage, lazy


def only_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the known ids. Rows with a null key go."""
    return df.join(known.select(key), key, "left_semi")


def only_unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ids. Rows with a null key stay."""
    return df.join(known.select(key), key, "left_anti")


def bridge(
    patents: DataFrame, inventor_links: DataFrame, owner_links: DataFrame, stage: Stage = lazy
) -> DataFrame:
    """(patent, inventor) left-joined to (patent, company): one row per combination.

    A left outer join can split a hot patent on its left side only. Here the ``patents`` that have
    no owner get one explicit row with a null company first, so the large join is an inner one and
    may be split on either side. ``patents`` must hold every patent id of the inventor links.

    All joins are on one key, so without a break they run in one stage, and each task holds the sort buffers and
    hash tables of all of them at once. A ``stage`` that writes breaks it at the distinct links of either side; those of the
    owners, read twice, are then worked out once.
    """
    inventors = stage(inventor_links.select("patent_id", "inventor_id").distinct(), "inventor_links")
    owners = stage(owner_links.select("patent_id", "company_id").distinct(), "owner_links")
    owned = owners.select("patent_id").distinct()
    unowned = only_unknown(patents.select("patent_id").distinct(), owned, "patent_id")
    no_company = F.lit(None).cast("string").alias("company_id")
    owners = owners.unionByName(unowned.select("patent_id", no_company))
    return inventors.join(owners, "patent_id").select("patent_id", "inventor_id", "company_id")
