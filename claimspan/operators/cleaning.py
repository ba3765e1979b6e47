"""From a raw claims export to clean, typed claims on business days."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspan.constants import (
    ANCHOR_DATE, CANONICAL_NAMES, COST_SPELLINGS, NAME_REPLACEMENTS, NULL_FILLS,
    RECOMPUTED_COLUMNS, REPROJECTED_DATES,
)
from claimspan.functions.bizcal import BusinessCalendar
from claimspan.schemas import CLAIMS_RAW_BIZ
from claimspan.sources.tables import conform, require_columns


def clean_name(name: str) -> str:
    """One column name: lower case, plain characters, no stray ends."""
    # Spark calls a column without header _c8, the source tools call it Unnamed: 8.
    name = re.sub(r"^_c(\d+)$", r"unnamed: \1", name.lower())
    for old, new in NAME_REPLACEMENTS:
        name = name.replace(old, new)
    return re.sub(r"_{1,3}$", "", re.sub(r"^_|'$", "", name))


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every column name, then apply the canonical names."""
    return df.toDF(*map(clean_name, df.columns)).withColumnsRenamed(CANONICAL_NAMES)


def drop_recomputed(df: DataFrame) -> DataFrame:
    """Drop the columns that the build computes; all of them must be there."""
    require_columns(df, RECOMPUTED_COLUMNS)
    return df.drop(*RECOMPUTED_COLUMNS)


def fill_missing(df: DataFrame) -> DataFrame:
    """Give missing cells their meaning and bring the cost per hour to a number."""
    return (
        df.replace(COST_SPELLINGS, subset=["dollar_cost_per_hour"])
        .withColumn("dollar_cost_per_hour", F.col("dollar_cost_per_hour").cast("double"))
        .fillna(NULL_FILLS)
    )


def reproject_dates(df: DataFrame, calendar: BusinessCalendar, anchor: str = ANCHOR_DATE,
                    columns: tuple[str, ...] = REPROJECTED_DATES) -> DataFrame:
    """Turn calendar days after the anchor into business days after it."""
    return df.withColumns({c: calendar.reproject(anchor, c) for c in columns})


def typed(df: DataFrame) -> DataFrame:
    """Cast text cells to the declared types, but for the cost, which needs cleaning first."""
    types = {f.name: f.dataType for f in CLAIMS_RAW_BIZ if f.name != "dollar_cost_per_hour"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def ingest_claims(exported: DataFrame, calendar: BusinessCalendar) -> DataFrame:
    """All cleaning steps: an export with text cells becomes ``claims_raw_biz``."""
    cleaned = fill_missing(typed(drop_recomputed(clean_names(exported))))
    return conform(reproject_dates(cleaned, calendar), CLAIMS_RAW_BIZ)
