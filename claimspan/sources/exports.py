"""Results as CSV or JSON files, written in parallel into a timestamped folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: timestamp format of export names.
TIMESTAMP = "%Y-%m-%d--%H-%M"


def export_name(root: str, at: dt.datetime | None = None) -> str:
    return f"{(at or dt.datetime.now()).strftime(TIMESTAMP)}__{root}"


def grouped_root(columns: Sequence[str]) -> str:
    """Name of a grouped result, after its group columns."""
    return "__".join(["claims_grouped_by", *(columns or ["empty_column_list"])])


def export_csv(df: DataFrame, folder: str, root: str, at: dt.datetime | None = None) -> str:
    """Write CSV files with a header, nulls as empty cells; returns their folder."""
    path = f"{folder}/{export_name(root, at)}"
    df.write.csv(path, header=True)
    return path


def export_json(df: DataFrame, folder: str, root: str, at: dt.datetime | None = None) -> str:
    """Write one JSON object per row, nulls included; returns the folder."""
    path = f"{folder}/{export_name(root, at)}"
    df.write.json(path, ignoreNullFields=False)
    return path


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for results that are handed on rather than written."""
    return df.select(row_json(df).alias("json"))


def row_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
