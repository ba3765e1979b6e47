"""CSV inputs. Schemas are declared; nothing is inferred, which would read the data twice."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from claimspan.constants import ANALYST_PARAMETERS, DIAGNOSIS_PARAMETERS
from claimspan.schemas import ANALYST_PARAMS, DIAGNOSIS_PARAMS


def read_claims_export(spark: SparkSession, path: str) -> DataFrame:
    """A claims export: headers as found, every cell as text."""
    return spark.read.csv(path, header=True)


def read_parameters(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parameter CSV; empty cells are null. The query fails if the header does not name the
    schema's columns, in its order and in any case of letters."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def analyst_parameters(spark: SparkSession) -> DataFrame:
    """The standard analyst parameters."""
    return _literal(spark, ANALYST_PARAMETERS, ANALYST_PARAMS)


def diagnosis_parameters(spark: SparkSession) -> DataFrame:
    """The standard diagnosis parameters."""
    return _literal(spark, DIAGNOSIS_PARAMETERS, DIAGNOSIS_PARAMS)


def _literal(spark: SparkSession, rows: tuple[tuple, ...], schema: StructType) -> DataFrame:
    # Through Arrow Spark knows the exact size, so it can decide on a broadcast by itself.
    table = pa.table({f.name: list(cells) for f, cells in zip(schema, zip(*rows))})
    return spark.createDataFrame(table, schema=schema)
