"""A stored cube: what the claims of each decision day and group add up to.

A row has a decision day, the eight dimensions and the additive parts that all measures are worked
out from. Turn-around times, effort, the drill-down and the base aggregate take such a table in
the place of the claims and sum its parts, whatever columns and days they ask for, so that a user
who adds a level to a drill-down does not scan claims again. Parts are whole numbers and
decimals: summing them in another order, or in two steps, gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType

from claimspan.plans.aggregates import BASE_DIMENSIONS, PART_PREFIX, part_aggregates
from claimspan.sources.tables import conform, read_stage, write_stage

DAY = "decided_2_date"
_KEYS = (DAY, *BASE_DIMENSIONS)


def cube_schema(spark: SparkSession) -> StructType:
    """Day, dimensions and parts; hours are exact."""
    parts = [StructField(PART_PREFIX + name,
                         DecimalType(28, 6) if name.endswith("hours_sum") else LongType())
             for name in part_aggregates()]
    return StructType([StructField(DAY, DateType()),
                       *(StructField(name, StringType()) for name in BASE_DIMENSIONS), *parts])


def cube_of(claims: DataFrame) -> DataFrame:
    """The cube of claims. Claims without a decision date are in it under a null day."""
    return claims.groupBy(*_KEYS).agg(
        *(part.alias(PART_PREFIX + name) for name, part in part_aggregates().items()))


def merged(*cubes: DataFrame) -> DataFrame:
    """One cube from those of disjoint claims."""
    rows = cubes[0]
    for other in cubes[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*_KEYS).agg(*(F.sum(name).alias(name) for name in rows.columns
                                      if name.startswith(PART_PREFIX)))


def write_cube(claims: DataFrame, path: str) -> None:
    """Replace the stored cube by that of these claims."""
    _store(cube_of(claims), path)


def add_to_cube(claims: DataFrame, path: str) -> None:
    """Add a batch of further claims to the stored cube; the claims before are not read."""
    _store(merged(read_cube(claims.sparkSession, path), cube_of(claims)), path)


def _store(cube: DataFrame, path: str) -> None:
    """In ranges of days, so that the statistics of files prune by period."""
    schema = cube_schema(cube.sparkSession)
    write_stage(conform(cube, schema).repartitionByRange(DAY).sortWithinPartitions(DAY),
                path, schema)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return read_stage(spark, path, cube_schema(spark))
