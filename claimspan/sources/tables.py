"""Stage tables: declared schemas, replacing and appending writes, ordered reads, key checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, IntegerType, IntegralType, StringType, StructField, StructType,
)

from claimspan.constants import MILESTONES
from claimspan.functions.dates import DateLike, as_date
from claimspan.sources.key_digests import (
    colliding_parts, columns_of, without_null, write_digest,
)
from claimspan.sources.versions import Segment, current, delete, new_folder, publish

DECIDED_MONTH = "decided_month"
CLOSED_MONTH = "closed_month"
OPEN_LEVEL = "open_level"
OPEN_BLOCK = "open_block"
SEGMENT = "segment"
#: Files that a task writes at once, and the size of their row groups.
OPEN_FILES = 100
ROW_GROUP_BYTES = 16 << 20
#: Begins the name of a layout by the values of a column, which the column's name ends.
_BY_COLUMN = "column "
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_DECIDED = "decided_2_date"
_DATES = (*MILESTONES, "return_to_work_date")

#: Layouts of a table and their partition columns.
LAYOUTS = {
    "": [],
    "decided_month": [StructField(DECIDED_MONTH, DateType()),
                      StructField(CLOSED_MONTH, DateType())],
    "open_interval": [StructField(OPEN_LEVEL, IntegerType()),
                      StructField(OPEN_BLOCK, IntegerType())],
}


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns by name, in declared order and type; others are left out."""
    require_columns(df, schema.names)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("count")).where("count > 1")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """The frame itself, or a ValueError if a key repeats."""
    found = duplicate_keys(df, *key).head(1)
    if found:
        raise ValueError(f"duplicate key {', '.join(key)}, for example {found[0].asDict()}")
    return df


# ---- layouts ----------------------------------------------------------------------------


def month_number(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def _month_of(day: DateLike) -> int:
    day = as_date(day)
    return day.year * 12 + day.month - 1


def _shifted(number: Column, by: Column) -> Column:
    return F.call_function("shiftright", number, by)


def open_interval() -> dict[str, Column]:
    """The smallest dyadic block of months that holds a claim's whole time, by level and number.

    A block of level l has 2^l months and starts at a multiple of that. Any month lies in one
    block of each level, so that a claim that is open in a month is in one of a few blocks, and
    each level above the first holds only what was open across the middle of its blocks.
    """
    first, last = month_number(F.least(*_DATES)), month_number(F.greatest(*_DATES))
    apart = first.bitwiseXOR(last)
    level = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
    level = F.when(apart.isNotNull(), level).cast("int")
    return {OPEN_LEVEL: level, OPEN_BLOCK: _shifted(first, level)}


def _part_of(column: str) -> str:
    """The partition column of a table by column."""
    return f"{column}_part"


def _partitions(layout: str) -> dict[str, Column]:
    if layout.startswith(_BY_COLUMN):
        column = layout.removeprefix(_BY_COLUMN)
        return {_part_of(column): F.col(column)}
    if layout == "decided_month":
        return {DECIDED_MONTH: F.trunc(_DECIDED, "month"),
                CLOSED_MONTH: F.trunc(F.greatest(*_DATES), "month")}
    return open_interval() if layout else {}


def _write(df: DataFrame, folder: str, layout: str) -> None:
    """Each task writes what it has of each partition, rows are not shuffled. A few partitions
    are files that the task writes at once, up to OPEN_FILES; a task that meets more sorts the rest
    by partition. Row groups are small, as one is held for each open file. A table by month has
    dozens of partitions: with a file open for each, almost every row goes to another one and
    writing takes several times as long, so that a task sorts its rows and writes file by file."""
    spark, parts = df.sparkSession, _partitions(layout)
    before = spark.conf.get(_OPEN_FILES, None)
    spark.conf.set(_OPEN_FILES, 0 if layout == "decided_month" else OPEN_FILES)
    try:
        writer = df.withColumns(parts).write.partitionBy(*parts)
        writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(_OPEN_FILES)
        else:
            spark.conf.set(_OPEN_FILES, before)


def _read_segments(spark: SparkSession, path: str, segments: list[str], schema: StructType,
                   layout: str) -> DataFrame:
    """Segments of a table, in one scan. To Spark they are partitions."""
    whole = StructType(schema.fields + _part_fields(layout, schema)
                       + [StructField(SEGMENT, StringType())])
    folder = path.rstrip("/")
    return spark.read.schema(whole).option("basePath", folder).parquet(
        *(f"{folder}/{segment}" for segment in segments))


def _read(spark: SparkSession, path: str, segments: list[str], schema: StructType,
          layout: str) -> DataFrame:
    return _read_segments(spark, path, segments, schema, layout).drop(SEGMENT)


# ---- writing and reading ----------------------------------------------------------------


def _layout(by_decided_month: bool, by_open_interval: bool, by_column: str | None,
            schema: StructType) -> str:
    if bool(by_decided_month) + bool(by_open_interval) + bool(by_column) > 1:
        raise ValueError("a table has one layout")
    if by_column and not isinstance(schema[by_column].dataType, IntegralType):
        raise ValueError(f"{by_column} does not hold whole numbers")
    return ("decided_month" if by_decided_month else
            "open_interval" if by_open_interval else
            f"{_BY_COLUMN}{by_column}" if by_column else "")


def write_stage(df: DataFrame, path: str, schema: StructType,
                key: str | Sequence[str] | None = None,
                by_decided_month: bool = False, by_open_interval: bool = False,
                by_column: str | None = None) -> None:
    """Replace the stage table at ``path``.

    Rows go to a new folder; a pointer, created last, makes it the table. With a key, which is
    one column or several, what is stored of it is read back first, and duplicates are refused; what is known of the
    keys is kept beside the data for ``append_stage``. A refused, failed or stopped write
    leaves the old table as it was, and a table may replace itself.

    By decided month, partitions are months of the decision and, below, of the last date of a
    claim. By open interval, they are dyadic blocks of months (``open_interval``): a question
    about a day, however long ago, reads one block a level. By column, which holds few whole numbers,
    they are its values (``has_value``).
    """
    spark, layout = df.sparkSession, _layout(by_decided_month, by_open_interval, by_column, schema)
    base = current(spark, path)
    fresh, digest = new_folder(path, f"{SEGMENT}="), new_folder(path, "keys-")
    try:
        _write(conform(df, schema), fresh, layout)
        if key:
            stored = _read(spark, path, [_name(fresh)], schema, layout)
            require_unique(stored.select(*columns_of(key)), *columns_of(key))
            write_digest(stored, key, _part_names(layout), digest)
        publish(spark, path, base, layout,
                (Segment(_name(fresh), _name(digest) if key else None),))
    except BaseException:
        delete(spark, fresh)
        delete(spark, digest)
        raise


def append_stage(df: DataFrame, path: str, schema: StructType,
                 key: str | Sequence[str]) -> None:
    """Add a batch of new rows to the stage table at ``path``, or refuse all of it.

    Columns are aligned by name; nullable ones that the batch lacks are null, and ones that the
    schema lacks are an error. A key that is null, repeats in the batch or is stored already
    refuses the batch. Stored keys are looked up by the digests of the segments before: only
    partitions whose filter may hold a new key are read, and of those the key columns alone.
    """
    spark = df.sparkSession
    base = current(spark, path)
    if not base.segments:
        raise ValueError(f"no table at {path} to append to")
    if any(segment.digest is None for segment in base.segments):
        raise ValueError(f"{path} was written without a key")
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    require_columns(df, [f.name for f in schema if not f.nullable or f.name in columns_of(key)])
    absent = [f for f in schema if f.name not in df.columns]
    aligned = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
    fresh, digest = new_folder(path, f"{SEGMENT}="), new_folder(path, "keys-")
    try:
        _write(conform(aligned, schema), fresh, base.layout)
        batch = _read(spark, path, [_name(fresh)], schema, base.layout)
        keys = batch.select(*columns_of(key))
        _require_keys(keys, key)
        write_digest(batch, key, _part_names(base.layout), digest)
        _require_new(spark, keys, key, path, schema, base.layout, base.segments)
        publish(spark, path, base, base.layout,
                (*base.segments, Segment(_name(fresh), _name(digest))))
    except BaseException:
        delete(spark, fresh)
        delete(spark, digest)
        raise


def _require_keys(keys: DataFrame, key: str | Sequence[str]) -> None:
    """No key is null or repeats, in one pass."""
    names = columns_of(key)
    counted = keys.groupBy(*names).agg(F.count("*").alias("count"))
    found = counted.where((F.col("count") > 1) | ~without_null(key)).head(1)
    if found and any(found[0][name] is None for name in names):
        raise ValueError(f"the key {', '.join(names)} must not be null")
    if found:
        raise ValueError(f"duplicate key {', '.join(names)}, for example {found[0].asDict()}")


def _require_new(spark: SparkSession, keys: DataFrame, key: str | Sequence[str], path: str,
                 schema: StructType, layout: str, segments: tuple[Segment, ...]) -> None:
    digests = {s.data: f"{path.rstrip('/')}/{s.digest}" for s in segments}
    names = _part_names(layout)
    found = colliding_parts(spark, keys, key, digests, names)
    if not found:
        return
    stored = _read_segments(spark, path, list(found), schema, layout)
    where = F.lit(False)
    for data, parts in found.items():
        within = F.lit(not names)
        for part in parts:
            here = F.lit(True)
            for name, value in zip(names, part):
                kind = stored.schema[name].dataType
                here = here & F.col(name).eqNullSafe(F.lit(value).cast(kind))
            within = within | here
        where = where | ((F.col(SEGMENT) == data.removeprefix(f"{SEGMENT}=")) & within)
    columns = columns_of(key)
    again = stored.where(where).select(*columns).join(keys, columns, "left_semi").head(1)
    if again:
        raise ValueError(f"duplicate key {', '.join(columns)}, for example {again[0].asDict()}")


def _part_names(layout: str) -> list[str]:
    column = layout.removeprefix(_BY_COLUMN)
    return [part.name for part in LAYOUTS[layout]] if column == layout else [_part_of(column)]


def _part_fields(layout: str, schema: StructType) -> list[StructField]:
    column = layout.removeprefix(_BY_COLUMN)
    return (LAYOUTS[layout] if column == layout else
            [StructField(_part_of(column), schema[column].dataType)])


def _name(folder: str) -> str:
    return folder.rsplit("/", 1)[1]


def read_stage(spark: SparkSession, path: str, schema: StructType,
               order_by: str | None = None) -> DataFrame:
    """The stage table as it is now, in key order if asked for.

    Later changes of the table don't touch what was read. Columns of the layout stay for pruning.
    """
    version = current(spark, path)
    if not version.number:
        raise ValueError(f"no table at {path}")
    stage = _read(spark, path, [s.data for s in version.segments], schema, version.layout)
    return stage.orderBy(order_by) if order_by else stage


# ---- conditions that prune --------------------------------------------------------------


def _from_month(df: DataFrame, column: str, day: DateLike) -> Column:
    """Prunes partitions on a table by month or by open interval, else holds for all."""
    if OPEN_BLOCK in df.columns:
        return F.col(OPEN_BLOCK) >= _shifted(F.lit(_month_of(day)), F.col(OPEN_LEVEL))
    if column not in df.columns:
        return F.lit(True)
    return F.col(column) >= F.lit(as_date(day).replace(day=1))


def has_value(df: DataFrame, column: str, value: int) -> Column:
    """Holds where the column has the value; prunes partitions on a table by that column."""
    part, same = _part_of(column), F.col(column) == value
    return (F.col(part) == value) & same if part in df.columns else same


def decided_from(df: DataFrame, day: DateLike) -> Column:
    """Holds for every claim with a decision date on or after the day."""
    return _from_month(df, DECIDED_MONTH, day)


def closed_from(df: DataFrame, day: DateLike) -> Column:
    """Holds for every claim with any date on or after the day."""
    return _from_month(df, CLOSED_MONTH, day)


def open_on(df: DataFrame, day: DateLike) -> Column:
    """Holds for every claim with a date on or before the day and one on or after it."""
    if OPEN_BLOCK in df.columns:
        return F.col(OPEN_BLOCK) == _shifted(F.lit(_month_of(day)), F.col(OPEN_LEVEL))
    return closed_from(df, day)


def dated_between(df: DataFrame, start: DateLike, end: DateLike) -> Column:
    """Holds for every claim with any date in the closed range."""
    if OPEN_BLOCK in df.columns:
        level = F.col(OPEN_LEVEL)
        return F.col(OPEN_BLOCK).between(_shifted(F.lit(_month_of(start)), level),
                                         _shifted(F.lit(_month_of(end)), level))
    return closed_from(df, start)


def decided_between(df: DataFrame, start: DateLike, end: DateLike) -> Column:
    """Closed range of the decision date; it also prunes partitions of a table that has them."""
    start, end = as_date(start), as_date(end)
    in_period = F.col(_DECIDED).between(F.lit(start), F.lit(end))
    if OPEN_BLOCK in df.columns:
        return in_period & dated_between(df, start, end)
    if DECIDED_MONTH in df.columns:
        months = F.col(DECIDED_MONTH).between(F.lit(start.replace(day=1)), F.lit(end))
        return months & in_period
    return in_period
