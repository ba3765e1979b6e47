"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are worked through in slices of about so many bytes, so that a batch of very long
#: texts does not ask for several times its size at once.
SLICE_BYTES = 4 << 20

#: Name that carries a text, as bytes, into a task.
TEXT = "__text_bytes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="claimspan-")
    return f"{folder}/claimspan/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: While `stored_lean` writes: shuffle files go when the write ends, and batches of long texts
#: stay small on both sides of Arrow.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored_lean(df: DataFrame, name: str) -> DataFrame:
    """Like `stored`, with little disk and small batches: compressed more, and without keeping
    what was shuffled for it."""
    path = shared_path(df.sparkSession, name)
    with settings(df.sparkSession, LEAN):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `stored`, in buckets of a column, one for each shuffle partition: joins by it then
    read the buckets as they lie and move the other side alone. The data lie in the shared
    folder; the catalog knows them only while they are opened."""
    spark = df.sparkSession
    entry = f"claimspan_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").bucketBy(buckets, key)
     .option("path", shared_path(spark, name)).saveAsTable(entry))
    found = spark.table(entry).select(*[F.col(f"`{column}`") for column in df.columns])
    spark.sql(f"DROP TABLE {entry}")
    return found


def give_back() -> None:
    """What a task has freed goes back to the system; else its Python worker, which waits for
    further tasks, keeps the most that any task held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = TEXT,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text; a longer text is one run."""
    begin, held = 0, 0
    for row, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (length or 0) > size:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += length or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def with_columns(df: DataFrame, text: str, fields: Sequence[T.StructField],
                 work: Callable[..., list[pa.Array]], beside: str | None = None,
                 size: int = SLICE_BYTES) -> DataFrame:
    """df and the columns that `work` makes of a list of texts (UTF-8), in Arrow batches.

    An input column with the name of a new one is replaced. Other columns pass untouched. If
    one is named by `beside`, `work` gets the list of its values before the texts.
    """
    new = {field.name for field in fields}
    kept = [field for field in df.schema.fields if field.name not in new]
    schema = T.StructType(kept + list(fields))
    at = None if beside is None else [field.name for field in kept].index(beside)
    source = df.select(*[F.col(f"`{field.name}`") for field in kept],
                       F.col(text).cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=size):
                given = [] if at is None else [part.column(at).to_pylist()]
                made = work(*given, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *made], names=schema.names)
                del made
        give_back()

    return source.mapInArrow(run, schema)
