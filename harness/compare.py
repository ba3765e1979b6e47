"""Run registered queries and their SQL twins side by side and compare the results."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal_types(table: pa.Table) -> pa.Table:
    """Columns by name; string variants as one type."""
    table = table.select(sorted(table.column_names))
    plain = [pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type)
             for f in table.schema]
    return table.cast(pa.schema(plain))


def difference(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns, types and rows, in any order."""
    ours = normal_types(result.toArrow())
    theirs = normal_types(connection.sql(sql).to_arrow_table())
    if ours.schema.names != theirs.schema.names or ours.schema.types != theirs.schema.types:
        return f"schema {ours.schema.to_string()} / {theirs.schema.to_string()}"
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} / {theirs.num_rows}"
    extra = connection.execute(
        "(FROM ours EXCEPT ALL FROM theirs) UNION ALL (FROM theirs EXCEPT ALL FROM ours) LIMIT 4"
    ).fetchall()
    return f"values {extra}" if extra else ""


def main() -> None:
    from pyspark.sql import SparkSession

    from harness.oracle import ORACLE
    from harness.registry import QUERIES

    sf_dir, *keys = sys.argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for key in keys or QUERIES:
        begin = time.time()
        try:
            found = difference(QUERIES[key](spark, sf_dir), connection, ORACLE[key])
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__} {str(error)[:600]}"
        print(f"{'ok  ' if not found else 'DIFF'} {key} {time.time() - begin:.1f}s {found}",
              flush=True)


if __name__ == "__main__":
    main()
