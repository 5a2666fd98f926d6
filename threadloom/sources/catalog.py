"""Catalog entries for written tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from threadloom.contracts import catalog_type

PARTITIONS_AT_ONCE = 500


def _quote(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quote(name)}{place}")


def table_ddl(name: str, df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> str:
    fields = ", ".join(f"`{f.name}` {catalog_type(f.dataType)}" for f in df.schema.fields)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_cols)})" if partition_cols else ""
    return f"CREATE TABLE {_quote(name)} ({fields}) USING parquet{parts} LOCATION {_literal(path)}"


def register_table(
    spark: SparkSession, name: str, df: DataFrame, path: str, partition_cols: Sequence[str] = ()
) -> None:
    """Creates the external table, or brings its entry up to date; files stay untouched.

    An entry of the same columns, partitions and place stays as it is, with all that was set on it, and one that only lacks columns at the end gets
    them. Any other is dropped and created anew."""
    if spark.catalog.tableExists(name):
        added = _added_columns(spark, name, df, path, partition_cols)
        if added is None:
            spark.sql(f"DROP TABLE {_quote(name)}")
            spark.sql(table_ddl(name, df, path, partition_cols))
        elif added:
            spark.sql(f"ALTER TABLE {_quote(name)} ADD COLUMNS ({', '.join(added)})")
    else:
        spark.sql(table_ddl(name, df, path, partition_cols))
    if partition_cols:
        refresh_partitions(spark, name)


def _added_columns(spark: SparkSession, name: str, df: DataFrame, path: str, partition_cols: Sequence[str]) -> list[str] | None:
    """What the entry of a table lacks to be as wanted, or None if it cannot be made so in place."""
    known = [(c.name, c.dataType) for c in spark.catalog.listColumns(name) if not c.isPartition]
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {_quote(name)}").where("col_name = 'Location'").head()
    wanted = [(f.name, catalog_type(f.dataType)) for f in df.schema.fields if f.name not in partition_cols]
    same_place = place is not None and place["data_type"].split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")
    if parts != list(partition_cols) or not same_place or wanted[:len(known)] != known:
        return None
    return [f"`{n}` {kind}" for n, kind in wanted[len(known):]]


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Makes all partitions found in storage known to the catalog."""
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)


def _partition(values: Mapping[str, object]) -> str:
    return "PARTITION (" + ", ".join(f"`{k}` = {_literal(v)}" for k, v in values.items()) + ")"


def replace_partitions(
    spark: SparkSession, name: str, partitions: Sequence[Mapping[str, object]], chunk: int = PARTITIONS_AT_ONCE
) -> None:
    """Drops and adds the given partitions, so many in one statement."""
    for low in range(0, len(partitions), chunk):
        specs = [_partition(p) for p in partitions[low:low + chunk]]
        spark.sql(f"ALTER TABLE {_quote(name)} DROP IF EXISTS {', '.join(specs)}")
        spark.sql(f"ALTER TABLE {_quote(name)} ADD IF NOT EXISTS {' '.join(specs)}")
