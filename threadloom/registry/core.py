"""Registration of checked queries: a Spark callable and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.registry.adapters import Tables
from threadloom.session import apply_settings


@dataclass(frozen=True)
class Case:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"query {name} registered twice")
        CASES[name] = Case(build, sql)
        return build

    return register


def widen(name: str, columns: list[str]) -> None:
    """Lets the check SQL of a query return the given columns as 64-bit integers."""
    known = CASES[name]
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
    CASES[name] = Case(known.build, f"SELECT * REPLACE ({casts}) FROM ({known.sql})")


def _plain(field: T.StructField) -> Column:
    """Types two engines render alike: long, double to 6 places, string, boolean."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.IntegralType):
        col = col.cast("bigint")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        col = F.round(col.cast("double"), 6)
    elif isinstance(kind, T.DateType):
        col = F.date_format(col, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        col = F.array_join(col, ",")
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        col = F.to_json(col)
    return col.alias(field.name)


def plain(df: DataFrame) -> DataFrame:
    return df.select(*[_plain(f) for f in df.schema.fields])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return plain(CASES[name].build(Tables(spark, sf_dir)))
