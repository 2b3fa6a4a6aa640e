"""Reading and writing with explicit schemas and calendar handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, legacy_calendar: bool = False) -> DataFrame:
    """A Parquet table; with a schema only its columns are read (names match as the session's
    spark.sql.caseSensitive says); ``legacy_calendar`` rebases old dates from the hybrid calendar."""
    reader = spark.read.option("datetimeRebaseMode", "LEGACY" if legacy_calendar else "CORRECTED")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows of path, modificationTime, length and content."""
    return spark.read.format("binaryFile").load(path)


def flatten_schema(schema: T.DataType, name: str = "") -> list[tuple[str, str]]:
    """(path, type) of every node of a type, depth first."""
    out = [(name, schema.typeName())] if name else []
    join = lambda child: f"{name}.{child}" if name else child
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            out += flatten_schema(f.dataType, join(f.name))
    elif isinstance(schema, T.ArrayType):
        out += flatten_schema(schema.elementType, join("element"))
    elif isinstance(schema, T.MapType):
        out += flatten_schema(schema.keyType, join("key")) + flatten_schema(schema.valueType, join("value"))
    return out


def read_format(spark: SparkSession, path: str, kind: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """A table of csv, json, orc, text or another format that Spark reads, with a schema given so that no pass infers one."""
    return spark.read.format(kind).schema(schema).options(**options).load(path)


def write_format(df: DataFrame, path: str, kind: str, by: tuple[str, ...] = (), **options: str) -> None:
    """Writes a table, in folders by the values of ``by``; rows with equal values are brought together first, so
    each folder gets few files (AQE splits the large ones)."""
    dealt = df.hint("rebalance", *by) if by else df
    dealt.write.format(kind).options(**options).partitionBy(*by).save(path)
