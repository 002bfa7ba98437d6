"""Reading base tables and naming them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """A CSV table. With a schema the file is read once; without one Spark
    makes an extra pass to infer the types."""
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Make the tables available to SQL text under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A small table from driver rows; the schema makes an empty list legal."""
    return spark.createDataFrame(rows, schema)
