"""A1-A3: table scans and the small fixed reference tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def load(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan one Parquet table.  With a schema, no inference and no footer merge."""
    path = os.path.join(directory, f"{name}.parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def seed_regions(spark: SparkSession) -> DataFrame:
    """Region code -> name of the home country (13 fixed rows; safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(schemas.HOME_REGIONS, schemas.REGIONS))


def seed_categories(spark: SparkSession) -> DataFrame:
    """Achievement categories (9 fixed rows; safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(schemas.ACHIEVEMENT_CATEGORIES, schemas.CATEGORIES))
