"""Raw request bodies (visit, search, identity claims) as DataFrames.

Bodies arrive as JSON lines.  Readers take an explicit schema (no
inference); a batch reader and a streaming reader share it.  Fields missing
in a body are NULL; a line that cannot be read, or names another format
version, goes to quarantine with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

#: The version of the body format that a line names; lines of other versions are quarantined.
SCHEMA_VERSION = 1
_CORRUPT = "_corrupt"
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_json_bodies(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """JSON-lines files of request bodies, batch or streaming, with ``schema`` and no inference.

    A line that is no JSON object, or whose fields do not fit, keeps its text in ``_corrupt``.
    """
    wide = T.StructType([*schema.fields, T.StructField("schema_version", T.IntegerType()), T.StructField(_CORRUPT, T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(wide).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", _CORRUPT).option("timestampNTZFormat", TIMES).json(path)


def read_visit_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A4."""
    return read_json_bodies(spark, path, schemas.VISIT_EVENT, stream)


def read_search_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A5."""
    return read_json_bodies(spark, path, schemas.SEARCH_EVENT, stream)


def split_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events as intake takes them, quarantined lines with the reason and their text)."""
    reason = (F.when(F.col(_CORRUPT).isNotNull(), F.lit("unreadable body"))
              .when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), F.lit("unsupported schema version"))
              .when(F.col("event_id").isNull() | F.col("received_at").isNull(), F.lit("no event id or time")))
    tagged = bodies.withColumn("reason", reason)
    good = tagged.filter("reason is null").drop("reason", "schema_version", _CORRUPT)
    bad = tagged.filter("reason is not null").select("event_id", "received_at", "reason", F.col(_CORRUPT).alias("body"))
    return good, bad


def parse_flat(df: DataFrame, json_col: str, fields: list[str]) -> DataFrame:
    """Parse flat string fields of a JSON text column in one pass per row.

    ``json_tuple`` is a generator: every field comes out of one parse, and
    later filters on the fields stay above it.  (With ``from_json`` +
    field access, predicate pushdown copies the parse into the filter once
    per referenced field.)
    """
    keep = [c for c in df.columns if c != json_col]
    return df.select(*keep, F.json_tuple(F.col(json_col), *fields).alias(*fields))


def read_claims(df: DataFrame, json_col: str = "claim_json") -> DataFrame:
    """Identity-claim JSON -> aud, iss, email, email_verified, name, picture, sub (all text)."""
    return parse_flat(df, json_col, schemas.CLAIMS.fieldNames())
