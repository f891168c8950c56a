"""Score requests: reading and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscore import schemas

FIELDS = ("student_id", "goal", "resume_text")

# The messages of a rejected request.
MISSING = "Field required"
NOT_A_STRING = "Input should be a valid string"
NOT_JSON = "JSON decode error"


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Requests that are already typed; a missing field is NULL. JSON lines are parsed as request bodies."""
    if fmt == "json":
        return read_request_bodies(spark, path)
    return spark.read.schema(schemas.REQUEST).format(fmt).load(path)


def read_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON request bodies, one per line, with their validation errors."""
    return parse_bodies(spark.read.text(path))


def parse_bodies(bodies: DataFrame, column: str = "value") -> DataFrame:
    """JSON bodies to typed requests plus ``details``, one entry per field that is unusable."""
    parsed = bodies.select(F.try_parse_json(F.col(column)).alias("_body"))
    fields = parsed.select(
        "_body", *[F.try_variant_get("_body", f"$.{field}", "variant").alias(field) for field in FIELDS]
    )
    errors = [F.when(F.col("_body").isNull(), F.lit(f"body: {NOT_JSON}"))]
    for field in FIELDS:
        missing = F.col("_body").isNotNull() & F.col(field).isNull()
        errors.append(
            F.when(missing, F.lit(f"body.{field}: {MISSING}"))
            .when(~_is_string(field), F.lit(f"body.{field}: {NOT_A_STRING}"))
        )
    values = [F.when(_is_string(f), F.try_variant_get(f, "$", "string")).alias(f) for f in FIELDS]
    return fields.select(*values, F.array_compact(F.array(*errors)).alias("details"))


def _is_string(field: str) -> Column:
    return F.schema_of_variant(F.col(field)) == "STRING"


def check_fields(requests: DataFrame) -> DataFrame:
    """Add ``details`` to typed requests: one ``field: message`` entry per missing field.

    Parsed bodies have them already.
    """
    if "details" in requests.columns:
        return requests
    missing = [F.when(F.col(f).isNull(), F.lit(f"body.{f}: {MISSING}")) for f in FIELDS]
    return requests.withColumn("details", F.array_compact(F.array(*missing)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("details") == 0).drop("details")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("details") > 0)


def usable(requests: DataFrame) -> DataFrame:
    """The accepted requests; without ``details`` the condition reaches the file scan."""
    if "details" in requests.columns:
        return accepted(requests)
    return requests.filter(
        F.col("student_id").isNotNull() & F.col("goal").isNotNull() & F.col("resume_text").isNotNull()
    )
