"""Strict readers and deterministic writers of keyed CSV and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with exactly this header and no ragged or unparsable rows (they raise when read)."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def with_week(df: DataFrame, pattern: str = r"_w(\d+)\.csv$") -> DataFrame:
    """Adds the file name and the week in it."""
    name = F.col("_metadata.file_name")
    return df.select("*", name.alias("file"), F.regexp_extract(name, pattern, 1).alias("week"))


def unpaired_weeks(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Weeks that only one side has."""
    a = inputs.select("week").distinct().withColumn("in_inputs", F.lit(True))
    b = outputs.select("week").distinct().withColumn("in_outputs", F.lit(True))
    return a.join(b, "week", "full_outer").where("in_inputs IS NULL OR in_outputs IS NULL").select("week")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One sorted file with a header, for results that are small enough to be read by people."""
    df.select(*columns).orderBy(*order).coalesce(1).write.csv(path, header=True, mode="errorifexists", lineSep="\n")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def report_json(df: DataFrame, order: list[str]) -> str:
    """Rows of a small aggregate as sorted JSON; NaN and infinities raise."""
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    return json.dumps(rows, sort_keys=True, allow_nan=False, indent=1)


def embedded_json(spark: SparkSession, path: str, variable: str, schema: str) -> DataFrame:
    """The rows of a JSON array, or the one row of an object, that a script assigns to a variable.

    The value stands as such, or as a string literal that JSON.parse reads: then it is decoded twice.
    """
    text = spark.read.text(path, wholetext=True)
    plain = F.regexp_extract("value", rf"(?s)\b{variable}\s*=\s*([\[{{].*?[\]}}])\s*;", 1)
    quoted = F.regexp_extract("value", rf'(?s)\b{variable}\s*=\s*JSON\.parse\(\s*(".*?[\]}}]")\s*\)', 1)
    body = F.when(quoted != "", F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")).otherwise(plain)
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return text.select(F.explode(F.from_json(listed, f"array<{schema}>")).alias("r")).select("r.*")
