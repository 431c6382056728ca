"""Reading and writing tables, input guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import q, replace_columns


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: floating NaN becomes NULL on ingest."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return replace_columns(df, {c: F.nanvl(q(c), F.lit(None)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Pass a schema on large inputs: inferring types costs a full extra scan."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def input_facts(df: DataFrame, target: str, test_size: float = 0.2) -> DataFrame:
    """Row and target counts with the verdict of the input guards, in one aggregate."""
    rows, missing = F.col("n_rows"), F.col("n_target_null")
    needed = max(int(1 / test_size) + 1, 4)
    verdict = (
        F.when(rows < 2, "too_few_rows")
        .when(F.col("n_cols") < 2, "too_few_columns")
        .when(missing == rows, "target_all_null")
        .when(rows - missing < 2, "too_few_labelled_rows")
        .when(rows - missing < needed, "too_few_rows_to_split")
        .when(missing > rows * 0.5, "warn_target_mostly_null")
        .otherwise("ok")
    )
    return (
        df.agg(F.count("*").alias("n_rows"), F.count_if(q(target).isNull()).alias("n_target_null"))
        .withColumn("n_cols", F.lit(len(df.columns)).cast("long"))
        .withColumn("verdict", verdict)
    )


def validate_input(df: DataFrame, target: str, test_size: float = 0.2) -> str:
    """Raise on tables that cannot be prepared; return `ok` or a warning otherwise."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    verdict = input_facts(df, target, test_size).first()["verdict"]
    if verdict != "ok" and not verdict.startswith("warn"):
        raise ValueError(f"input table refused: {verdict}")
    return verdict
