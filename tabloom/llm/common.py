"""Shared pieces of the training-data operators: words, safe joins, running totals, shared files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: Column) -> Column:
    """The text, a null counting as the empty one."""
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def join_small(left: DataFrame, right: DataFrame, key: str, how: str = "left", limit: int = 50_000, salts: int = 32) -> DataFrame:
    """Join a per-key table of few rows to a large one whose keys may be hot.

    The row count of `right` is checked: up to `limit` rows it is broadcast, beyond that both
    sides are salted, so a key with a third of the rows is still spread over `salts` tasks.
    Nulls of `key` equal each other.
    """
    match = left[key].eqNullSafe(right[key])
    if right.count() <= limit:
        return left.join(F.broadcast(right), match, how).drop(right[key])
    salt = F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_salt_r")
    wide = right.select("*", salt)
    salted = left.withColumn("_salt_l", (F.rand(7) * salts).cast("int"))
    match = salted[key].eqNullSafe(wide[key]) & (F.col("_salt_l") == F.col("_salt_r"))
    return salted.join(wide, match, how).drop(wide[key]).drop("_salt_l", "_salt_r")


def running_start(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of `value` inside `group`, in the order (bucket, *order).

    Two levels: totals of the buckets are summed first, so no group is sorted in one task.
    `group` and `bucket` must not hold nulls.
    """
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    before = sums.select(group, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        local.join(before, [group, bucket])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_before", "_local")
    )


#: Later steps read the written table alone, so the shuffle files that led to it go as soon as it stands.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run in the shared folder; each is dropped once it is no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
        path = new_path(self.spark, name)
        before = self.spark.conf.get(FILE_CLEANUP, None)
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FILE_CLEANUP)
            else:
                self.spark.conf.set(FILE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.paths.pop(id(table), "")
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for binary files, as a URI."""
    path = new_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def file_system(uri: str):
    """The file system of a URI and the path in it; runs in tasks, where no JVM is at hand."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other task attempt uses; the manifest lists those of finished attempts."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{prefix}-{part:06d}-{uuid.uuid4().hex}{suffix}"


#: Keys with at least this share of the rows are joined by broadcast; there are at most 1 / HOT of them.
HOT = 0.001


def join_repeated(left: DataFrame, right: DataFrame, key: str, rows: str, own: Column, total: int | None = None) -> DataFrame:
    """Left join of a large table to one row per key, where a few keys may hold most of `left`.

    `right` states in `rows` how many rows of `left` have its key. Keys with a share of HOT or
    more are few by arithmetic and are broadcast; their rows then get a key of their own (made
    from `own`), so the shuffled join of the rest never sees a hot key. Should such a key equal
    a real one, the broadcast row still counts. Keys are binary or long; `total` is the number of rows if known.
    """
    if total is None:
        total = right.agg(F.sum(rows)).first()[0] or 0
    kept = [c for c in right.columns if c not in (key, rows)]
    hot = right.where(F.col(rows) >= HOT * total).select(key, F.struct(*kept).alias("_hot"))
    cold = right.where(F.col(rows) < HOT * total).select(F.col(key).alias("_key"), F.struct(*kept).alias("_cold"))
    spread = F.xxhash64(F.lit(1), own)
    if left.schema[key].dataType.typeName() == "binary":
        spread = spread.cast("string").cast("binary")
    found = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_key", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col(key)))
        .join(cold, "_key", "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
    )
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in kept])
