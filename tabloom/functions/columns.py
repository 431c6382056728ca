"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    """Column by exact name; generated names may hold dots, dashes and slashes."""
    return F.col(quoted(name))


def fresh_names(wanted: list[str], taken: Iterable[str]) -> list[str]:
    """The wanted names, numbered where Spark, which ignores case, would take one for another."""
    used = {name.lower() for name in taken}
    out = []
    for name in wanted:
        fresh, n = name, 1
        while fresh.lower() in used:
            n += 1
            fresh = f"{name}~{n}"
        used.add(fresh.lower())
        out.append(fresh)
    return out


def kinds(df: DataFrame, skip: Iterable[str] = ()) -> dict[str, str]:
    """Map each column to numeric / text / boolean / time; any other type is refused."""
    out: dict[str, str] = {}
    for field in df.schema.fields:
        if field.name in skip:
            continue
        if isinstance(field.dataType, NUMERIC_TYPES):
            out[field.name] = "numeric"
        elif isinstance(field.dataType, TEXT_TYPES):
            out[field.name] = "text"
        elif isinstance(field.dataType, T.BooleanType):
            out[field.name] = "boolean"
        elif isinstance(field.dataType, TIME_TYPES):
            out[field.name] = "time"
        else:
            raise TypeError(
                f"column {field.name!r} has unsupported type {field.dataType.simpleString()}"
            )
    return out


def of_kind(df: DataFrame, *wanted: str, skip: Iterable[str] = ()) -> list[str]:
    return [c for c, k in kinds(df, skip).items() if k in wanted]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or append several columns in a single projection."""
    kept = [new[c].alias(c) if c in new else q(c) for c in df.columns]
    added = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def per_column(
    df: DataFrame, columns: list[str], stats: dict[str, Callable[[str], Column]]
) -> DataFrame:
    """All statistics of all columns in ONE aggregate, returned as one row per column."""
    cells = [
        make(c).alias(f"{stat}_{i}") for i, c in enumerate(columns) for stat, make in stats.items()
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), *[F.col(f"{stat}_{i}").alias(stat) for stat in stats]
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., column, value): one row per cell of the text columns."""
    return df.select(*[q(c) for c in keep], *[q(c).cast("string").alias(c) for c in columns]).unpivot(
        [q(c) for c in keep], [q(c) for c in columns], "column", "value"
    )
