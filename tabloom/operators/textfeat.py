"""Features out of text columns: date parts and delimiter splitting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import of_kind, per_column, q, replace_columns
from ..functions.dates import ANY_SHAPE, DATE_FORMATS, DATE_PARTS, date_parts, parsed

NUMERIC_TEXT_LIMIT = 0.5
DATE_LIMIT = 0.8
DELIMITERS = ["/", "-", "_", "|"]
CONSISTENT_LIMIT = 0.9


def _share(condition: Column) -> Column:
    """Share of ALL rows, nulls counting as failures."""
    return F.count_if(condition) / F.nullif(F.count("*").cast("double"), F.lit(0.0))


def _is_number(text: Column) -> Column:
    number = text.try_cast("double")
    return number.isNotNull() & ~F.isnan(number)


def text_kind_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, numeric_share, date_share, date_format, kind), two passes at most.

    `date_share` is NULL where too few rows have the shape of a date.
    """
    return df.sparkSession.createDataFrame(
        [(c, *facts) for c, facts in _text_kinds(df, columns).items()],
        "column string, numeric_share double, date_share double, date_format string, kind string",
    )


def _text_kinds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """One regular expression over all shapes decides which columns are worth parsing."""
    if not columns:
        return {}
    looks = {
        "numeric": lambda c: _share(_is_number(q(c))),
        "dateish": lambda c: _share(q(c).rlike(ANY_SHAPE)),
    }
    first = {r["column"]: r for r in per_column(df, columns, looks).collect()}
    tries = [
        (c, fmt)
        for c, r in first.items()
        if (r["numeric"] or 0) <= NUMERIC_TEXT_LIMIT and (r["dateish"] or 0) > DATE_LIMIT
        for fmt in DATE_FORMATS
    ]
    shares: dict[str, list[tuple[float, str]]] = {c: [] for c in columns}
    if tries:
        cells = [_share(parsed(q(c), f).isNotNull()).alias(f"s{i}") for i, (c, f) in enumerate(tries)]
        for (c, f), share in zip(tries, df.agg(*cells).first()):
            shares[c].append((share, f))
    out = {}
    for c in columns:
        numeric = first[c]["numeric"] or 0.0
        # the first of equally good formats wins
        share, fmt = max(shares[c], key=lambda s: s[0], default=(None, None))
        if numeric > NUMERIC_TEXT_LIMIT:
            kind = "numeric_text"
        elif share is not None and share > DATE_LIMIT:
            kind = "date"
        else:
            kind, fmt = "text", None
        out[c] = (numeric, share, fmt, kind)
    return out


def delimiter_count(text: Column, delimiter: str) -> Column:
    """Literal occurrences."""
    return F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))


def delimiter_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, delimiter, k, share, k_max, accepted): first consistent delimiter per column.

    Pass one takes the most common count per delimiter (ties to the smallest), pass two its share
    of non-null values; both are plain aggregates over the unexpanded rows.
    """
    rows = _delimiters(df, columns)
    return df.sparkSession.createDataFrame(
        rows, "column string, delimiter string, k long, share double, k_max long, accepted boolean"
    )


def _delimiters(df: DataFrame, columns: list[str]) -> list[tuple]:
    if not columns:
        return []
    pairs = [(c, d) for c in columns for d in DELIMITERS]
    first = df.agg(
        *[
            e
            for i, (c, d) in enumerate(pairs)
            for e in (
                F.mode(delimiter_count(q(c), d), True).alias(f"k_{i}"),
                F.max(delimiter_count(q(c), d)).alias(f"max_{i}"),
            )
        ]
    ).first()
    modes = {p: first[f"k_{i}"] for i, p in enumerate(pairs)}
    longest = {p: first[f"max_{i}"] for i, p in enumerate(pairs)}
    second = df.agg(
        *[
            (
                F.count_if(delimiter_count(q(c), d) == F.lit(modes[c, d]))
                / F.nullif(F.count(q(c)).cast("double"), F.lit(0.0))
            ).alias(f"s_{i}")
            for i, (c, d) in enumerate(pairs)
        ]
    ).first()
    shares = {p: second[i] for i, p in enumerate(pairs)}
    rows = []
    for c in columns:
        taken = False
        for d in DELIMITERS:
            k, share = modes[c, d], shares[c, d]
            accepted = not taken and bool(k) and share > CONSISTENT_LIMIT
            taken = taken or accepted
            rows.append((c, d, k, share, longest[c, d], accepted))
    return rows


def split_parts(column: str, delimiter: str, parts: int) -> dict[str, Column]:
    """{column}_part_1..n; short rows end in nulls, further parts are ignored."""
    pieces = F.split(q(column), "\\Q" + delimiter + "\\E")
    return {f"{column}_part_{i + 1}": F.try_element_at(pieces, F.lit(i + 1)) for i in range(parts)}


@dataclass
class TextFeatures:
    """Fitted on training rows: which columns are dates (and how written), which are split."""

    date_formats: dict[str, str] = field(default_factory=dict)
    time_columns: list[str] = field(default_factory=list)
    splits: dict[str, tuple[str, int]] = field(default_factory=dict)

    @property
    def consumed(self) -> list[str]:
        return [*self.date_formats, *self.time_columns, *self.splits]

    @property
    def part_columns(self) -> list[str]:
        """Text columns made by splitting."""
        return [f"{c}_part_{i + 1}" for c, (_, n) in self.splits.items() for i in range(n)]

    @property
    def date_columns(self) -> list[str]:
        """Numeric columns made out of dates."""
        return [f"{c}_{p}" for c in [*self.date_formats, *self.time_columns] for p in DATE_PARTS]

    def transform(self, df: DataFrame) -> DataFrame:
        new: dict[str, Column] = {}
        for c, fmt in self.date_formats.items():
            if c in df.columns:
                moment = parsed(q(c).cast("string"), fmt)
                new |= {f"{c}_{p}": e.cast("double") for p, e in date_parts(moment).items()}
        for c in self.time_columns:
            if c in df.columns:
                new |= {f"{c}_{p}": e.cast("double") for p, e in date_parts(q(c)).items()}
        for c, (delimiter, parts) in self.splits.items():
            if c in df.columns:
                new |= split_parts(c, delimiter, parts)
        return replace_columns(df, new).drop(*self.consumed)


def fit_text_features(train: DataFrame, skip: list[str]) -> TextFeatures:
    texts = of_kind(train, "text", skip=skip)
    kinds = _text_kinds(train, texts)
    state = TextFeatures(
        date_formats={c: k[2] for c, k in kinds.items() if k[3] == "date"},
        time_columns=of_kind(train, "time", skip=skip),
    )
    plain = [c for c, k in kinds.items() if k[3] == "text"]
    for c, d, k, _, k_max, accepted in _delimiters(train, plain):
        # the widest row must have exactly the common number of parts
        if accepted and k_max == k:
            state.splits[c] = (d, k + 1)
    return state
