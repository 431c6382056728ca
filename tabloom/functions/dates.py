"""Text dates: the accepted formats and the calendar parts taken from a timestamp."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed values: tried in this order, the best-parsing one wins
DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy-M-d H:m",
    "yyyy-M-d H:m:s[.SSSSSS][.SSS]",
    "yyyy-M-d'T'H:m[:s][.SSSSSS][.SSS][XXX]",
    "yyyy-M-d H:m:s[.SSSSSS][.SSS][ ]XXX",
    "yyyy/M/d",
    "yyyy/M/d H:m[:s]",
    "M/d/yyyy",
    "M/d/yyyy H:m[:s]",
    "d/M/yyyy",
    "d/M/yyyy H:m[:s]",
    "M-d-yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d.M.yyyy H:m[:s]",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "M/d/yy",
    "M/d/yy H:m[:s]",
    "d/M/yy",
    "M/d/yyyy h:m[:s] a",
    "yyyy-M-d h:m[:s] a",
    "d MMMM yyyy",
    "MMMM d, yyyy",
    "MMMM d yyyy",
]
DATE_PARTS = ["Year", "Month", "Day", "DayOfWeek", "Is_Weekend"]


# fixed values: what each pattern letter run may look like in text
_SHAPES = {
    "yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]{3,9}", "h": "[0-9]{1,2}", "a": "[AaPp][Mm]", "MMM": "[A-Za-z]{3}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "H": "[0-9]{1,2}",
    "m": "[0-9]{1,2}", "s": "[0-9]{1,2}", "SSSSSS": "[0-9]{6}", "SSS": "[0-9]{3}", "XXX": "[Z0-9:+-]{1,6}",
}


def shape(fmt: str) -> str:
    """Regular expression that every text in this format matches; far cheaper than parsing."""
    out = ""
    for token in re.finditer(r"([A-Za-z])\1*|.", fmt.replace("'T'", "@")):
        text = token.group(0)
        if text in _SHAPES:
            out += _SHAPES[text]
        elif text in "[]":
            out += "(" if text == "[" else ")?"
        else:
            out += "T" if text == "@" else re.escape(text)
    return f"^{out}$"


ANY_SHAPE = "|".join(sorted({shape(fmt) for fmt in DATE_FORMATS}))


def parsed(text: Column, fmt: str) -> Column:
    """The timestamp, or NULL; texts of another shape never reach the parser."""
    return F.when(text.rlike(shape(fmt)), F.try_to_timestamp(text, F.lit(fmt)))


def date_parts(moment: Column) -> dict[str, Column]:
    """Year, month, day, day of week with Monday = 0, and a weekend flag (0 for null dates)."""
    weekday = F.weekday(moment)
    return {
        "Year": F.year(moment),
        "Month": F.month(moment),
        "Day": F.dayofmonth(moment),
        "DayOfWeek": weekday,
        "Is_Weekend": F.coalesce((weekday >= 5).cast("int"), F.lit(0)),
    }
