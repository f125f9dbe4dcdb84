"""Fixed-width records: a layout names the columns of a line, 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, first, end, kind); kind is string, int, long or double.
Layout = list[tuple[str, int, int, str]]


def field(line: Column, first: int, end: int) -> Column:
    """The text of a field; empty where the line is too short to hold all of it."""
    return F.when(F.length(line) >= end, F.substring(line, first + 1, end - first)).otherwise("")


def char_at(line: Column, index: int) -> Column:
    """One character, null if it is blank or beyond the line."""
    c = F.substring(line, index + 1, 1)
    return F.when(F.trim(c) != "", c)


def parsed(line: Column, first: int, end: int, kind: str) -> Column:
    """A field as a value; null where it does not parse."""
    text = F.trim(field(line, first, end))
    return text if kind == "string" else text.try_cast(kind)


def read_records(lines: DataFrame, layout: Layout, column: str = "line") -> DataFrame:
    """All columns of `lines` but `column`, with one column a field."""
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, *[parsed(F.col(column), a, b, k).alias(n) for n, a, b, k in layout])


def write_records(df: DataFrame, layout: Layout, column: str = "line", decimals: int = 3) -> DataFrame:
    """Columns of `df` that the layout does not name, with `column`: strings to the left, numbers to the right."""
    width = max(b for _, _, b, _ in layout)
    parts, at = [], 0
    for name, first, end, kind in sorted(layout, key=lambda f: f[1]):
        size = end - first
        text = F.format_string(f"%{size}.{decimals}f", F.col(name)) if kind == "double" else F.col(name).cast("string")
        text = F.rpad(text, size, " ") if kind == "string" else F.lpad(text, size, " ")
        parts += [F.lit(" " * (first - at)), F.coalesce(text, F.lit(" " * size))]
        at = end
    rest = [c for c in df.columns if c not in {n for n, *_ in layout}]
    return df.select(*rest, F.rpad(F.concat(*parts), width, " ").alias(column))
