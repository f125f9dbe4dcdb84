"""Problems of a structure are rows (sid, code, subject, message); strict calls raise the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MolframeError(Exception):
    """A problem that stops a build; `code` names its kind."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def violation(df: DataFrame, code: str, subject: Column, message: Column) -> DataFrame:
    return df.select("sid", F.lit(code).alias("code"), subject.cast("string").alias("subject"), message.alias("message"))


def require_none(violations: DataFrame) -> None:
    """Raise the first violation, in order of structure and text."""
    first = violations.orderBy("sid", "code", "message").limit(1).collect()
    if first:
        raise MolframeError(first[0].code, f"{first[0].sid}: {first[0].message}")
