"""Cleaning of tables: complete rows, do-not-know codes, column choice, renames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark.functions.columns import COLUMN_RULES


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in ``cols`` (default: any column)."""
    return df.dropna("any", subset=list(cols) if cols else None)


def any_answered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with at least one non-missing value among ``cols``."""
    return df.dropna("all", subset=list(cols))


def cols_like(df: DataFrame, *parts: str) -> list[str]:
    """Column names that contain one of ``parts``, in table order within each part."""
    found = [c for part in parts for c in df.columns if part in c]
    return list(dict.fromkeys(found))


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative 'do not know' codes become missing, in one projection."""
    chosen = set(cols)
    return df.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def rename_item_cols(df: DataFrame, rules: Sequence[tuple[str, str]] = COLUMN_RULES) -> DataFrame:
    """The ordered text replacements of item names, applied to the column names."""
    return df.toDF(*[reduce(lambda name, rule: name.replace(*rule), rules, c) for c in df.columns])
