"""Unicode operations that Spark has no expression for, as Arrow batches.  ASCII values never change."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfc(value: str | None) -> str | None:
    return value if value is None or value.isascii() else unicodedata.normalize("NFC", value)


def _fold(value: str | None) -> str | None:
    if value is None or value.isascii():
        return value
    parts = unicodedata.normalize("NFD", value.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in parts if not unicodedata.combining(c))


def _udf(function):
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return apply


def nfc(value: Column) -> Column:
    """Composed form (NFC)."""
    return _udf(_nfc)(value)


def fold(value: Column) -> Column:
    """Without diacritics; also for labels and codes only, since it merges words."""
    return _udf(_fold)(value)


def casefold(value: Column) -> Column:
    return _udf(lambda v: v.casefold() if v is not None else None)(value)
