"""First balanced JSON object of a text, which regular expressions cannot find."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The JSON object that begins at the first brace of a text, if it is a valid one; else null."""
    start = -1 if text is None else text.find("{")
    if start < 0:
        return None
    try:
        return text[start : json.JSONDecoder().raw_decode(text, start)[1]]
    except ValueError:
        return None


def extract_json(column) -> Column:
    """``first_object`` of a column, in Arrow batches."""

    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return F.pandas_udf(scan, "string")(column)
