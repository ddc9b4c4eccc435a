"""Text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.ids import _col


def compact(text, length: int | None = None) -> Column:
    """Runs of whitespace become one blank, edges are trimmed, then cut."""
    c = F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))
    return F.substring(c, 1, length) if length else c


def blank_to_null(text) -> Column:
    trimmed = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def literal_words(query: str) -> list[str]:
    """Blank-separated words; an all-blank query is taken as one literal."""
    return query.split() or ([query] if query else [])


def contains_literal(body, words) -> Column:
    """Every word occurs, case ignored; wildcard characters mean themselves."""
    lowered = F.lower(_col(body))
    condition = F.lit(True)
    for word in words:
        condition = condition & lowered.contains(word.lower())
    return condition


def http_url(text) -> Column:
    """The text itself when it is an http(s) address with a host."""
    c = _col(text)
    return F.when(c.rlike(r"^\s*(?i:https?)://[^/?#]+"), c)


def normal_form(text, form: str) -> Column:
    """Unicode normal form; Spark has no built-in, so an Arrow batch function."""

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.str.normalize(form)

    return apply(_col(text))
