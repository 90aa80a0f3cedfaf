"""Texts of pages and payloads: entities, tags, spaces and normal forms of titles."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """The text with its entities replaced."""
    return _unescape(text)


def clean_text(text: Column) -> Column:
    """Entities replaced, spaces collapsed; null is empty."""
    return F.trim(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(clean_text(text), "<[^>]+>", " ")), r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Lower case; what is no letter, digit or one of ``+#./-`` becomes a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w+#./-]+", " "), r"\s+", " "))
