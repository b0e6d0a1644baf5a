"""Table and column names: tokens and likeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name, cut at other characters than letters and digits, and in camel case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda t: t != "")


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(name_tokens(name)), " ")


def likely_key(name: Column) -> Column:
    """Whether a column's name looks like a key: ``id``, ``...id``, ``code``, ``...code``."""
    return F.lower(name).rlike("(^|.)(id|code)$") | F.lower(name).rlike("_(id|code)$")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 for two empty ones."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def edit_likeness(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, in 0 to 1; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def match_ratio():
    """A vectorised function of two names: 2 x matched characters over all characters.

    Meant for distinct name pairs, of which there are few whatever the rows.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    return ratio
