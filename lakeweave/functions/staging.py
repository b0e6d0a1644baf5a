"""Column expressions of staging and reporting layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Renamed and projected: new name to old name or expression."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def with_source(frames: dict[str, DataFrame], column: str = "source_relation") -> DataFrame:
    """All frames under each other, with the name of each row's source; missing columns are null."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def live(df: DataFrame, flag: str) -> DataFrame:
    """Without soft-deleted rows; a null flag means not deleted."""
    return df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def from_micros(x: Column) -> Column:
    return x / F.lit(1e6)


def flag(x: Column) -> Column:
    """0/1, t/f and true/false as booleans."""
    text = F.lower(x.cast("string"))
    return F.when(text.isin("1", "t", "true"), True).when(text.isin("0", "f", "false"), False)


def per_million(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 1e6, 2)


def click_through(clicks: Column, impressions: Column) -> Column:
    """Whole-number division, as the reports have it; null for no impressions."""
    return F.when(impressions != 0, F.floor(clicks / impressions))


def cost_per_click(spend: Column, clicks: Column) -> Column:
    return F.try_divide(spend, clicks)


def cost_per_mille(spend: Column, impressions: Column) -> Column:
    return F.try_divide(spend * 1000, impressions)


def first_of_list(x: Column) -> Column:
    """The first element of an unquoted "[a, b]" list."""
    return F.nullif(F.trim(F.get(list_of(x), F.lit(0))), F.lit(""))


def list_of(x: Column) -> Column:
    return F.split(F.regexp_replace(x, r"^\[|\]$", ""), r"\s*,\s*")


def url_parts(x: Column) -> dict[str, Column]:
    """base, host, path and utm fields; a text that is no URL is its own base."""
    utm = {f"utm_{k}": F.try_parse_url(x, F.lit("QUERY"), F.lit(f"utm_{k}")) for k in ("source", "medium", "campaign", "content", "term")}
    return {"base_url": F.get(F.split(x, r"[?#]", 2), F.lit(0)), "url_host": F.try_parse_url(x, F.lit("HOST")), "url_path": F.try_parse_url(x, F.lit("PATH")), **utm}


def email_domain(x: Column) -> Column:
    return F.nullif(F.split_part(x, F.lit("@"), F.lit(2)), F.lit(""))


def surrogate_key(*columns: Column) -> Column:
    """md5 of the columns joined by "-"; nulls as empty texts, which keep their separators."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    glued = texts[0]
    for t in texts[1:]:
        glued = F.concat(glued, F.lit("-"), t)
    return F.md5(glued)


def day_parts(day: Column) -> dict[str, Column]:
    return {"day_name": F.date_format(day, "EEE"), "day_of_month": F.dayofmonth(day)}
