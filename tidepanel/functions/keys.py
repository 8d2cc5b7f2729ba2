"""Text keys and calendar arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# English month abbreviations in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_number(name: Column) -> Column:
    """1..12 for a known abbreviation, null for anything else."""
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.when(position > 0, position.cast("int"))


def month_index(year: Column, month: Column, base_year: int) -> Column:
    return ((year - base_year) * 12 + month - 1).cast("int")


def date_index(date: Column | str, base_year: int) -> Column:
    return month_index(F.year(_col(date)), F.month(_col(date)), base_year)


def parse_month(df: DataFrame, col: str = "month", base_year: int = 2019) -> DataFrame:
    """``2019-Jan`` or ``2019 Jan`` to ``year``, ``month_num`` and ``t``."""
    text = F.translate(F.col(col), "-", " ")
    year = F.substring(text, 1, 4).try_cast("int")
    month = month_number(F.substring(text, 6, 16))
    return df.withColumns({"year": year, "month_num": month, "t": month_index(year, month, base_year)})


def parse_entity(df: DataFrame, col: str = "sector") -> DataFrame:
    """First run of digits in the text, as ``entity_id``; null when there is none."""
    return df.withColumn("entity_id", F.regexp_extract(F.col(col), r"(\d+)", 1).try_cast("bigint"))


def explode_id(df: DataFrame, col: str = "id", base_year: int = 2019, default_t: int | None = None) -> DataFrame:
    """``2024 Aug_sector 1`` to month and entity text, then to their parsed keys."""
    parts = F.split(F.col(col), "_")
    out = df.withColumns({"month": F.get(parts, F.lit(0)), "sector": F.get(parts, F.lit(1))})
    out = parse_entity(parse_month(out, base_year=base_year))
    if default_t is not None:
        out = out.withColumn("t", F.coalesce("t", F.lit(default_t)))
    return out


def month_of(t: Column | str = "t", season: int = 12) -> Column:
    """Phase within the season, counted from 1."""
    return (F.pmod(_col(t), F.lit(season)) + 1).cast("int")


def year_of(t: Column | str = "t", base_year: int = 2019) -> Column:
    return (F.floor(_col(t) / 12) + base_year).cast("int")


def calendar_features(df: DataFrame, base_year: int = 2019) -> DataFrame:
    month = month_of("t")
    return df.withColumns(
        {
            "month_num": month,
            "year": year_of("t", base_year),
            "quarter": (F.floor((month - 1) / 3) + 1).cast("int"),
            "is_december": (month == 12).cast("int"),
        }
    )


def season_code(t: Column | str = "t") -> Column:
    """December to February 0, March to May 1, June to August 2, September to November 3."""
    return F.floor(F.pmod(month_of(t), F.lit(12)) / 3).cast("int")


def fourier(df: DataFrame, periods: list[int], phase: Column | str = "t") -> DataFrame:
    """``sin_p`` and ``cos_p`` of the phase for every period ``p``."""
    waves = {}
    for p in periods:
        angle = _col(phase) * F.lit(2 * math.pi / p)
        waves[f"sin_{p}"] = F.sin(angle)
        waves[f"cos_{p}"] = F.cos(angle)
    return df.withColumns(waves)


def year_progress(df: DataFrame, t_max: int | Column | None = None) -> DataFrame:
    """``t`` over the newest period, which costs a pass over ``df`` unless it is given."""
    newest = df.agg(F.max("t")).scalar() if t_max is None else F.lit(t_max)
    return df.withColumn("year_progress", F.try_divide(F.col("t"), newest))


def abs_month(year: Column, month: Column) -> Column:
    return (year * 12 + month).cast("int")


def month_label(absolute: Column, sep: str = "-") -> Column:
    """Inverse of ``abs_month``: ``24229`` to ``2019-Jan``."""
    zero_based = absolute - 1
    year = F.floor(zero_based / 12).cast("int")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (F.pmod(zero_based, F.lit(12)) + 1).cast("int"))
    return F.concat(year.cast("string"), F.lit(sep), name)


def horizon_id(t: Column | str, entity: Column | str, base_year: int = 2019) -> Column:
    """``2024 Aug_sector 1``."""
    label = month_label(_col(t) + base_year * 12 + 1, " ")
    return F.concat(label, F.lit("_sector "), _col(entity).cast("string"))
