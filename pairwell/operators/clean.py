"""Cleaning and typing of raw rows. Everything is a projection, except ``dedupe_rows`` and ``observed_levels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column. Copies are removed before the shuffle as well."""
    return df.distinct()


def null_if(df: DataFrame, col: str, value) -> DataFrame:
    """Turn a sentinel value into NULL."""
    return df.withColumn(col, F.nullif(F.col(col), F.lit(value)))


def recoded(col: str, mapping: dict, null_to: str | None = None) -> Column:
    """Value of ``col`` replaced by ``mapping``; values not listed pass through, NULL becomes ``null_to``.

    A target of None makes the value missing.
    """
    text = F.col(col).cast("string")
    chain = F.when(text.isNull(), F.lit(null_to).cast("string"))
    for source, target in mapping.items():
        chain = chain.when(text == source, F.lit(target).cast("string"))
    return chain.otherwise(text)


def recode(df: DataFrame, col: str, mapping: dict, null_to: str | None = None, out: str | None = None) -> DataFrame:
    """Replace values of one column, see ``recoded``."""
    return df.withColumn(out or col, recoded(col, mapping, null_to))


def level_order(col, levels) -> Column:
    """1-based place of a value in ``levels``; NULL outside the list."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(col)), F.lit(0)).cast("int")


def level_name(ordinal: Column, levels) -> Column:
    """Label of a 1-based place in ``levels``."""
    return F.try_element_at(F.array(*[F.lit(x) for x in levels]), ordinal.cast("int"))


def as_ordered(df: DataFrame, col: str, levels) -> DataFrame:
    """Ordered category: adds ``<col>_ord``; values outside ``levels`` become missing."""
    known = F.when(F.col(col).isin(*levels), F.col(col))
    return df.withColumn(f"{col}_ord", level_order(col, levels)).withColumn(col, known)


def parse_date(col: Column) -> Column:
    """Text to date: ``yyyy-m-d`` or ``yyyy/m/d``, text after the day ignored; anything else is NULL."""
    head = F.regexp_extract(col, r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1)
    return F.translate(head, "/", "-").try_cast("date")


def parse_day_key(col: Column) -> Column:
    """Integer day key ``yyyymmdd`` to date; an impossible day is NULL."""
    text = col.cast("string")
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def day_key_to_date(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, parse_day_key(F.col(col)))


def coerce(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast text columns: ``date``, ``day_key``, or any Spark type name. What does not parse becomes NULL."""
    casts = {"date": parse_date, "day_key": parse_day_key}
    cols = {c: casts[t](F.col(c)) if t in casts else F.col(c).try_cast(t) for c, t in spec.items()}
    return df.withColumns(cols)


def observed_levels(df: DataFrame, col: str) -> DataFrame:
    """Renumber ``<col>_ord`` over the levels that occur. The level table has at most one row per listed level."""
    ordinal = f"{col}_ord"
    seen = df.filter(F.col(ordinal).isNotNull()).select(F.col(ordinal).alias("_seen")).distinct()
    ranks = seen.select("_seen", F.row_number().over(Window.orderBy("_seen")).alias("_new"))
    return (
        df.join(F.broadcast(ranks), F.col(ordinal) == F.col("_seen"), "left")
        .withColumn(ordinal, F.col("_new"))
        .select(*df.columns)
    )


def collapse_levels(df: DataFrame, col: str, groups: dict[str, tuple], out: str | None = None) -> DataFrame:
    """Merge several levels into one: ``{"severe_critical": ("severe", "critical")}``; others stay."""
    value = F.col(col)
    for name, members in groups.items():
        value = F.when(F.col(col).isin(*members), F.lit(name)).otherwise(value)
    return df.withColumn(out or col, value)
