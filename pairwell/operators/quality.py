"""Data-quality tags: one text column per row, to which every failed rule appends `` tag``.

A rule whose condition is unknown counts as not failed. Rules that look at all rows of a subject aggregate first and
then join the verdict back (``skew.attach``), so a subject with very many rows never has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.skew import HotKeys, attach

ERR = "err"


def with_empty_tags(df: DataFrame) -> DataFrame:
    return df.withColumn(ERR, F.lit(""))


def flag(df: DataFrame, cond: Column, tag: str) -> DataFrame:
    """Append ``tag`` to the rows where ``cond`` is true."""
    return df.withColumn(ERR, F.concat(F.col(ERR), F.when(cond, F.lit(f" {tag}")).otherwise(F.lit(""))))


def flags(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Append the tags of several rules in one projection, in the order given."""
    parts = [F.when(cond, F.lit(f" {tag}")).otherwise(F.lit("")) for cond, tag in rules]
    return df.withColumn(ERR, F.concat(F.col(ERR), *parts))


def mark_duplicate_key(df: DataFrame, id: str, key: str, mark: str, hot: HotKeys | None = None) -> DataFrame:
    """Add ``mark``: true on every row of a subject that has some (id, key) pair twice. NULLs count as equal."""
    pairs = df.groupBy(id, key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    bad = pairs.select(id).distinct().withColumn(mark, F.lit(True))
    return attach(df, bad, [id], "left", null_safe=True, hot=hot)


def mark_conflicting_value(df: DataFrame, id: str, col: str, mark: str, hot: HotKeys | None = None) -> DataFrame:
    """Add ``mark``: true on every row of a subject with two different non-null values; never for a missing id."""
    spread = df.filter(F.col(id).isNotNull()).groupBy(id).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    bad = spread.filter("_lo < _hi").select(id, F.lit(True).alias(mark))
    return attach(df, bad, [id], "left", hot=hot)


def mark_known(df: DataFrame, other: DataFrame, id: str, mark: str, hot: HotKeys | None = None) -> DataFrame:
    """Add ``mark``: true where the id occurs in ``other``. Missing ids count as equal."""
    known = other.select(id).distinct().withColumn(mark, F.lit(True))
    return attach(df, known, [id], "left", null_safe=True, hot=hot)


def flag_duplicate_key(df: DataFrame, id: str, key: str, tag: str, hot: HotKeys | None = None) -> DataFrame:
    """Tag every row of a subject that has some (id, key) pair twice."""
    return flag(mark_duplicate_key(df, id, key, "_bad", hot), F.col("_bad"), tag).drop("_bad")


def flag_conflicting_value(df: DataFrame, id: str, col: str, tag: str, hot: HotKeys | None = None) -> DataFrame:
    """Tag every row of a subject that has two different non-null values."""
    return flag(mark_conflicting_value(df, id, col, "_bad", hot), F.col("_bad"), tag).drop("_bad")


def flag_missing_required(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Tag rows where a required column is missing; ``tags`` maps column to tag, applied in order."""
    return flags(df, [(F.col(col).isNull(), tag) for col, tag in tags.items()])


def flag_missing_partner(
    df: DataFrame, cond: Column, other: DataFrame, id: str, tag: str, hot: HotKeys | None = None
) -> DataFrame:
    """Tag rows that meet ``cond`` but whose id does not occur in ``other``."""
    return flag(mark_known(df, other, id, "_known", hot), cond & F.col("_known").isNull(), tag).drop("_known")


def flag_date_order(df: DataFrame, start: str, end: str, min_days: int, tag: str) -> DataFrame:
    """Tag rows whose ``end`` is less than ``min_days`` days after ``start`` (0: end before start)."""
    return flag(df, F.datediff(F.col(end), F.col(start)) < min_days, tag)


def flag_cross_table_order(
    df: DataFrame,
    other: DataFrame,
    id: str,
    other_date: str,
    end: str,
    min_days: int,
    tag: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Tag rows whose ``end`` is less than ``min_days`` after ``other_date`` of the same subject in another table.

    A left join: a subject with several rows in ``other`` repeats the row here.
    """
    dates = other.select(id, F.col(other_date).alias("_other_date"))
    joined = attach(df, dates, [id], "left", hot=hot)
    return flag(joined, F.datediff(F.col(end), F.col("_other_date")) < min_days, tag).drop("_other_date")


def lacks_tags(tags: list[str]) -> Column:
    return ~F.arrays_overlap(F.split(F.col(ERR), " "), F.array(*[F.lit(t) for t in tags]))


def without_tags(df: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Keep rows that carry none of ``tags``, or no tag at all."""
    if tags is None:
        return df.filter(F.col(ERR) == "")
    return df.filter(lacks_tags(tags))


def repeated_keys(df: DataFrame, id: str) -> DataFrame:
    """The ids that occur more than once, with their row count; missing ids are left out."""
    return df.filter(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_unique(df: DataFrame, id: str) -> DataFrame:
    """Stop the run if an id repeats."""
    first = repeated_keys(df, id).limit(1).collect()
    if first:
        raise ValueError(f"{id} {first[0][0]!r} occurs {first[0]['n']} times")
    return df


def error_counts(df: DataFrame) -> DataFrame:
    """Rows per tag combination, the untagged ones included. The result is as small as the set of combinations."""
    return df.groupBy(ERR).agg(F.count(F.lit(1)).alias("value"))


def error_combined(counts: DataFrame) -> DataFrame:
    """Counts per tag combination (untagged left out) plus one row with err NULL for the total."""
    kinds = error_kinds(counts)
    total = F.col("kind") == "total"
    return kinds.filter("kind <> 'separate'").select(F.when(~total, F.col(ERR)).alias(ERR), "value")


def error_separate(counts: DataFrame) -> DataFrame:
    """Counts per single tag."""
    return error_kinds(counts).filter("kind = 'separate'").select(ERR, "value")


def error_kinds(counts: DataFrame) -> DataFrame:
    """(kind, err, value) from :func:`error_counts`: per combination, in total and per single tag, in one aggregate.

    There is always a row for the total; without a tagged row its value is NULL. A combination is copied to the groups it counts in.
    """
    tagged = F.col(ERR) != ""
    line = lambda kind, err: F.struct(F.lit(kind).alias("kind"), err.alias(ERR), F.when(tagged, F.col("value")).alias("value"))
    tags = F.transform(F.filter(F.split(F.col(ERR), " "), lambda t: t != ""), lambda t: line("separate", t))
    own = F.when(tagged, F.array(line("combined", F.col(ERR)))).otherwise(F.array().cast("array<struct<kind:string,err:string,value:bigint>>"))
    # an untagged row of its own, so that there is a total of nothing
    counts = counts.select(ERR, "value").unionByName(counts.sparkSession.sql(f"SELECT '' AS {ERR}, CAST(0 AS BIGINT) AS value"))
    rows = counts.select(F.inline(F.concat(own, F.array(line("total", F.lit(""))), tags)))
    return rows.groupBy("kind", ERR).agg(F.sum("value").alias("value"))
