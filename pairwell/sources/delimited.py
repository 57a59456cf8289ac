"""Delimited text sources and small report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    sep: str = "|",
    missing: str = "NULL",
    header: bool = True,
    malformed: str | None = None,
) -> DataFrame:
    """Scan delimited text, every column as text; ``missing`` becomes NULL, an empty field stays ''.

    Without ``schema`` the header names the columns (no type inference, so no second pass over the files). With one,
    its names and order are enforced. Types are set afterwards by ``operators.clean.coerce``, which never fails a row.

    A line of too few or too many fields stops the run, unless ``malformed`` names a column: it then holds such a line as
    it stands, and is NULL for the others. Fields that are missing at the end of a short line are '', those beyond the
    last column of a long one are only in the line.
    """
    options = {"sep": sep, "header": header, "encoding": "UTF-8", "mode": "PERMISSIVE" if malformed else "FAILFAST"}
    names = [f.name for f in schema.fields] if schema is not None else spark.read.options(**options).csv(path).columns
    if malformed in names:
        raise ValueError(f"{malformed} is a column of the file")
    fields = [T.StructField(c, T.StringType()) for c in [*names, *([malformed] if malformed else [])]]
    # with column pruning Spark parses the fields a query needs only, and finds no line short or long
    judged = {"columnNameOfCorruptRecord": malformed, "columnPruning": False} if malformed else {}
    reader = spark.read.options(**options, **judged)
    raw = reader.schema(T.StructType(fields)).csv(path)
    text = lambda c: F.when(F.col(c).isNull(), F.lit("")).when(F.col(c) != missing, F.col(c)).alias(c)
    return raw.select(*[text(c) for c in names], *([malformed] if malformed else []))


def line_kind(line: Column, columns: int, sep: str = "|") -> Column:
    """``short``, ``long`` or ``other`` for a malformed line, by its separators outside quotes; NULL for none."""
    plain = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', "")
    found = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    return F.when(line.isNull(), F.lit(None)).when(found < columns, "short").when(found > columns, "long").otherwise("other")


def malformed_counts(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = "|", header: bool = True) -> DataFrame:
    """Per file: its lines, and how many of them are short, long or malformed otherwise; one scan."""
    rows = read_delimited(spark, path, schema, sep, header=header, malformed="_line")
    columns = len(rows.columns) - 1
    # a query that needs nothing but the malformed line is refused, so the file's fields are looked at, too
    fields = F.sum(F.length(F.coalesce(rows.columns[0], F.lit(""))))
    told = rows.withColumn("file", F.input_file_name()).withColumn("kind", line_kind(F.col("_line"), columns, sep))
    return told.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), fields.alias("_any"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("short", "long", "other")]
    ).filter("_any >= 0").drop("_any")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", missing: str = "") -> DataFrame:
    """Read what :func:`write_csv` wrote: ``missing`` becomes NULL, ``""`` an empty text."""
    # Spark compares an empty field with the missing value after unquoting, so that an empty text gets a mark in between
    mark = "\x01"
    raw = spark.read.schema(schema).options(header=True, sep=sep, nullValue=missing, emptyValue=mark).csv(path)
    texts = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    return raw.select(*[F.when(F.col(c) != mark, F.col(c)).when(F.col(c) == mark, F.lit("")).alias(c) if c in texts else F.col(c) for c in raw.columns])


def write_csv(df: DataFrame, path: str, single_file: bool = False, sep: str = ",", missing: str = "") -> None:
    """Write a table as CSV with a header; missing values are written as ``missing``, an empty text as ``""``.

    ``single_file`` is meant for the report tables, which have a fixed small number of rows.
    """
    out = df.coalesce(1) if single_file else df
    out.write.options(header=True, sep=sep, nullValue=missing, emptyValue='""').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Save a model or matching summary, which is a table here, as one parquet file."""
    df.coalesce(1).write.parquet(path)
