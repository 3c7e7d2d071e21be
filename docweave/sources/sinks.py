"""Report tables and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def report_tables(detail: DataFrame, status: str, filters: dict[str, str]) -> dict[str, DataFrame]:
    """Summary, filters, distribution and detail of a result."""
    spark = detail.sparkSession
    distribution = detail.groupBy(F.col(status).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    summary = detail.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(status).alias("states"))
    summary = summary.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("name"), F.col("rows").alias("value")), F.struct(F.lit("states").alias("name"), F.col("states").alias("value")))))
    given = spark.createDataFrame(list(filters.items()) or [("none", "")], "name string, value string")
    return {"summary": summary, "filters": given, "distribution": distribution, "detail": detail}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def csv_cell(c: Column | str) -> Column:
    v = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(v, r"[\r\n]+", " "), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quoted lines separated by ``;`` without line breaks inside cells."""
    return df.select(F.concat_ws(";", *[csv_cell(c) for c in columns]).alias("value"))


def csv_export(df: DataFrame, columns: list[str], path: str) -> None:
    csv_lines(df, columns).write.mode("overwrite").text(path)
