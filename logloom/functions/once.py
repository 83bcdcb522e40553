"""Columns that are computed once a row, whatever is made of them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns. They pass through a one-row generator: the optimizer neither copies their expressions into each place
    that uses them nor pushes filters on them down as copies, which would grow the plan with every step."""
    out = df.drop(*columns) if set(columns) & set(df.columns) else df
    made = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*[F.col(n) for n in out.columns], *[F.col(f"_once.{n}").alias(n) for n in columns])
