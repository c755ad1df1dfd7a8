"""User functions over columns, groups, tiles and tables, and stages kept by name.

Functions work on pandas objects and get Arrow batches; prefer column expressions where they exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def apply_rows(fn: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A column function from one on whole pandas Series."""
    return F.pandas_udf(fn, kind)


def apply_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on each group as one frame: a group must fit a task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_tiles(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on each batch of rows, with no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fn, batches)

    return df.mapInPandas(run, schema)


def aggregate_with(fn: Callable[..., float], kind: str) -> Callable[..., Column]:
    """An aggregate from a function of Series to one value."""

    def run(v: pd.Series) -> float:
        return fn(v)

    return F.pandas_udf(run, kind)


@F.udtf(returnType="year: int, value: double")
class YearRows:
    """One row for each year that an array of values covers; null values give none."""

    def eval(self, first: int, values: list) -> Iterator[tuple[int, float]]:
        for k, v in enumerate(values or ()):
            if v is not None:
                yield first + k, v


def kept_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none, what build returns is written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
