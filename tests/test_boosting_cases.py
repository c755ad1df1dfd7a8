"""Levels of trees work on the distinct bins, not on the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import boosting


def test_levels_read_one_row_a_case(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") % 21 + 1).cast("double").alias("y"))
    seen, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda rows, *a: seen.append(rows.count()) or grow(rows, *a))
    model = boosting.fit_poisson_boosting(df, ["x", "z"], "y", "id", rounds=2, depth=2, rate=0.5)
    assert len(seen) == 2 and max(seen) <= 21
    assert model.deviances[-1] < model.deviances[0]
