"""User functions and kept stages on small hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stratagrid.operators import apply as A
from stratagrid.operators import census as C
from stratagrid.operators import sampling as S


def test_kept_stage_is_built_once(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert A.kept_stage(spark, path, build).count() == A.kept_stage(spark, path, build).count() == 3
    assert len(built) == 1


def test_kept_stage_shows_other_errors(spark, tmp_path):
    (tmp_path / "odd").mkdir()
    with pytest.raises(AnalysisException):  # a folder without a table is no missing stage
        A.kept_stage(spark, str(tmp_path / "odd"), lambda: spark.range(1))


def test_year_rows_skip_nulls(spark):
    rows = A.YearRows(F.lit(2000), F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0))).collect()
    assert sorted(map(tuple, rows)) == [(2000, 1.0), (2002, 3.0)]


def test_complete_series(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2001), (1, 2001), (2, 2000), (3, 1999)], "k int, y int")
    assert sorted(map(tuple, C.complete_series(df, ["k"], "y", [2000, 2001]).collect())) == [(1, 2000), (1, 2001), (1, 2001)]
    assert C.complete_series(df.limit(0), ["k"], "y", [2000]).count() == 0


def test_choose_keys(spark):
    df = spark.createDataFrame([(k,) for k in (1, 1, 2, 3)], "k int")
    got = {r.draw: r.key for r in S.choose_keys(df, "k", 40, seed=5).collect()}
    assert sorted(got) == list(range(1, 41))
    assert set(got.values()) == {1, 2, 3}
    assert got == {r.draw: r.key for r in S.choose_keys(df.distinct(), "k", 40, seed=5).collect()}
