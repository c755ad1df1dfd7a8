"""Administrative-unit tables: normalisation, pivots, unions, de-duplication, exclusion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions import text as T


def normalize_census(df: DataFrame, classes: dict[str, str], animals: list[str], *, min_year: int, min_level: int) -> DataFrame:
    """Rows of (gaz_id, gaz_name, onto_name, onto_match, year, method, heads) as animal-years.

    Names are mapped by onto_match where a class is known; rows pass if the year and level are
    great enough, the animal is wanted, heads are not negative and the unit is named.
    """
    mapping = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]) if classes else F.lit(None)
    name = F.coalesce(F.try_element_at(mapping, F.lower("onto_match")), F.col("onto_name")) if classes else F.col("onto_name")
    out = df.withColumns({"onto_name": name, "level": T.level_of(F.col("gaz_name")).cast("long"), "country": F.element_at(T.parts_of(F.col("gaz_name")), 1), "year": T.year_of(F.col("year"))})
    keep = (F.col("year") >= min_year) & (F.col("level") >= min_level) & F.col("onto_name").isin(animals) & (F.col("heads") >= 0) & (F.col("gaz_name") != "NA.NA.NA") & F.col("gaz_id").isNotNull()
    return out.where(keep).withColumn("animal", F.lower("onto_name"))


def pivot_mean(df: DataFrame, keys: list[str], column: str, value: str, names: list) -> DataFrame:
    """Mean of value for each name of column, as columns; rows with a NULL key are dropped, as in a pivot table."""
    return df.dropna(subset=keys).groupBy(*keys).pivot(column, names).agg(F.avg(value))


def melt(df: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide columns as rows, without the NULL ones."""
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def union_aligned(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; missing columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def exclude_by_rules(df: DataFrame, rules: list[dict[str, list]]) -> DataFrame:
    """Rows that no rule matches; a rule matches where every named column has one of its values."""
    hit = F.lit(False)
    for rule in rules:
        one = F.lit(True)
        for c, values in rule.items():
            one = one & F.coalesce(F.col(c).isin(values), F.lit(False))
        hit = hit | one
    return df.where(~hit)


def non_null_count(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("long") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("long"))


def sparse_columns(df: DataFrame, columns: list[str], share: float) -> list[str]:
    """Columns with over share of their rows NULL or NaN, counted in one pass."""
    missing = lambda c: F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long"))
    row = df.agg(F.count("*").alias("n"), *[missing(c).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0) > share * row["n"]]


def columns_like(df: DataFrame, patterns: list[str]) -> list[str]:
    """Columns whose name contains one of the patterns."""
    return [c for c in df.columns if any(p in c for p in patterns)]


def quantile_floor(df: DataFrame, value: str, q: float = 0.02, floor: float = 0.001) -> DataFrame:
    """Positive values at or below their q-quantile become floor; the quantile is one row, broadcast."""
    edge = df.where(F.col(value) > 0).agg(F.percentile(value, q).alias("_q"))
    low = (F.col(value) > 0) & (F.col(value) <= F.col("_q"))
    return df.crossJoin(F.broadcast(edge)).withColumn(value, F.when(low, floor).otherwise(F.col(value))).drop("_q")


def quantile_cut(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows below the q-quantile."""
    edge = df.agg(F.percentile(value, q).alias("_q"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(value) < F.col("_q")).drop("_q")


def repair_zero_mask(df: DataFrame, mask: str, heads: str, density: str, covariates: list[str]) -> DataFrame:
    """Where the mask is 0: rows above the median heads of complete such rows go, the others get density 0."""
    complete = df.where(F.col(mask) == 0).dropna(subset=covariates)
    edge = complete.agg(F.median(heads).alias("_m"))
    zero = F.coalesce(F.col(mask) == 0, F.lit(False))
    both = df.crossJoin(F.broadcast(edge))
    return both.where(~(zero & F.coalesce(F.col(heads) > F.col("_m"), F.lit(False)))).withColumn(density, F.when(zero, 0.0).otherwise(F.col(density))).drop("_m")


def remap(column: Column, mapping: dict, keep: bool) -> Column:
    """Mapped value; one without an entry is kept or NULL."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(table, column)
    return F.coalesce(found, column) if keep else found


def one_versus_one(cls: Column, positive: int, negative: int) -> Column:
    return F.when(cls == positive, 1).when(cls == negative, 0)


def complete_series(df: DataFrame, keys: list[str], t: str, times: list) -> DataFrame:
    """Rows of the keys that have a row at every one of the times: the inner join of all times, with one shuffle."""
    whole = df.where(F.col(t).isin(times)).groupBy(*keys).agg(F.count_distinct(t).alias("_n")).where(F.col("_n") == len(set(times)))
    return df.join(whole.drop("_n"), keys, "left_semi")


def density_cap(df: DataFrame, animal: str, density: str, caps: dict[str, float]) -> DataFrame:
    """Rows whose density is at most the cap of their animal; those without a density or a cap go."""
    return df.where(F.coalesce(F.col(density) <= remap(F.col(animal), caps, False), F.lit(False)))


def side_by_side(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of several tables beside each other, row by key (never by position); a key that a table lacks has NULLs there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, keys, "full")
    return out
