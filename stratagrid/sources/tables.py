"""Scans of tables and lists, and sinks. Paths go to Spark's own readers, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_partitions(spark: SparkSession, root: str, **keys) -> DataFrame:
    """A hive-partitioned table with partition filters; a missing partition is an empty scan."""
    df = spark.read.parquet(root)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def scan_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files of a pattern; columns that some lack are NULL there."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV, plain or gzip, with a header; NaN texts become NULL. A schema is for production, inference for exploring."""
    r = spark.read.option("header", "true").option("nullValue", "").option("nanValue", "NaN")
    df = (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def with_file_token(df: DataFrame, name: str, part: int, start: int = 1, sep: str = "_") -> DataFrame:
    """df with a token of its file's name: part (0-based) of the name without its extension, from character start on."""
    base = F.regexp_replace(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), "\\..*$", "")
    return df.withColumn(name, F.substring(F.get(F.split(base, sep), part), start, 1_000))


def scan_lines(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(line, value) of a text file of work items, the slice start..end inclusive; work lists are short."""
    t = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    t = t.withColumn("line", F.row_number().over(Window.orderBy("_id")) - 1).drop("_id")
    return t.where(F.col("line") >= start) if end is None else t.where(F.col("line").between(start, end))


def scan_catalogue(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """(id, href) of the items of a JSON item collection that have an asset."""
    schema = "features array<struct<id:string,assets:map<string,struct<href:string>>>>"
    items = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    found = F.try_element_at("f.assets", F.lit(asset))
    return items.select(F.col("f.id").alias("id"), found["href"].alias("href")).where(F.col("href").isNotNull())


def write_partitioned(df: DataFrame, path: str, keys: list[str], codec: str = "zstd") -> None:
    """One bulk write by partition; only the partitions that df has are replaced, so a repeated run is harmless."""
    df.repartition(*keys).write.option("compression", codec).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def append_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    df.repartition(*keys).write.option("compression", "snappy").mode("append").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("compression", "gzip").mode("overwrite").csv(path)


def shard_of(name, hosts: int):
    """1-based output shard of a name."""
    return (F.pmod(F.xxhash64(name), F.lit(hosts)) + 1).cast("int")


def publish_manifest(df: DataFrame, collection: str, year: str, uri: str) -> DataFrame:
    """(name, request): the JSON bodies that would register a collection and one image a year."""
    body = F.to_json(F.struct(F.lit("IMAGE").alias("type"), F.concat_ws("/", F.lit(collection), F.col(year).cast("string")).alias("name"), F.array(F.struct(F.array(F.struct(F.col(uri).alias("uris"))).alias("sources"))).alias("tilesets")))
    return df.select(F.col(year).cast("string").alias("name"), body.alias("request"))
