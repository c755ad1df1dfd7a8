"""Shared folder, row order and small plan helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local temporary folder stands in only where the setting is missing and Spark runs in one
    process, as in tests; on a cluster the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratagrid-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that no later step reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def joined_by_key(rows: DataFrame, side: DataFrame, key: str | list[str], n: str, hot: int = 1000) -> DataFrame:
    """rows joined with side, which has one row for every key and in n the number of rows that have it.

    Keys with more than one in `hot` of all rows are fewer than `hot`, so their sides are sent to
    every task and their rows stay where they are; the others are joined by a shuffle.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    often, rare = side.where(F.col(n) * hot > total).drop(n), side.where(F.col(n) * hot <= total).drop(n)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(F.broadcast(often.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rare, key))


def placed(hits: Column, gaps: Column) -> Column:
    """Matches with their places: (start, end, value) of each of hits; gaps has what lies before each and after the last.

    Places are sums over all that came before. They are taken within blocks of about the root of
    the number of matches, then over the blocks, so many matches cost little more each than few.
    """
    pieces = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(m.alias("m"), F.length(m).alias("l"), F.length(g).alias("g")))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        end = start + x["l"]
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    def blocks(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda b: F.aggregate(F.slice(p, b * width + 1, width), begin, step))

    def laid(bs: Column) -> Column:
        ends = F.aggregate(bs, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        shifted = lambda bs, ends: F.flatten(F.transform(bs, lambda b, i: F.transform(b["out"], lambda s: F.struct((s["start"] + F.get(ends, i)).alias("start"), (s["end"] + F.get(ends, i)).alias("end"), s["value"].alias("value")))))
        return bound(ends, lambda e: shifted(bs, e))

    return F.when(F.size(hits) > 0, bound(pieces, lambda p: bound(blocks(p), laid))).otherwise(F.array().cast(kind))


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def upto(items: Column, place: Column) -> Column:
    """How many of items (by ascending start) begin before a place, by binary search."""
    n = F.size(items)
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda j: F.call_function("shiftleft", F.lit(1), j))
    ahead = lambda at, step: (at + step <= n) & (F.get(items, at + step - 1)["start"] < place)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(at, step), step).otherwise(0))


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
