"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's rows are put in a hashed order and cut into blocks. With integer shares q (sum Q),
source s has weight q/Q; its k-th block (from 0) is released at slot floor(k Q / q) and due at
slot ceil((k + 1) Q / q). Slots are given earliest deadline first among the released blocks, so
after any number of slots each source is less than one block from its weight. The schedule
repeats every Q slots, so one period, worked out in expressions, places every block of any
number of rows: slot = period * Q + place in the period.

When a source has no blocks left a new phase begins: the other sources go on with the weights
that their shares give among themselves. No row is dropped or repeated.

Ranks within a source come from counts by hash range and a rank within each range. Unless
rows_per_range is stated a range holds about as many rows as the largest source has ranges (the
root of its rows), so a source that holds a third of all rows is many ranges at every size. The
driver sees one count a source. Shares are divided by what they have in common, and sources of
equal shares are one count in the plan. The plan of all phases is one expression in one task: at
most (distinct shares) x (slots of a period, or of the phase if it is shorter) steps a phase; what
grows with the slots, the places of each source, is grouped by Spark. More than max_sources
sources are refused.

Defined results: a null source is the source ''; a null id or text takes part; rows of equal id
and text are ties and take neighbouring places; texts may be of any length; sources without a
stated share have default_share; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, text_or_empty, upto, written

def _bound(kind: str, value: Column, use) -> Column:
    """use(value) of a stated type, with the value worked out once; a stated type keeps deep nests quick to plan."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: use(x))


LEVELS = "array<array<array<int>>>"
STATE = "struct<m:array<bigint>,stop:bigint,snap:array<bigint>,out:%s>"


def _owners(q: Column, members: Column, total: Column, length: Column, limit: Column) -> Column:
    """Earliest deadline first over the first slots of a period: struct of out (owners of the slots, in
    arrays of arrays of arrays), stop (slots until a source has `limit` blocks, -1 if none has) and snap.

    q has the distinct shares, members the sources of each. Sources of equal shares have equal
    windows, so one count m of blocks serves all of them, in turns; snap is m at the stop. Slots are
    laid in three levels of arrays, so what a step copies is the cube root of the slots.
    """
    width = F.ceil(F.cbrt(length)).cast("bigint")

    def step(a: Column, t: Column) -> Column:
        def key(s: Column, j: Column) -> Column:
            k, of = F.floor(F.get(a["m"], j) / F.size(F.get(members, j))), F.get(members, j)
            mine = F.get(of, (F.get(a["m"], j) % F.size(of)).cast("int"))
            # released: floor(k total / s) <= t; due: ceil((k + 1) total / s), of equal ones the first source's counts
            due = F.struct(F.ceil((k + 1) * total / s).alias("d"), mine.alias("o"), j.alias("j"), (k + 1).alias("k"))
            return F.when(k * total < (t + 1) * s, due)

        def taken(x: Column) -> Column:
            def out(m: Column) -> Column:
                full = (a["stop"] < 0) & (F.get(limit, x["o"]) == x["k"])
                return F.struct(m.alias("m"), F.when(full, t + 1).otherwise(a["stop"]).alias("stop"), F.when(full, m).otherwise(a["snap"]).alias("snap"), F.concat(a["out"], F.array(x["o"])).alias("out"))

            return _bound(STATE % "array<int>", F.transform(a["m"], lambda c, j: c + F.when(j == x["j"], 1).otherwise(0)), out)

        return _bound(STATE % "array<int>", F.array_min(F.transform(q, key)), taken)

    def level(depth: int, a: Column, first: Column) -> Column:
        """The state after width ** depth slots from first on, as far as there are so many."""
        kind = "array<" * depth + "int" + ">" * depth
        begin = F.struct(a["m"].alias("m"), a["stop"].alias("stop"), a["snap"].alias("snap"), F.array().cast(kind).alias("out")).cast(STATE % kind)
        span = F.pow(width, F.lit(depth - 1)).cast("bigint")
        if depth == 1:
            return F.aggregate(F.sequence(first, F.least(first + width, length) - 1), begin, step)

        def part(a: Column, lo: Column) -> Column:
            joined = lambda x: F.struct(x["m"].alias("m"), x["stop"].alias("stop"), x["snap"].alias("snap"), F.concat(a["out"], F.array(x["out"])).alias("out"))
            return _bound(STATE % kind, level(depth - 1, a, lo), joined)

        return F.aggregate(F.sequence(first, F.least(first + width * span, length) - 1, span), begin, part)

    none = F.transform(q, lambda _: F.lit(0).cast("bigint"))
    return level(3, F.struct(none.alias("m"), F.lit(-1).cast("bigint").alias("stop"), none.alias("snap")), F.lit(0).cast("bigint"))


def _groups(kind: str, live: Column, use) -> Column:
    """use(shares, members, total): distinct shares of the live sources by their common divisor, the sources of each, and their sum."""
    common = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] > 0, F.struct(s["b"].alias("a"), F.pmod(s["a"], F.greatest(s["b"], F.lit(1))).alias("b"))).otherwise(s), lambda s: s["a"])
    places = F.sequence(F.lit(0), F.size(live) - 1)

    def grouped(raw: Column) -> Column:
        members = F.transform(raw, lambda s: F.filter(places, lambda i: F.get(live, i) == s))
        divisor = F.aggregate(raw, F.lit(0).cast("bigint"), lambda a, s: common(s, a))
        reduced = lambda of: _bound(kind, divisor, lambda d: _bound(kind, F.transform(raw, lambda s: F.floor(s / d)), lambda q: summed(q, of)))
        return _bound(kind, members, reduced)

    def summed(q: Column, of: Column) -> Column:
        return _bound(kind, F.aggregate(F.zip_with(q, of, lambda s, x: s * F.size(x)), F.lit(0).cast("bigint"), lambda a, x: a + x), lambda total: use(q, of, total))

    return _bound(kind, F.array_distinct(F.filter(live, lambda s: s > 0)), grouped)


def period_slots(spark: SparkSession, shares: list[int]) -> list[int]:
    """The owners (by position) of the slots of one period of the shares, divided by what they have in common."""
    live = F.split(F.lit(",".join(map(str, shares))), ",").cast("array<bigint>")
    none = F.transform(live, lambda _: F.lit(0).cast("bigint"))
    slots = spark.range(1).select(_groups(LEVELS, live, lambda q, of, total: _owners(q, of, total, total, none)["out"]).alias("out"))
    return slots.select(F.flatten(F.flatten("out"))).first()[0]


PHASE = f"array<struct<owner:{LEVELS},done:array<bigint>,at:bigint,total:bigint>>"
WHOLE = f"struct<done:array<bigint>,at:bigint,out:{PHASE}>"


def schedule(spark: SparkSession, blocks: dict[str, int], shares: dict[str, int]) -> DataFrame:
    """(source, steps) for sources with so many blocks: for each phase the source's first block, the phase's
    first slot and period, and the source's places in a period."""
    names = sorted(blocks)
    given = json.dumps({"m": [blocks[s] for s in names], "q": [shares[s] for s in names], "names": names})
    row = written(spark.range(1).select(F.from_json(F.lit(given), "m array<bigint>, q array<bigint>, names array<string>").alias("g")).select("g.*"), "mix-sources")
    m, q = F.col("m"), F.col("q")

    def phase(a: Column, _: Column) -> Column:
        live = F.transform(q, lambda s, i: F.when(F.get(a["done"], i) < F.get(m, i), s).otherwise(0))
        return _bound(WHOLE, live, lambda v: F.when(F.exists(v, lambda s: s > 0), _groups(WHOLE, v, lambda s, of, total: go_on(a, v, s, of, total))).otherwise(a))

    def go_on(a: Column, live: Column, share: Column, members: Column, total: Column) -> Column:
        # what each source has of a period
        own = _bound("array<bigint>", F.aggregate(live, F.lit(0).cast("bigint"), lambda b, x: b + x), lambda all_shares: F.transform(live, lambda s: F.floor(s * total / all_shares)))
        left = lambda i: F.get(m, i) - F.get(a["done"], i)

        def whole(own: Column) -> Column:
            # periods after which every source still has a block
            full = F.array_min(F.array_compact(F.transform(own, lambda s, i: F.when(s > 0, F.floor((left(i) - 1) / s)))))
            return _bound(WHOLE, full, lambda n: _bound(WHOLE, F.transform(own, lambda s, i: left(i) - n * s), lambda limit: run(own, n, limit)))

        def run(own: Column, n: Column, limit: Column) -> Column:
            soon = F.array_min(F.array_compact(F.transform(own, lambda s, i: F.when(s > 0, F.ceil(F.get(limit, i) * total / s)))))
            length = F.when(n > 0, total).otherwise(F.least(total, soon)).cast("bigint")
            return _bound(WHOLE, length, lambda size: _bound(WHOLE, _owners(share, members, total, size, limit), lambda x: closed(own, n, x)))

        def closed(own: Column, n: Column, x: Column) -> Column:
            # blocks of each source in the part of a period before the stop: its group's, in turns
            turns = F.transform(members, lambda of, j: F.transform(of, lambda i, at: F.struct(i.alias("i"), F.floor((F.get(x["snap"], j) + F.size(of) - 1 - at) / F.size(of)).alias("c"))))
            idle = F.transform(F.filter(F.sequence(F.lit(0), F.size(live) - 1), lambda i: F.get(live, i) == 0), lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("c")))
            return _bound(WHOLE, F.sort_array(F.concat(F.flatten(turns), idle)), lambda more: after(own, n, x, more))

        def after(own: Column, n: Column, x: Column, more: Column) -> Column:
            done = F.transform(own, lambda s, i: F.get(a["done"], i) + n * s + F.get(more, i)["c"])
            one = F.struct(x["out"].alias("owner"), a["done"].alias("done"), a["at"].alias("at"), total.alias("total"))
            return F.struct(done.alias("done"), (a["at"] + n * total + x["stop"]).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        return _bound(WHOLE, own, whole)

    start = F.struct(F.transform(m, lambda _: F.lit(0).cast("bigint")).alias("done"), F.lit(0).cast("bigint").alias("at"), F.array().cast(PHASE).alias("out")).cast(WHOLE)
    plan = F.aggregate(F.sequence(F.lit(1), F.size(m)), start, phase, lambda a: a["out"])
    phases = written(row.select("names", F.posexplode(plan).alias("phase", "p")), "mix-phases")
    slots = phases.select("phase", F.posexplode(F.flatten(F.flatten("p.owner"))).alias("t", "i"))
    runs = slots.groupBy("phase", "i").agg(F.array_sort(F.collect_list("t")).alias("places"))
    heads = phases.select("phase", "p.at", "p.total", F.posexplode(F.arrays_zip(F.col("p.done").alias("start"), F.col("names").alias("source"))).alias("i", "own"))
    runs = runs.join(heads, ["phase", "i"]).select("at", "total", "own.*", "places")
    step = F.struct("start", "at", "total", "places")
    return written(runs.groupBy("source").agg(F.array_sort(F.collect_list(step)).alias("steps")), "mix-plan")


def mix_sources(
    docs: DataFrame,
    shares: dict[str, int],
    *,
    default_share: int = 1,
    block_rows: int = 16,
    seed: int = 17,
    rows_per_range: int | None = None,
    max_sources: int = 1000,
    broadcast_slots: int = 2_000_000,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = "text",
) -> DataFrame:
    """docs with mix_slot (place of the row's block) and mix_order (place of the row), both from 0 and ascending."""
    spark = docs.sparkSession
    if min([default_share, block_rows, *shares.values()]) < 1:
        raise ValueError("shares and block size are positive integers")
    src, h, part, rank, n, before, of, at, steps, now = (free_name(docs, c) for c in ("_src", "_h", "_range", "_rank", "_n", "_before", "_of", "_at", "_steps", "_now"))
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    keys = [F.col(f"`{id_col}`")] + ([text_or_empty(text_col)] if text_col in docs.columns else [])
    rows = docs.withColumns({src: source, h: F.xxhash64(F.lit(seed), *keys)})
    counts = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).count().limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"over {max_sources} sources: state a coarser source column")
    if not counts:
        return docs.withColumns({"mix_slot": F.lit(0).cast("long"), "mix_order": F.lit(0).cast("long")})
    most = max(counts.values())
    bits = max(0, min(32, (most // (rows_per_range or math.isqrt(most))).bit_length()))
    rows = rows.withColumn(part, F.shiftright(F.col(h), 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy(src, part).agg(F.count("*").alias(n))
    above = Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(src).alias(of), F.col(part).alias(at), F.coalesce(F.sum(n).over(above), F.lit(0)).alias(before))
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(src, part).orderBy(h)))
    rows = rows.join(offsets, (F.col(src) == F.col(of)) & (F.col(part) == F.col(at))).withColumn(rank, F.col(before) + F.col(rank) - 1)
    own = {s: shares.get(s, default_share) for s in counts}
    plan = schedule(spark, {s: -(-c // block_rows) for s, c in counts.items()}, own)
    held = plan.agg(F.sum(F.aggregate("steps", F.lit(0), lambda a, x: a + 8 + F.size(x["places"])))).first()[0]
    plan = plan.select(F.col("source").alias(of), F.col("steps").alias(steps))
    rows = rows.drop(of).join(F.broadcast(plan) if held <= broadcast_slots else plan, F.col(src) == F.col(of))
    block = F.floor(F.col(rank) / block_rows).cast("long")
    rows = rows.withColumn(now, F.get(F.col(steps), upto(F.col(steps), block + 1) - 1))
    k, width = block - F.col(f"{now}.start"), F.size(f"{now}.places")
    slot = (F.col(f"{now}.at") + F.floor(k / width) * F.col(f"{now}.total") + F.get(F.col(f"{now}.places"), (k % width).cast("int"))).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_slot", "mix_order")]
    return rows.select(*kept, slot.alias("mix_slot"), (slot * block_rows + F.col(rank) % block_rows).cast("long").alias("mix_order"))


def in_mixed_order(docs: DataFrame, shares: dict[str, int], **options) -> DataFrame:
    """docs, with their own columns only, laid out in mixed order: partitions and rows follow mix_order.

    Columns named mix_slot or mix_order are those of an earlier mix and are dropped.
    """
    return mix_sources(docs, shares, **options).repartitionByRange("mix_order").sortWithinPartitions("mix_order").drop("mix_slot", "mix_order")
