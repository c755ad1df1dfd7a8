"""Queries over administrative tables, with orders and customers as the census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions import text as T
from stratagrid.operators import census as C
from stratagrid.plans.registry import query
from stratagrid.session import table

YEARS = list(range(1995, 2002))


def _nation_years(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").cast("long").alias("nation"), F.year("o_orderdate").alias("year"), "o_totalprice")


@query("pivot_mean", "SELECT CAST(c_nationkey AS BIGINT) AS nation, " + ", ".join(f"round(avg(o_totalprice) FILTER (year(o_orderdate) = {y}), 6) AS y{y}" for y in YEARS) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pivot_mean(spark: SparkSession, sf: str) -> DataFrame:
    wide = C.pivot_mean(_nation_years(spark, sf), ["nation"], "year", "o_totalprice", YEARS)
    return wide.select("nation", *[F.round(f"`{y}`", 6).alias(f"y{y}") for y in YEARS])


@query("unpivot_long", "SELECT CAST(c_nationkey AS BIGINT) AS nation, 'cattle_' || year(o_orderdate) AS animal_year, round(avg(o_totalprice), 6) AS heads FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = C.pivot_mean(_nation_years(spark, sf), ["nation"], "year", "o_totalprice", YEARS)
    wide = wide.withColumnsRenamed({str(y): f"cattle_{y}" for y in YEARS})
    return C.melt(wide, ["nation"], [f"cattle_{y}" for y in YEARS], "animal_year", "heads").withColumn("heads", F.round("heads", 6))


@query(
    "census_normalize",
    """WITH c AS (SELECT c_custkey, n_name || '.' || c_mktsegment || '.' || c_custkey AS gaz_name, o_orderpriority AS onto_match, o_orderstatus AS onto_name, strftime(o_orderdate, '%Y-%m-%d') AS y, o_totalprice - 50000 AS heads
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT *, CASE WHEN lower(onto_match) = '1-urgent' THEN 'Cattle' WHEN lower(onto_match) = '2-high' THEN 'Goat' ELSE onto_name END AS name, CAST(len(string_split(gaz_name, '.')) AS BIGINT) AS level, string_split(gaz_name, '.')[1] AS country, CAST(substr(y, 1, 4) AS INT) AS year FROM c)
SELECT country, lower(name) AS animal, year, level, count(*) AS n, round(avg(heads), 6) AS heads FROM m WHERE year >= 1997 AND level >= 2 AND name IN ('Cattle', 'Goat') AND heads >= 0 GROUP BY ALL""",
)
def census_normalize(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = c.select(F.col("c_custkey").cast("string").alias("gaz_id"), F.concat_ws(".", "n_name", "c_mktsegment", "c_custkey").alias("gaz_name"), F.col("o_orderpriority").alias("onto_match"), F.col("o_orderstatus").alias("onto_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("year"), (F.col("o_totalprice") - 50000).alias("heads"))
    out = C.normalize_census(raw, {"1-urgent": "Cattle", "2-high": "Goat"}, ["Cattle", "Goat"], min_year=1997, min_level=2)
    return out.groupBy("country", "animal", "year", "level").agg(F.count("*").alias("n"), F.round(F.avg("heads"), 6).alias("heads"))


@query("id_normalize", "SELECT c_custkey AS k, regexp_extract(c_name, '[A-Za-z]+') || CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS id FROM customer UNION ALL SELECT n_nationkey, regexp_extract(n_name, '[A-Za-z]+') || CAST(regexp_extract(n_name, '[0-9]+') AS BIGINT) FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def id_normalize(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.col(k).cast("long").alias("k"), T.normalize_id(F.col(n)).alias("id")) for t, k, n in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]
    return C.union_aligned(*parts)


@query("union_align", "SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS BIGINT), NULL, s_acctbal FROM supplier")
def union_align(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance"))
    return C.union_aligned(a, b)


@query("dedup_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_one(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("dedup_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_one(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("left_join_dedup", "WITH l AS (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey, o_orderpriority AS last_priority FROM customer LEFT JOIN l ON o_custkey = c_custkey")
def left_join_dedup(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"))
    return table(spark, sf, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_priority")


@query("rule_exclusion", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment FROM customer WHERE NOT (c_nationkey IN (1, 2) AND c_mktsegment = 'BUILDING') AND NOT (c_nationkey = 7) AND NOT (c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND c_nationkey IN (3, 4, 5))")
def rule_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"c_nationkey": [1, 2], "c_mktsegment": ["BUILDING"]}, {"c_nationkey": [7]}, {"c_mktsegment": ["MACHINERY", "HOUSEHOLD"], "c_nationkey": [3, 4, 5]}]
    return C.exclude_by_rules(table(spark, sf, "customer"), rules).select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment")


@query("quantile_floor", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.02) AS q FROM customer WHERE c_acctbal > 0) SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= q THEN 0.001 ELSE c_acctbal END AS v FROM customer, q")
def quantile_floor(spark: SparkSession, sf: str) -> DataFrame:
    return C.quantile_floor(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "v")


@query("quantile_cut", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
def quantile_cut(spark: SparkSession, sf: str) -> DataFrame:
    return C.quantile_cut(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(
    "zero_mask_repair",
    """WITH t AS (SELECT p_partkey AS k, CAST(p_size % 5 AS DOUBLE) AS mask, p_retailprice AS heads, nullif(p_size, 10) AS cov FROM part),
m AS (SELECT median(heads) AS m FROM t WHERE mask = 0 AND cov IS NOT NULL)
SELECT k, mask, heads, CASE WHEN mask = 0 THEN 0.0 ELSE heads / mask END AS density FROM t, m WHERE NOT (mask = 0 AND heads > m)""",
)
def zero_mask_repair(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).cast("double").alias("mask"), F.col("p_retailprice").alias("heads"), F.nullif(F.col("p_size"), F.lit(10)).alias("cov"))
    t = t.withColumn("density", F.try_divide("heads", "mask"))
    return C.repair_zero_mask(t, "mask", "heads", "density", ["cov"]).drop("cov")


@query("drop_missing_rows", "WITH t AS (SELECT p_partkey AS k, nullif(p_size, 10) AS a, CASE WHEN p_retailprice < 1000 THEN NULL ELSE p_retailprice END AS b FROM part) SELECT k, (a IS NOT NULL AND b IS NOT NULL) AS complete FROM t WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.nullif(F.col("p_size"), F.lit(10)).alias("a"), F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).alias("b"))
    return t.dropna("all", subset=["a", "b"]).select("k", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("complete"))


@query("sparse_columns", "SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_size END AS dense FROM part")
def sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") >= 5, F.col("p_size")).alias("dense"), F.when(F.col("p_size") < 5, F.col("p_size")).alias("sparse"))
    return t.drop(*C.sparse_columns(t, ["dense", "sparse"], 0.5))


@query("class_remap", "SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS mapped, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS replaced, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS versus FROM lineitem")
def class_remap(spark: SparkSession, sf: str) -> DataFrame:
    m, c = {"A": "accepted", "R": "returned"}, F.col("l_returnflag")
    code = F.when(c == "A", 1).when(c == "R", 2).otherwise(3)
    return table(spark, sf, "lineitem").select("l_orderkey", C.remap(c, m, False).alias("mapped"), C.remap(c, m, True).alias("replaced"), C.one_versus_one(code, 1, 3).alias("versus"))


@query("value_counts", "SELECT c_mktsegment AS segment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "customer")
    n = t.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("segment", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("crosstab_fill", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders GROUP BY 1")
def crosstab_fill(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "X"]).count().na.fill(0)
    return t.select("year", F.col("F").alias("f"), F.col("O").alias("o"), F.col("X").alias("x"))


@query("having_sources", "WITH m AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM m)")
def having_sources(spark: SparkSession, sf: str) -> DataFrame:
    many = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n > 2")
    c = table(spark, sf, "customer")
    return c.join(many, c.c_custkey == many.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("multi_aggregate", "SELECT c_mktsegment AS segment, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS least, max(c_acctbal) AS most, median(c_acctbal) AS middle FROM customer GROUP BY 1")
def multi_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("nations"), F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("middle"))


@query("row_non_null", "SELECT p_partkey, CAST((p_size > 10) AS BIGINT) + CAST((p_size > 20) AS BIGINT) + CAST((p_size > 30) AS BIGINT) AS n FROM part")
def row_non_null(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_partkey", *[F.when(F.col("p_size") > k, 1).alias(f"v{k}") for k in (10, 20, 30)])
    return t.select("p_partkey", C.non_null_count(["v10", "v20", "v30"]).alias("n"))


@query("text_functions", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capital, md5(p_name) AS id, replace('a/{year}/b', '{year}', CAST(p_size AS VARCHAR)) AS path, CASE WHEN length(p_name) > 0 THEN len(string_split(p_name, ' ')) ELSE 0 END AS tokens, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || '.' || p_brand END AS joined, TRY_CAST(substr(p_brand, 7, 2) AS INT) AS year FROM part")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", T.capitalize(n).alias("capital"), F.md5(n).alias("id"), T.template(F.lit("a/{year}/b"), F.col("p_size")).alias("path"), T.count_tokens(n, " ").cast("long").alias("tokens"), T.ordered_unique(F.col("p_type"), F.col("p_brand"), F.lit("nan"), F.col("p_type")).alias("joined"), T.year_of(F.substring("p_brand", 7, 2)).alias("year"))


@query("tile_alias", "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '000W_10N' WHEN 1 THEN '010W_00S' WHEN 2 THEN '020E_00S' ELSE '030E_20S' END AS tile FROM orders) SELECT o_orderkey, CASE WHEN contains(tile, '000W') THEN replace(tile, '000W', '000E') ELSE replace(tile, '00S', '00N') END AS tile FROM t")
def tile_alias(spark: SparkSession, sf: str) -> DataFrame:
    tile = F.get(F.array(*[F.lit(x) for x in ("000W_10N", "010W_00S", "020E_00S", "030E_20S")]), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.tile_alias(tile).alias("tile"))


@query("date_repair", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS year, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(ceil(month(o_orderdate) / 2.0) AS INT) AS period, CAST(least(year(o_orderdate), 1999) AS INT) AS capped FROM orders")
def date_repair(spark: SparkSession, sf: str) -> DataFrame:
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    d = T.repair_date(mixed)
    return table(spark, sf, "orders").select("o_orderkey", d.alias("day"), F.year(d).alias("year"), F.dayofyear(d).alias("doy"), T.bimonth(d).alias("period"), F.least(F.year(d), F.lit(1999)).alias("capped"))


@query("filename_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(o_orderdate AS DATE) AS last FROM orders")
def filename_dates(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat(F.lit("gpp_m_30m_"), f(F.trunc("o_orderdate", "month")), F.lit("_"), f("o_orderdate"), F.lit("_go.tif"))
    a, b = T.dates_in_name(name)
    return table(spark, sf, "orders").select("o_orderkey", a.alias("first"), b.alias("last"))


@query("month_range", "SELECT c_custkey, CAST(m AS DATE) AS month FROM (SELECT o_custkey AS c_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1)")
def month_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return o.select("c_custkey", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


@query("json_manifest", "SELECT c_custkey, json_extract_string(j, '$.id') AS id, CAST(json_extract_string(j, '$.n') AS BIGINT) AS n FROM (SELECT c_custkey, json_object('id', c_name, 'n', c_nationkey) AS j FROM customer)")
def json_manifest(spark: SparkSession, sf: str) -> DataFrame:
    j = F.to_json(F.struct(F.col("c_name").alias("id"), F.col("c_nationkey").alias("n")))
    return table(spark, sf, "customer").select("c_custkey", F.from_json(j, "id string, n bigint").alias("x")).select("c_custkey", "x.id", "x.n")


@query("events_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sentinel_filter", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 0 AND CAST(floor(p_retailprice) AS INT) <> 950")
def sentinel_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where((F.col("p_retailprice") >= 0) & (F.col("p_retailprice").cast("int") != 950)).select("p_partkey", "p_retailprice")


@query("mask_predicates", "SELECT o_orderkey FROM orders WHERE (o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%HIGH%') OR (o_totalprice BETWEEN 1000 AND 20000)")
def mask_predicates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    one = (d > F.lit("1996-01-01").cast("timestamp")) & (d <= F.lit("1999-12-31").cast("timestamp")) & F.col("o_orderstatus").isin("F", "O") & F.contains("o_orderpriority", F.lit("HIGH"))
    return table(spark, sf, "orders").where(one | F.col("o_totalprice").between(1000, 20000)).select("o_orderkey")


@query("density_cap", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal <= CASE c_mktsegment WHEN 'BUILDING' THEN 1511.0 WHEN 'AUTOMOBILE' THEN 713.0 WHEN 'MACHINERY' THEN 832.0 WHEN 'HOUSEHOLD' THEN 83.0 END")
def density_cap(spark: SparkSession, sf: str) -> DataFrame:
    caps = {"BUILDING": 1511.0, "AUTOMOBILE": 713.0, "MACHINERY": 832.0, "HOUSEHOLD": 83.0}
    return C.density_cap(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", caps).select("c_custkey", "c_mktsegment")


@query("side_by_side", "SELECT * FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey AS k, c_nationkey AS nation FROM customer) USING (k) FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) USING (k)")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n_events"))
    return C.side_by_side([orders, customers, events], ["k"])
