"""Registered queries of the engine, by name, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import expr as e
from gridlark.functions import selectors as cs
from gridlark.operators.chart import ChartRequest, chart
from gridlark.operators.rows import frequent_values, page, sorted_page
from gridlark.operators.schema import column_stats, nearest_names
from gridlark.plans.frame import Frame, concat
from gridlark.plans.order import ORD, Ordered
from gridlark.plans.sql import SQLContext, run_sql, sql_on
from gridlark.session import configure
from gridlark.sources.read import read
from gridlark.streaming.windows import windowed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str, *order: str) -> Frame:
    return Frame(tab(spark, sf_dir, name), order)


# paging, sorting, values

query("rows_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 500")(
    lambda s, d: page(tab(s, d, "orders"), 500, 100, ["o_orderkey", "missing", "o_totalprice"]).drop(ORD)
)
for _desc, _name in ((True, "rows_sorted_desc"), (False, "rows_sorted_asc")):
    query(_name, f"SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal {'DESC' if _desc else 'ASC'} NULLS LAST, c_custkey LIMIT 50 OFFSET 20")(
        lambda s, d, desc=_desc: sorted_page(tab(s, d, "customer"), "c_acctbal", desc, 20, 50, ["c_custkey", "c_acctbal"], order=["c_custkey"]).drop("place")
    )
query("rows_sorted_window", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")(
    lambda s, d: sorted_page(tab(s, d, "orders"), "o_totalprice", True, 0, 40, ["o_orderkey", "o_totalprice"], max_rows=500).drop("place")
)
query("rows_sorted_mixed_text", "SELECT k, t FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS t FROM part) ORDER BY t = '', TRY_CAST(t AS DOUBLE) IS NULL, TRY_CAST(t AS DOUBLE), t, k LIMIT 200")(
    lambda s, d: sorted_page(tab(s, d, "part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS t"), "t", False, 0, 200, order=["k"]).drop("place")
)
for _t, _c, _name in (("customer", "c_mktsegment", "values_segment"), ("events", "event_type", "values_event_type"), ("customer", "c_name", "values_overflow_empty")):
    query(_name, f"SELECT value, n FROM (SELECT {_c} AS value, count(*) AS n, count(*) OVER () AS total FROM {_t} WHERE {_c} <> '' GROUP BY {_c}) WHERE total <= 50 ORDER BY n DESC, value")(
        lambda s, d, t=_t, c=_c: frequent_values(tab(s, d, t), c)
    )

# charts



def _ms(column: str, grain: str | None = None) -> str:
    """SQL for a time, or the start of its period, as epoch milliseconds."""
    return f"CAST(epoch_ms({column if grain is None else f'date_trunc({chr(39)}{grain}{chr(39)}, {column})'}) AS DOUBLE)"


def near(value):
    """Four places, a little off, since means of round numbers often fall just between two of them."""
    return F.round(value + 0.0000123, 4)


def points(spark: SparkSession, sf_dir: str, table_name: str, *columns: str, df: DataFrame | None = None, **request) -> DataFrame:
    c = chart(tab(spark, sf_dir, table_name) if df is None else df, ChartRequest(**request))
    return c.points.select(*[near(F.col(x)).alias(x) if x in ("x", "y") else F.col(x) for x in columns])


def _hist(table_name: str, column: str) -> str:
    return (
        f"WITH v AS (SELECT CAST({column} AS DOUBLE) v FROM {table_name}), r AS (SELECT min(v) a, (max(v) - min(v)) / 30 w FROM v), b AS (SELECT least(29, CAST(floor((v - a) / w) AS BIGINT)) i, count(*) n FROM v, r GROUP BY 1) "
        "SELECT round(a + (g.i + 0.5::DOUBLE) * w + 0.0000123, 4) AS x, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(30)) AS i) g CROSS JOIN r LEFT JOIN b ON g.i = b.i"
    )


query("chart_sum_by_month_split", f"SELECT l_returnflag AS series, {_ms('l_shipdate', 'month')} AS x, round(sum(l_extendedprice) + 0.0000123, 4) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: points(s, d, "lineitem", "series", "x", "y", "n", x="l_shipdate", y="l_extendedprice", agg="sum", grain="month", split="l_returnflag")
)
query("chart_histogram", _hist("lineitem", "l_extendedprice"))(lambda s, d: points(s, d, "lineitem", "x", "n", x="l_extendedprice"))
for _t, _c, _name in (("orders", "o_orderpriority", "chart_bar_counts"), ("part", "p_brand", "chart_bar_cap24"), ("nation", "n_name", "chart_bar_names")):
    query(_name, f"SELECT {_c} AS label, count(*) AS n FROM {_t} GROUP BY 1 ORDER BY n DESC, label LIMIT 24")(lambda s, d, t=_t, c=_c: points(s, d, t, "label", "n", x=c))
query("chart_bar_fewvalues", "SELECT count(*) AS n FROM lineitem GROUP BY l_discount")(lambda s, d: points(s, d, "lineitem", "n", x="l_discount"))
query("chart_bar_labels_cut", "SELECT left(c_mktsegment || ' customers of the nation ' || c_nationkey, 28) || CASE WHEN length(c_mktsegment || ' customers of the nation ' || c_nationkey) > 28 THEN '…' ELSE '' END AS label, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, label LIMIT 24")(
    lambda s, d: points(s, d, "", "label", "n", df=tab(s, d, "customer").selectExpr("c_mktsegment || ' customers of the nation ' || c_nationkey AS t"), x="t")
)
for _agg, _f in (("count", "count(*)"), ("sum", "sum(l_extendedprice)"), ("mean", "avg(l_extendedprice)"), ("median", "median(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)")):
    query(f"chart_bar_{_agg}", f"SELECT l_returnflag AS label, round(CAST({_f} AS DOUBLE) + 0.0000123, 4) AS y, count(*) AS n FROM lineitem GROUP BY 1")(
        lambda s, d, a=_agg: points(s, d, "lineitem", "label", "y", "n", x="l_returnflag", y="l_extendedprice", agg=a)
    )
_STRIDE = "SELECT x, y FROM (SELECT *, row_number() OVER (ORDER BY {o}) - 1 AS i, count(*) OVER () AS c FROM (SELECT {x} AS x, {y} AS y, {k} AS k FROM {t})) WHERE i % CAST(ceil(c / {m}::DOUBLE) AS BIGINT) = 0"
query("chart_line_raw", _STRIDE.format(x=_ms("o_orderdate"), y="o_totalprice", k="o_orderkey", t="orders", o="x, k", m=800))(
    lambda s, d: points(s, d, "orders", "x", "y", x="o_orderdate", y="o_totalprice", order=["o_orderkey"])
)
query("chart_scatter", _STRIDE.format(x="CAST(user_id AS DOUBLE)", y="round(value + 0.0000123, 4)", k="event_id", t="events", o="k", m=2000))(lambda s, d: points(s, d, "events", "x", "y", x="user_id", y="value", order=["event_id"]))
for _grain, _t, _x, _y in (("year", "orders", "o_orderdate", "o_totalprice"), ("quarter", "orders", "o_orderdate", "o_totalprice"), ("month", "orders", "o_orderdate", "o_totalprice"), ("week", "events", "ts", "value"), ("day", "events", "ts", "value")):
    query(f"chart_grain_{_grain}", f"SELECT {_ms(_x, _grain)} AS x, round(avg({_y}) + 0.0000123, 4) AS y, count(*) AS n FROM {_t} GROUP BY 1")(
        lambda s, d, g=_grain, t=_t, x=_x, y=_y: points(s, d, t, "x", "y", "n", x=x, y=y, grain=g)
    )
_BUCKETS = "WITH v AS (SELECT {x} AS x, {s} AS s, CAST({y} AS DOUBLE) AS y FROM {t}), r AS (SELECT min(x) a, (max(x) - min(x)) / 30 w FROM v) SELECT s AS series, round(a + (least(29, floor((x - a) / w)) + 0.5::DOUBLE) * w + 0.0000123, 4) AS x, round({f} + 0.0000123, 4) AS y, count(*) AS n FROM v, r GROUP BY 1, 2"
for _grain in ("hour", "minute", "second"):
    query(f"chart_grain_{_grain}_bucketed", _BUCKETS.format(x=_ms('ts', _grain), s="CAST(NULL AS VARCHAR)", y="value", t="events", f="avg(y)"))(
        lambda s, d, g=_grain: points(s, d, "events", "series", "x", "y", "n", x="ts", y="value", grain=g)
    )
query("chart_split_lines", f"SELECT o_orderstatus AS series, {_ms('o_orderdate', 'year')} AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2")(
    lambda s, d: points(s, d, "orders", "series", "x", "y", x="o_orderdate", grain="year", split="o_orderstatus")
)
query("chart_split_buckets", _BUCKETS.format(x=_ms("o_orderdate"), s="o_orderstatus", y="o_totalprice", t="orders", f="sum(y)"))(
    lambda s, d: points(s, d, "orders", "series", "x", "y", "n", x="o_orderdate", y="o_totalprice", agg="sum", split="o_orderstatus")
)
query("chart_dodged_bars", "SELECT l_returnflag AS label, l_linestatus AS series, round(avg(l_quantity) + 0.0000123, 4) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: points(s, d, "lineitem", "label", "series", "y", "n", x="l_returnflag", y="l_quantity", split="l_linestatus")
)
query("chart_split_histogram", "WITH r AS (SELECT min(l_extendedprice) a, (max(l_extendedprice) - min(l_extendedprice)) / 30 w FROM lineitem), b AS (SELECT l_returnflag s, least(29, CAST(floor((l_extendedprice - a) / w) AS BIGINT)) i, count(*) n FROM lineitem, r GROUP BY 1, 2) SELECT f.s AS series, round(a + (g.i + 0.5::DOUBLE) * w + 0.0000123, 4) AS x, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT l_returnflag AS s FROM lineitem) f CROSS JOIN (SELECT unnest(range(30)) AS i) g CROSS JOIN r LEFT JOIN b ON g.i = b.i AND f.s = b.s")(
    lambda s, d: points(s, d, "lineitem", "series", "x", "n", x="l_extendedprice", split="l_returnflag")
)
query("chart_split_scatter", _STRIDE.replace("SELECT x, y FROM", "SELECT series, x, y FROM").format(x="CAST(user_id AS DOUBLE)", y="round(value + 0.0000123, 4)", k="event_type AS series, event_id", t="events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 6)", o="k", m=2000))(
    lambda s, d: points(s, d, "events", "series", "x", "y", x="user_id", y="value", split="event_type", order=["event_id"])
)
query("chart_split_cap6", "SELECT lang AS label, source AS series, CAST(count(*) AS DOUBLE) AS y FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 6) GROUP BY 1, 2")(
    lambda s, d: points(s, d, "documents", "label", "series", "y", x="lang", split="source")
)
query("chart_text_dates", f"SELECT {_ms('o_orderdate', 'month')} AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1")(
    lambda s, d: points(s, d, "", "x", "y", df=tab(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), x="day", grain="month")
)

# schemas

query("stats_orders", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")(lambda s, d: column_stats(tab(s, d, "orders")).select("column", "nulls"))
query("stats_minmax_part", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_size")))(
    lambda s, d: column_stats(tab(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")).select("column", "min", "max")
)
_KNOWN, _TYPED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_custky", "C_NAME", "c_acct", "nationkey", "zzz", "c_mktsegmnt"]
query("nearest_columns", f"SELECT name, suggestion, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, suggestion) AS place FROM (SELECT n AS name, k AS suggestion, levenshtein(lower(n), lower(k)) AS distance FROM (SELECT unnest({_TYPED}) AS n), (SELECT unnest({_KNOWN}) AS k) WHERE abs(length(n) - length(k)) <= 8) WHERE distance <= greatest(1, length(name) // 3 + 1)) WHERE place <= 3")(
    lambda s, d: nearest_names(s.createDataFrame([(x,) for x in _TYPED], "n string"), s.createDataFrame([(x,) for x in _KNOWN], "k string")).select("name", "suggestion", F.col("place").cast("bigint").alias("place"))
)

# frames

c = e.col
query("select_named", "SELECT p_name, p_retailprice * 2 AS double_price FROM part")(lambda s, d: frame(s, d, "part").select("p_name", double_price=c("p_retailprice") * 2).df)
query("with_columns_replace", "SELECT p_partkey, upper(p_name) AS p_name, p_size + 1 AS bigger FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", "p_name", "p_size").with_columns(c("p_name").str.to_uppercase(), bigger=c("p_size") + 1).drop("p_size").df)
query("drop_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")(lambda s, d: frame(s, d, "orders").drop("o_totalprice", "absent", columns="o_orderpriority").df)
query("rename_cols", "SELECT r_regionkey AS id, r_name AS region FROM region")(lambda s, d: frame(s, d, "region").rename({"r_regionkey": "id", "r_name": "region", "no": "x"}).df)
query("row_index", 'SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "index", o_orderkey FROM orders')(lambda s, d: frame(s, d, "orders", "o_orderkey").with_row_index().select("index", "o_orderkey").df)
query("row_index_files", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer")(lambda s, d: Frame.from_files(tab(s, d, "customer")).with_row_index("i").select("i", "c_custkey").df)
query("unpivot_prices", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")(lambda s, d: frame(s, d, "part").with_columns(c("p_size").cast("f64")).unpivot(["p_size", "p_retailprice"], ["p_partkey"]).df)
query("transpose_named", "SELECT 'key' AS \"column\", '0' AS a, '1' AS b, '2' AS c, '3' AS d, '4' AS e UNION ALL SELECT 'r_name', " + ", ".join(f"max(CASE WHEN r_regionkey = {i} THEN r_name END)" for i in range(5)) + " FROM region")(
    lambda s, d: Frame(tab(s, d, "region").select(F.col("r_regionkey").cast("string").alias("key"), "r_name", F.col("r_regionkey").alias(ORD)), (ORD,)).transpose(["a", "b", "c", "d", "e"], include_header=True).df
)
query("unnest_struct", "SELECT c_custkey, c_name AS name, c_acctbal AS bal, c_mktsegment FROM customer")(lambda s, d: frame(s, d, "customer").select("c_custkey", e.struct(c("c_name").alias("name"), c("c_acctbal").alias("bal")).alias("who"), "c_mktsegment").unnest("who").df)
query("struct_field", "SELECT c_custkey, c_name AS name FROM customer")(lambda s, d: frame(s, d, "customer").select("c_custkey", e.struct(c("c_name").alias("name"), c("c_acctbal").alias("bal")).struct.field("name")).df)
query("explode_split", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", c("p_name").str.split(" ").alias("word")).explode("word").df)
query("subscript_list", "SELECT n_name, n_regionkey FROM nation")(lambda s, d: frame(s, d, "nation")[["n_name", "n_regionkey"]].df)
query("filter_constraint", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")(lambda s, d: frame(s, d, "orders").filter(c("o_totalprice") > 1000, o_orderstatus="F").select("o_orderkey").df)
query("remove_rows", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'O') = 'F', false)")(lambda s, d: Frame(tab(s, d, "orders").withColumn("st", F.nullif("o_orderstatus", F.lit("O")))).remove(c("st") == "F").select("o_orderkey").df)
query("query_text", "SELECT o_orderkey FROM orders WHERE o_totalprice > 2000 AND NOT o_orderstatus = 'O'")(lambda s, d: frame(s, d, "orders").query("o_totalprice > 2000 and not o_orderstatus == 'O'").select("o_orderkey").df)
query("clear_rows", "SELECT r_name FROM region WHERE false")(lambda s, d: frame(s, d, "region").clear().select("r_name").df)
query("where_mask", "SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_acctbal > 0 THEN c_custkey END AS c_custkey FROM customer")(lambda s, d: frame(s, d, "customer").select("c_acctbal", "c_custkey").mask(c("c_acctbal") <= 0).df)
query("cast_cols", "SELECT CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")(lambda s, d: frame(s, d, "part").select("p_size", "p_partkey").cast({"p_size": "f64", "p_partkey": "str"}).df)
query("unique_subset", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: frame(s, d, "orders", "o_orderkey").unique("o_custkey").select("o_custkey", "o_orderkey").df)
query("duplicated_flags", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS duplicated FROM orders")(lambda s, d: frame(s, d, "orders").duplicated(["o_custkey"]).select("o_orderkey", "duplicated").df)
_HOLES = "CASE WHEN event_id % 3 = 0 THEN value END AS v"


def _holes(s: SparkSession, d: str, extra: str = "user_id") -> Frame:
    return Frame(tab(s, d, "events").selectExpr("event_id", extra, _HOLES), ("event_id",))


query("fill_null_vals", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, -1.0::DOUBLE) AS v FROM events")(lambda s, d: _holes(s, d).fill_null(-1).select("event_id", "v").df)
query("drop_nulls_rows", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL")(lambda s, d: _holes(s, d).drop_nulls(["v"]).select("event_id").df)
query("ffill_vals", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM (SELECT event_id, {_HOLES} FROM events)")(lambda s, d: _holes(s, d).ffill("v").select("event_id", "v").df)
query("bfill_vals", f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, {_HOLES} FROM events)")(lambda s, d: _holes(s, d).bfill("v").select("event_id", "v").df)
query("interpolate_vals", f"WITH h AS (SELECT event_id, {_HOLES}, row_number() OVER (ORDER BY event_id) AS i FROM events), p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i) AS a, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h) SELECT p.event_id, round(coalesce(p.v, x.v + (y.v - x.v) * (p.i - p.a) / (p.b - p.a)), 6) AS v FROM p LEFT JOIN h x ON x.i = p.a LEFT JOIN h y ON y.i = p.b")(
    lambda s, d: Frame(_holes(s, d).interpolate("v").select("event_id", "v").df.select("event_id", F.round("v", 6).alias("v"))).df
)
query("shift_rows", "SELECT o_orderkey, lag(o_totalprice, 2) OVER (ORDER BY o_orderkey) AS o_totalprice FROM orders")(
    lambda s, d: Ordered(tab(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).shift(["o_totalprice"], 2, "_was").select("o_orderkey", F.col("o_totalprice_was").alias("o_totalprice"))
)
query("reverse_head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")(lambda s, d: frame(s, d, "orders", "o_orderkey").tail(25).select("o_orderkey").df)
query("slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 77")(lambda s, d: frame(s, d, "orders", "o_orderkey").slice(77, 30).select("o_orderkey").df)
query("gather_rows", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 5, 42, 300)")(lambda s, d: frame(s, d, "orders", "o_orderkey").gather([0, 5, 42, 300]).select("o_orderkey").df)
query("round_abs", "SELECT c_custkey, round(abs(c_acctbal), 1) AS c_acctbal FROM customer")(lambda s, d: frame(s, d, "customer").select("c_custkey", "c_acctbal").abs().round(1).df)
query("reindex_rows", "SELECT k AS n_nationkey, n_name FROM (SELECT unnest([1, 3, 99]) AS k) LEFT JOIN nation ON n_nationkey = k")(lambda s, d: frame(s, d, "nation").select("n_nationkey", "n_name").reindex(Frame(s.createDataFrame([(1,), (3,), (99,)], "n_nationkey int")), "n_nationkey").df)

# joins

_CUST = "c_custkey, c_name, c_nationkey"
query("join_inner_suffix", "SELECT a.r_regionkey, a.r_name, b.r_name AS r_name_right FROM region a JOIN region b USING (r_regionkey)")(lambda s, d: frame(s, d, "region").join(frame(s, d, "region"), on="r_regionkey").df)
query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")(lambda s, d: frame(s, d, "customer").join(frame(s, d, "orders"), left_on="c_custkey", right_on="o_custkey", how="left").select("c_custkey", "o_orderkey").df)
query("join_right", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey")(lambda s, d: frame(s, d, "customer").join(frame(s, d, "orders"), left_on="c_custkey", right_on="o_custkey", how="right").select("c_custkey", "o_orderkey").df)
query("join_full", "SELECT k, a.v AS v, b.v AS v_right FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) b USING (k)")(
    lambda s, d: Frame(tab(s, d, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")).join(Frame(tab(s, d, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS v")), on="k", how="outer").df
)
query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")(lambda s, d: frame(s, d, "region").join(frame(s, d, "nation"), how="cross").select("r_name", "n_name").df)
query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda s, d: frame(s, d, "customer").join(frame(s, d, "orders"), left_on="c_custkey", right_on="o_custkey", how="semi").select("c_custkey").df)
query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: frame(s, d, "customer").join(frame(s, d, "orders"), left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey").df)
query("merge_y", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_y FROM nation a JOIN nation b USING (n_nationkey)")(lambda s, d: frame(s, d, "nation").select("n_nationkey", "n_name").merge(frame(s, d, "nation").select("n_nationkey", "n_name"), on="n_nationkey").df)
query("join_asof_events", "SELECT a.event_id, b.o_orderkey FROM events a ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) b ON a.user_id = b.o_custkey AND a.ts >= b.o_orderdate")(
    lambda s, d: frame(s, d, "events").select("event_id", "user_id", "ts").join_asof(Frame(tab(s, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))), left_on="ts", right_on="o_orderdate", by_left="user_id", by_right="o_custkey").select("event_id", "o_orderkey").df
)

# aggregates

query("group_agg_multi", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, round(avg(l_discount), 6) AS l_discount, count(*) AS len, count(DISTINCT l_suppkey) AS l_suppkey, round(stddev_samp(l_tax), 6) AS sd FROM lineitem GROUP BY 1, 2")(
    lambda s, d: frame(s, d, "lineitem").group_by("l_returnflag", "l_linestatus").agg(c("l_discount").mean().round(6), e.len_(), c("l_suppkey").n_unique(), qty=c("l_quantity").sum(), sd=c("l_tax").std().round(6)).df
)
query("agg_global", "SELECT max(o_totalprice) AS o_totalprice, min(o_orderdate) AS first_day FROM orders")(lambda s, d: frame(s, d, "orders").agg(c("o_totalprice").max(), first_day=c("o_orderdate").min()).df)
query("frame_reducers", "SELECT median(l_quantity) AS l_quantity, median(l_linenumber)::DOUBLE AS l_linenumber FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select("l_quantity", "l_linenumber").median().df)
query("frame_null_count", "SELECT count(*) FILTER (v IS NULL) AS v, 0::BIGINT AS event_id FROM (SELECT event_id, " + _HOLES + " FROM events)")(lambda s, d: _holes(s, d).select("v", "event_id").null_count().df)
query("quantile_mode", "SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q, min(p_size) AS p_size FROM (SELECT * FROM part) GROUP BY 1")(lambda s, d: frame(s, d, "part").group_by("p_brand").agg(c("p_size").min(), q=c("p_retailprice").quantile(0.25)).df)
query("agg_first_last", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")(lambda s, d: frame(s, d, "orders", "o_orderkey").group_by("o_custkey").agg(first_price=c("o_totalprice").first(), last_price=c("o_totalprice").last()).df)
query("agg_mode", "WITH t AS (SELECT l_returnflag AS f, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT f, max(n) AS n FROM t GROUP BY 1) SELECT t.f AS l_returnflag, min(t.v) AS l_linenumber FROM t JOIN m ON t.f = m.f AND t.n = m.n GROUP BY 1")(lambda s, d: frame(s, d, "lineitem").group_by("l_returnflag").agg(c("l_linenumber").mode()).df)
query("implode_lists", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")(lambda s, d: Frame(frame(s, d, "orders", "o_orderkey").group_by("o_custkey").agg(keys=c("o_orderkey").implode()).df.select("o_custkey", F.array_join("keys", ",").alias("keys"))).df)
query("value_counts", 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1')(lambda s, d: frame(s, d, "orders").value_counts("o_orderpriority").df)
query("sql_fragments", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: frame(s, d, "orders").aggregate("count(*) AS n", "o_orderstatus").df)

# windows

query("window_over", "SELECT l_orderkey, l_linenumber, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", total=c("l_quantity").sum().over("l_orderkey")).df)
_W = "OVER (PARTITION BY user_id ORDER BY event_id{})"
query("window_cum_sum", f"SELECT event_id, round(sum(value) {_W.format(' ROWS UNBOUNDED PRECEDING')}, 4) AS run, count(value) {_W.format(' ROWS UNBOUNDED PRECEDING')} AS seen, max(value) {_W.format(' ROWS UNBOUNDED PRECEDING')} AS top FROM events")(
    lambda s, d: frame(s, d, "events", "event_id").select("event_id", run=c("value").cum_sum().over("user_id"), seen=c("value").cum_count().over("user_id"), top=c("value").cum_max().over("user_id")).with_columns(run=c("run").round(4)).df
)
query("cum_sum_whole", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey) AS DOUBLE) AS run FROM orders")(
    lambda s, d: Ordered(tab(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p")), ["o_orderkey"], rows=4000).cumulative("p", "sum", "run").select("o_orderkey", F.col("run").cast("double").alias("run"))
)
query("window_rank_avg", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", rank=c("p_size").rank().over("p_brand")).df)
query("window_diff", f"SELECT event_id, round(value - lag(value) {_W.format('')}, 6) AS diff, lag(value, 2) {_W.format('')} AS two FROM events")(lambda s, d: frame(s, d, "events", "event_id").select("event_id", diff=c("value").diff().over("user_id"), two=c("value").shift(2).over("user_id")).with_columns(diff=c("diff").round(6)).df)
query("window_fill", f"SELECT event_id, last_value(v IGNORE NULLS) {_W.format('')} AS f FROM (SELECT event_id, user_id, {_HOLES} FROM events)")(lambda s, d: _holes(s, d).select("event_id", f=c("v").forward_fill().over("user_id")).df)

# order and limits

query("sort_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")(lambda s, d: Frame(frame(s, d, "orders", "o_orderkey").sort("o_orderstatus", "o_totalprice", descending=[True, False]).df).select("o_orderkey").df)
query("top_k_price", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: frame(s, d, "orders", "o_orderkey").top_k(20, by="o_totalprice").select("o_orderkey", "o_totalprice").df)
query("bottom_k_price", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")(lambda s, d: frame(s, d, "orders", "o_orderkey").bottom_k(20, by="o_totalprice").select("o_orderkey", "o_totalprice").df)
query("nlargest_price", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 15")(lambda s, d: frame(s, d, "part", "p_partkey").nlargest(15, ["p_retailprice", "p_size"]).select("p_partkey").df)
query("concat_parts", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 3000")(lambda s, d: concat([frame(s, d, "orders").filter(o_orderstatus="F").select("o_orderkey"), frame(s, d, "orders").filter(c("o_totalprice") > 3000).select("o_orderkey")]).df)

# scalars and selectors

query("expr_arithmetic", "SELECT l_extendedprice * (1 - l_discount) AS l_extendedprice, l_quantity > 25 AS big, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select(c("l_extendedprice") * (1 - c("l_discount")), big=c("l_quantity") > 25, ratio=(c("l_tax") / c("l_discount")).round(6)).df)
query("expr_scalars", "SELECT p_partkey, least(greatest(p_size, 10), 40) AS p_size, floor(p_retailprice)::BIGINT AS down, ceil(p_retailprice)::BIGINT AS up, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS nat FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", c("p_size").clip(10, 40), down=c("p_retailprice").floor(), up=c("p_retailprice").ceil(), root=c("p_retailprice").sqrt().round(6), nat=c("p_retailprice").log().round(6)).df)
query("expr_tests", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS fo, o_totalprice BETWEEN 1000 AND 2000 AS mid, o_orderpriority LIKE '1%' AS urgent, regexp_matches(o_orderpriority, '^[12]') AS high, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS same FROM orders")(
    lambda s, d: Frame(tab(s, d, "orders").withColumn("st", F.nullif("o_orderstatus", F.lit("F")))).select("o_orderkey", fo=c("o_orderstatus").is_in(["F", "O"]), mid=c("o_totalprice").is_between(1000, 2000), urgent=c("o_orderpriority").str.starts_with("1"), high=c("o_orderpriority").str.contains("^[12]"), same=c("st").eq_missing("O")).df
)
query("expr_text", "SELECT upper(c_name) AS c_name, c_mktsegment || '-' || c_nationkey AS tag, contains(c_name, '1') AS one, length(c_name) AS n FROM customer")(lambda s, d: frame(s, d, "customer").select(c("c_name").str.to_uppercase(), tag=e.concat_str("c_mktsegment", "c_nationkey", separator="-"), one=c("c_name").str.contains("1", literal=True), n=c("c_name").str.len_chars().cast("i64")).df)
query("expr_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, isodow(o_orderdate)::INT AS wd, date_trunc('month', o_orderdate)::TIMESTAMP AS t FROM orders")(lambda s, d: frame(s, d, "orders").select("o_orderkey", y=c("o_orderdate").dt.year(), m=c("o_orderdate").dt.month(), wd=c("o_orderdate").dt.weekday(), t=c("o_orderdate").dt.truncate("month")).df)
query("expr_when", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 20 THEN 'M' ELSE 'S' END AS literal FROM part")(lambda s, d: frame(s, d, "part").select("p_partkey", e.when(c("p_size") > 40).then("L").when(c("p_size") > 20).then("M").otherwise("S")).df)
query("expr_coalesce_format", "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, c_name || ':' || c_custkey AS c_name FROM customer")(lambda s, d: Frame(tab(s, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))).select(e.coalesce("seg", e.lit("none")), e.format_("{}:{}", "c_name", "c_custkey")).df)
query("name_suffixes", "SELECT r_regionkey AS r_regionkey_x, r_name AS r_name_x FROM region")(lambda s, d: frame(s, d, "region").select(e.all_().name.suffix("_x")).df)
query("regex_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")(lambda s, d: frame(s, d, "orders").select(c("^o_order.*$")).df)
query("selectors_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select(cs.numeric()).df)
query("selectors_algebra", "SELECT l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")(lambda s, d: frame(s, d, "lineitem").select((cs.string() | cs.temporal() | cs.by_name("l_extendedprice", "l_tax")) - cs.ends_with("tax")).df)

# SQL

query("sql_self", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: sql_on(frame(s, d, "lineitem"), "SELECT l_returnflag, count(*) AS n FROM SELF GROUP BY 1").df)
query("sql_context", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")(lambda s, d: SQLContext(s, nat=frame(s, d, "nation")).register("cust", frame(s, d, "customer")).execute("SELECT n_name, count(*) AS n FROM nat JOIN cust ON n_nationkey = c_nationkey GROUP BY 1").df)
query("sql_path", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")(lambda s, d: run_sql(s, f"SELECT r.r_name, n_name FROM '{d}/region.parquet' AS r JOIN read_parquet('{d}/nation.parquet') n ON r_regionkey = n_regionkey -- FROM 'x.csv'").df if "://" not in d else tab(s, d, "region").join(tab(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name"))

# reshaping and time

query("pivot_sum", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS \"O\" FROM lineitem GROUP BY 1")(lambda s, d: frame(s, d, "lineitem").pivot("l_linestatus", "l_returnflag", "l_quantity", "sum").df)
query("crosstab_counts", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")(lambda s, d: frame(s, d, "lineitem").crosstab("l_returnflag", "l_linestatus").df)
query("to_dummies", "SELECT o_orderkey, (o_orderstatus = 'F')::TINYINT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::TINYINT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::TINYINT AS \"o_orderstatus_P\" FROM orders")(lambda s, d: frame(s, d, "orders").select("o_orderkey", "o_orderstatus").to_dummies("o_orderstatus").df)
query("partition_frames", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: concat([f.group_by("o_orderstatus").agg(n=e.len_()) for f in frame(s, d, "orders").partition_by("o_orderstatus").values()]).df)
query("dynamic_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS ts, count(*) AS len FROM events GROUP BY 1")(lambda s, d: frame(s, d, "events").group_by_dynamic("ts", "6h").agg(e.len_()).df)
query("dynamic_week", "SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS ts, max(value) AS value FROM events GROUP BY 1, 2")(lambda s, d: frame(s, d, "events").group_by_dynamic("ts", "1w", by="event_type").agg(c("value").max()).df)
query("rolling_sum", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM events")(lambda s, d: frame(s, d, "events").rolling("ts", "1d", by="user_id", n=F.count("*")).select("event_id", "n").df)
query("upsample_days", "WITH t AS (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT g.day::TIMESTAMP AS day, n FROM (SELECT unnest(generate_series((SELECT min(day) FROM t), (SELECT max(day) FROM t), INTERVAL 1 DAY)) AS day) g LEFT JOIN t ON g.day = t.day")(
    lambda s, d: Frame(tab(s, d, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))).upsample("day", "1d").df
)
query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: windowed(tab(s, d, "events"), "ts", "1 hour", "2 hours", F.count("*").alias("n"), by=("event_type",)))

__all__ = ["oracle_sql", "queries", "read"]
