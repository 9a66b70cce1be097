"""Relational queries over the supplied tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal, vectors
from ..sources.tables import events_stream, table
from ..streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query of tables, and the SQL of the same rows if there is one."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def money(column: str):
    """Doubles as exact decimals, so that sums do not depend on the order of rows."""
    return F.col(column).cast("decimal(12,2)")


def cents(column: str):
    """The sum of doubles as exact hundredths in longs, which add up faster than wide decimals; an overflow is an error."""
    return (F.sum((F.col(column).cast("decimal(12,2)") * 100).cast("long")) / F.lit(100.0)).cast("double")


@register("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_price,
round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY ALL""")
def pricing_summary(t):
    return t("lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-01").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        cents("l_quantity").alias("sum_qty"), cents("l_extendedprice").alias("sum_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("""SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_inner(t):
    # Dimension rows are summed per customer first: one narrow row per customer enters the joins.
    spent = t("orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("total"), F.count("*").alias("n"))
    joined = spent.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"))


@register("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@register("""SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full(t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select(F.col("k").alias("nation"), F.coalesce("a", F.lit(0).cast("long")).alias("customers"), F.coalesce("b", F.lit(0).cast("long")).alias("suppliers"))


@register("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@register("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(t):
    return t("part").join(t("lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@register("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = (t("nation").alias(x) for x in ("a", "b"))
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@register("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem o WHERE l_quantity > 1.8 * (SELECT avg(l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey)")
def scalar_subquery(t):
    usual = t("lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("usual"))
    return t("lineitem").join(usual, "l_partkey").where(F.col("l_quantity") > 1.8 * F.col("usual")).select("l_orderkey", "l_partkey", "l_quantity")


@register("SELECT v.event_id, v.user_id, v.ts, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON v.user_id = p.user_id AND v.ts >= p.ts")
def join_asof(t):
    kind = lambda k: t("events").where(F.col("event_type") == k)
    left = kind("purchase").select("event_id", "user_id", "ts")
    return temporal.asof_join(left, kind("click").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "last_value").select("event_id", "user_id", "ts", "last_value")


@register("""WITH s AS (SELECT event_id, user_id, ts, ts + INTERVAL 2 HOUR AS e FROM events) SELECT x.event_id AS a, y.event_id AS b, x.user_id FROM s x JOIN s y
ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.ts < y.e AND y.ts < x.e""")
def interval_overlap(t):
    spans = t("events").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("e"))
    return temporal.overlaps(spans, "user_id", "ts", "e", "event_id", 7200)


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, no""")
def sessions(t):
    return temporal.sessions(t("events"), "user_id", "ts", "30 minutes")


@register("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY user_id, island HAVING count(*) >= 3""")
def day_runs(t):
    return temporal.day_runs(t("events"), "user_id", "ts", 3)


@register("""WITH a AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(e.ts) AS ts FROM events e JOIN a ON e.user_id = a.user_id AND e.ts > a.ts WHERE event_type = 'click' GROUP BY 1),
c AS (SELECT e.user_id, min(e.ts) AS ts FROM events e JOIN b ON e.user_id = b.user_id AND e.ts > b.ts WHERE event_type = 'purchase' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT u.user_id, CAST((a.ts IS NOT NULL)::INT + (b.ts IS NOT NULL)::INT + (c.ts IS NOT NULL)::INT AS INTEGER) AS reached FROM u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def funnel(t):
    return temporal.funnel(t("events"), "user_id", "ts", "event_type", ["view", "click", "purchase"])


@register("""WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b""")
def transitions(t):
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    return t("events").select(F.col("event_type").alias("a"), following.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@register("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY 1 HAVING count(*) > 100")
def group_distinct(t):
    return t("orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count("*").alias("n")).where("n > 100").drop("n")


@register("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t("orders").groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


@register("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@register("SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(t):
    wide = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "name", "amount")


@register("SELECT CAST(floor(value / 50) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(t):
    return t("events").groupBy(F.floor(F.col("value") / 50).alias("bin")).agg(F.count("*").alias("n"))


@register("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_list(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t("conversations").groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"))


@register("SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def argmax(t):
    return t("customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c_custkey"))


@register("""SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def window_ranks(t):
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(u).alias("q"))


@register("""SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hour FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_frames(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    hour = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
    return t("events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.max("value").over(w.rowsBetween(-3, 1)).alias("near"), hour.alias("hour"))


@register("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_per_group(t):
    best = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(best).alias("n")).where("n <= 3").drop("n")


@register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def top_k(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(10)


@register("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@register("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@register("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@register("""SELECT n_nationkey, upper(n_name) AS up, substr(n_name, 1, 3) AS start, replace(n_name, '_', '-') AS dashed, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS padded, reverse(n_name) AS back,
md5(n_name) AS digest FROM nation""")
def strings(t):
    name = F.col("n_name")
    return t("nation").select("n_nationkey", F.upper(name).alias("up"), F.substring(name, 1, 3).alias("start"), F.replace(name, F.lit("_"), F.lit("-")).alias("dashed"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("padded"), F.reverse(name).alias("back"), F.md5(name).alias("digest"))


@register("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' WHEN o_orderstatus LIKE 'F%' THEN 'done' ELSE 'wait' END AS state FROM orders")
def dates_and_cases(t):
    state = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "soon").when(F.col("o_orderstatus").like("F%"), "done").otherwise("wait")
    return t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), state.alias("state"))


@register("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@register("SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages")
def page_parts(t):
    return t("pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@register("""WITH v AS (SELECT q.vec_id AS query, e.vec_id AS id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INTEGER) AS place FROM v QUALIFY place <= 5""")
def nearest_vectors(t):
    return vectors.nearest(t("embeddings"), t("embeddings").where("vec_id % 100 = 0"), 5)


@register()
def approximate_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def _stream(name: str, make: Callable[[DataFrame], DataFrame], mode: str, sql: str | None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = windows.drained(make(events_stream(spark, folder)), mode)
        return out.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema if f.dataType.typeName() == "timestamp"})

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


#: In append mode a window comes out when the watermark, ten minutes behind the latest event, has passed its end.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_stream("stream_tumbling_append", windows.tumbling, "append", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING started + INTERVAL 1 HOUR <= {_CLOSED}")
_stream("stream_sliding_append", windows.sliding, "append", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * o AS started, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY 1, 2 HAVING started + INTERVAL 2 HOUR <= {_CLOSED}")
_stream("stream_sessions_append", windows.session_counts, "append", f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}")
_stream("stream_tumbling", windows.tumbling, "complete", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_stream("stream_sliding", windows.sliding, "complete", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * o AS started, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY 1, 2")
_stream("stream_sessions", windows.session_counts, "complete", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, no")
_stream("stream_interval_join", lambda e: windows.interval_join(e, "click", "purchase"), "append", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
_stream("stream_first_of_each", lambda e: windows.first_of_each(e, ["user_id"]).select("user_id"), "append", None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import formats, more, wider  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import formats, more, wider  # noqa: F401

    return dict(_SQL)
