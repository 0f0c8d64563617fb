"""User SQL: one statement per category, run through the console."""

from pyspark.sql import functions as F

from loam.catalogue import query
from loam.operators.console import Console
from loam.operators.sketches import DailySketches
from loam.plans.intervals import interval_totals
from loam.session import scratch
from loam.sources.tables import TABLES, parquet_table


def statement(name: str, text: str, oracle: str | None = None):
    """Register a statement; `oracle` is its wording for the comparison engine where it differs."""
    folder_tables = lambda folder: lambda session: {
        table: parquet_table(session, folder, table) for table in TABLES}

    @query(name, oracle or text)
    def build(t):
        return Console(t.spark, 0, folder_tables(t.folder)).query(text)
    return build


statement("sql1_join_group_topk", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")

statement("sql2_outer_joins", """
SELECT c.c_custkey, f.n AS f_orders, o.n AS o_orders FROM customer c
FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")

statement("sql2_right_join", """
SELECT s.s_suppkey, n.n_nationkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey""")

statement("sql3_semi_anti", """
SELECT c_custkey, 'urgent' AS kind FROM customer WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
UNION ALL SELECT c_custkey, 'calm' FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")

_BANDS = """SELECT 'low' AS band, 0 AS lo, 20 AS hi UNION ALL SELECT 'mid', 20, 60 UNION ALL SELECT 'high', 60, 1000000"""
statement("sql4_range_join", f"""
SELECT b.band, count(*) AS n, round(sum(e.value), 3) AS total FROM events e JOIN ({_BANDS}) b
ON e.value >= b.lo AND e.value < b.hi GROUP BY b.band""")


_HELD = """SELECT o_orderkey, o_orderpriority, o_totalprice / 1000e0 AS lo, o_totalprice / 1000e0
  + CASE WHEN o_orderkey % 1000 = 0 THEN 100e0 ELSE (o_custkey % 40) / 1000e0 END AS hi FROM orders"""


@query("sql4_many_bands", f"""
SELECT o_orderpriority, event_type, count(*) AS n, count(DISTINCT o_orderkey) AS bands, round(sum(value), 3) AS total
FROM events JOIN ({_HELD}) b ON value >= lo AND value < hi GROUP BY o_orderpriority, event_type""")
def many_bands(t):
    """Events in one band for every order, narrow and wide ones, without a nested loop and without listing the pairs."""
    start = F.col("o_totalprice") / F.lit(1000.0)
    width = F.when(F.col("o_orderkey") % 1000 == 0, 100.0).otherwise((F.col("o_custkey") % 40) / F.lit(1000.0))
    bands = t.table("orders").select("o_orderkey", "o_orderpriority", start.alias("lo"), (start + width).alias("hi"))
    events = t.table("events").select("event_type", "value")
    found = interval_totals(events, "value", "event_type", bands, "lo", "hi", "o_orderpriority", "o_orderkey")
    return found.select("o_orderpriority", "event_type", "n", F.col("names").alias("bands"), F.round("total", 3).alias("total"))


statement("sql5_grouping_sets", """
SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)) AS quantity, count(*) AS n, 'cube' AS kind
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)), count(*), 'rollup'
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT)), count(*), 'sets'
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""", """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n, 'cube' AS kind
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), count(*), 'rollup'
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), count(*), 'sets'
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")

statement("sql6_distinct_filtered", """
SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high,
  round(sum(value) FILTER (WHERE user_id < 10), 3) AS early FROM events GROUP BY event_type""")

statement("sql7_approximate", """
WITH a AS (SELECT event_type, approx_count_distinct(user_id) AS users, approx_percentile(value, 0.5) AS median
  FROM events GROUP BY event_type)
SELECT e.event_type, count(*) AS n,
  abs(max(a.users) - count(DISTINCT e.user_id)) <= 0.2 * count(DISTINCT e.user_id) AS users_close,
  avg(CASE WHEN e.value <= a.median THEN 1 ELSE 0 END) BETWEEN 0.45 AND 0.55 AS median_close
FROM events e JOIN a ON e.event_type = a.event_type GROUP BY e.event_type""", """
SELECT event_type, count(*) AS n, TRUE AS users_close, TRUE AS median_close FROM events GROUP BY event_type""")


@query("sql7_stored_sketches", """
SELECT event_type, date_trunc('month', ts)::DATE AS month, count(*) AS n, TRUE AS users_close, TRUE AS quartiles_close
FROM events GROUP BY 1, 2""")
def stored_sketches(t):
    """Users and quartiles per type and month from sketches stored by day, held against the rows.

    The bounds are four deviations of the distinct sketch (and one user), and 3% of rank.
    """
    events = t.table("events").select("event_type", "ts", "user_id", "value")
    kept = DailySketches(t.spark, scratch(t.spark, "sql7"), ["event_type"], ["user_id"], ["value"])
    kept.refresh(events, "ts")
    month = F.trunc("day", "month").alias("month")
    told = kept.estimates(["event_type", month], [0.25, 0.5, 0.75]).select(
        "event_type", "month", F.col("n").alias("told_n"), "user_id_distinct", "value_at")
    rows = events.withColumn("month", F.trunc("ts", "month")).join(told, ["event_type", "month"])
    below = lambda i: F.avg((F.col("value") < F.col("value_at")[i]).cast("int"))
    up_to = lambda i: F.avg((F.col("value") <= F.col("value_at")[i]).cast("int"))
    held = F.lit(True)
    for i, rank in enumerate((0.25, 0.5, 0.75)):
        # one row more or less decides in a small month
        slack = F.lit(0.03) + 1 / F.count(F.lit(1))
        held &= (below(i) <= rank + slack) & (up_to(i) >= rank - slack)
    users = F.count_distinct("user_id")
    return rows.groupBy("event_type", "month").agg(
        F.max("told_n").alias("n"), (F.abs(F.max("user_id_distinct") - users) <= 1 + 0.065 * users).alias("users_close"),
        held.alias("quartiles_close"))


statement("sql8_ranking", """
SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, rank() OVER d AS rk, dense_rank() OVER d AS dr, ntile(4) OVER w AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey),
  d AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")

statement("sql9_analytic", """
SELECT event_id, user_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after,
  first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

statement("sql10_frames", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM events""")

statement("sql11_set_operations", """
SELECT n_nationkey AS k, 'union' AS kind FROM nation UNION SELECT s_nationkey, 'union' FROM supplier
UNION ALL (SELECT c_nationkey, 'intersect' FROM customer INTERSECT SELECT s_nationkey, 'intersect' FROM supplier)
UNION ALL (SELECT n_nationkey, 'except' FROM nation EXCEPT SELECT s_nationkey, 'except' FROM supplier)""")

statement("sql12_subqueries", """
WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, o.o_custkey, t.total > (SELECT avg(total) FROM totals) AS big_customer FROM orders o
JOIN totals t ON o.o_custkey = t.o_custkey
WHERE o.o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")

statement("sql13_json", """
SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total,
  max(from_json(props, 'k INT').k) AS highest FROM events GROUP BY event_type""", """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
  max(CAST(json_extract_string(props, '$.k') AS INT)) AS highest FROM events GROUP BY event_type""")

statement("sql14_dates", """
SELECT date_trunc('day', ts) AS day, extract(HOUR FROM ts) AS hour, count(*) AS n,
  max(ts + INTERVAL 1 DAY) AS next_day FROM events GROUP BY 1, 2""", """
SELECT date_trunc('day', ts) AS day, extract(HOUR FROM ts) AS hour, count(*) AS n,
  max(ts + INTERVAL 1 DAY) AS next_day FROM events GROUP BY 1, 2""")

statement("sql15_arrays", """
SELECT vec_id, size(embedding) AS dims, size(filter(embedding, x -> x > 0)) AS positive,
  round(sqrt(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x)), 5) AS norm
FROM embeddings""", """
SELECT vec_id, CAST(len(embedding) AS INT) AS dims, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive,
  round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm FROM embeddings""")

statement("sql15_explode", """
SELECT label, pos, count(*) AS n, round(sum(v), 3) AS total FROM (
  SELECT label, posexplode(embedding) AS (pos, v) FROM embeddings) x GROUP BY label, pos""", """
SELECT label, CAST(pos - 1 AS INT) AS pos, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 3) AS total FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) x GROUP BY label, pos""")

statement("sql16_conditionals", """
SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band,
  coalesce(nullif(event_type, 'error'), 'none') AS kind, nullif(user_id, 0) AS user_id FROM events""")
