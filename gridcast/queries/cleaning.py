from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import columns as C
from gridcast.operators.rank import first_rows, last_rows
from gridcast.queries.registry import SPAN, daily_users, days_of, query, readings, rnd, table, tidy


def _deviations(spark, sf):
    """Events with a signed measure, missing where it is exactly 0."""
    e = table(spark, sf, "events")
    d = F.col("value") - 50
    return e.select("event_id", F.when(F.abs(d) > 1, d).alias("a"), F.when(d > 0, d).otherwise(float("nan")).alias("b"))


@query(
    "clip_fill",
    f"""WITH d AS (SELECT event_id, CASE WHEN abs(value - 50) > 1 THEN value - 50 END a,
  CASE WHEN value - 50 > 0 THEN value - 50 END b FROM events)
SELECT event_id, {rnd('coalesce(CASE WHEN a < 0 THEN 0 ELSE a END, 0)')} AS a, {rnd('coalesce(b, 0)')} AS b,
  {rnd('CASE WHEN a < 0 THEN 0 ELSE a END')} AS clipped FROM d""",
)
def clip_fill(spark, sf):
    rows = _deviations(spark, sf).withColumn("clipped", F.col("a"))
    return tidy(C.fill_missing(C.clip_negatives(rows, ["a", "clipped"]), ["a", "b"]))


@query(
    "threshold_zero",
    f"""SELECT event_id, {rnd('CASE WHEN value - 10 < 0.01 THEN 0 ELSE value - 10 END')} AS value FROM events""",
)
def threshold_zero(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") - 10).alias("value"))
    return tidy(C.threshold_to_zero(rows, ["value"]))


@query(
    "slice_inclusive",
    """SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'""",
)
def slice_inclusive(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return C.slice_inclusive(rows, "1996-01-01 00:00:00", "1996-12-31 00:00:00")


@query(
    "slice_whole_days",
    """SELECT event_id, ts::TIMESTAMP AS ts FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""",
)
def slice_whole_days(spark, sf):
    return C.slice_inclusive(table(spark, sf, "events").select("event_id", "ts"), "2024-01-08", "2024-01-14")


HOLDOUTS = [
    ("1996-01-31 00:00:00", "1996-02-01 00:00:00"),
    ("1996-03-31 00:00:00", "1996-04-01 00:00:00"),
    ("1997-05-01 00:00:00", "1997-06-01 00:00:00"),
]
_OUT = " AND ".join(f"NOT (o_orderdate > TIMESTAMP '{a}' AND o_orderdate < TIMESTAMP '{b}')" for a, b in HOLDOUTS)


@query("drop_holdout_open", f"SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders WHERE {_OUT}")
def drop_holdout_open(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return C.drop_holdout(rows, HOLDOUTS)


@query(
    "drop_holdout_left",
    f"SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders WHERE {_OUT.replace('>', '>=')}",
)
def drop_holdout_left(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return C.drop_holdout(rows, HOLDOUTS, closed="left")


@query(
    "rename_cast",
    """SELECT event_id AS id, trunc(value - 50)::BIGINT AS difference, event_type AS series_id FROM events""",
)
def rename_cast(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("v"), "event_type")
    named = C.rename(rows, {"event_id": "id", "v": "difference", "event_type": "series_id", "absent": "x"})
    return tidy(C.cast_columns(named, {"difference": "int"}))


@query(
    "rename_by_position",
    f"SELECT s_suppkey AS station, s_name AS name, s_nationkey::BIGINT AS area, {rnd('s_acctbal')} AS level FROM supplier",
)
def rename_by_position(spark, sf):
    return tidy(C.rename_by_position(table(spark, sf, "supplier"), ["station", "name", "area", "level"]))


@query(
    "drop_columns",
    "SELECT event_id, ts::TIMESTAMP AS ts, event_type FROM events",
)
def drop_columns(spark, sf):
    return C.drop_columns(table(spark, sf, "events"), ["user_id", "value", "props"])


@query(
    "constant_columns",
    "SELECT event_id, event_type, 0.0::DOUBLE AS result, 31::BIGINT AS date, 7::BIGINT AS month FROM events",
)
def constant_columns(spark, sf):
    rows = C.keep_columns(table(spark, sf, "events"), ["event_id", "event_type"])
    return tidy(C.add_constants(rows, {"result": 0.0, "date": 31, "month": 7}))


@query(
    "keep_equal_positive",
    f"""SELECT c_custkey, c_mktsegment, {rnd('c_acctbal')} AS c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""",
)
def keep_equal_positive(spark, sf):
    rows = C.keep_columns(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment", "c_acctbal"])
    return tidy(C.keep_positive(C.keep_equal(rows, "c_mktsegment", "BUILDING"), "c_acctbal"))


@query(
    "first_n",
    f"""SELECT event_type AS series_id, ts::TIMESTAMP AS ts, {rnd('value')} AS value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts) <= 297""",
)
def first_n(spark, sf):
    return tidy(first_rows(readings(spark, sf), 297))


@query(
    "last_n",
    """SELECT o_orderpriority AS series_id, o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) <= 1000""",
)
def last_n(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), "o_orderkey", F.col("o_orderdate").alias("ts")
    )
    return last_rows(rows, 1000, tie="o_orderkey")


@query(
    "head_rows",
    f"""SELECT event_type AS series_id, ts::TIMESTAMP AS ts, {rnd('value')} AS value FROM events
ORDER BY ts, event_type LIMIT 15""",
)
def head_rows(spark, sf):
    return tidy(readings(spark, sf).orderBy("ts", "series_id").limit(15))


@query(
    "sort_by_key",
    f"""SELECT event_type AS series_id, ts::TIMESTAMP AS ts, {rnd('value')} AS value FROM events
ORDER BY series_id, ts""",
)
def sort_by_key(spark, sf):
    return tidy(readings(spark, sf)).orderBy("series_id", "ts")


@query(
    "unpivot_long",
    f"""WITH {SPAN}, d AS (SELECT CAST(user_id AS VARCHAR) series_id, CAST(ts AS DATE) ts, sum(value) v FROM events GROUP BY 1, 2),
u AS (SELECT DISTINCT series_id FROM d),
g AS (SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE ts FROM u, span)
SELECT g.series_id, g.ts, {rnd('d.v')} AS value FROM g LEFT JOIN d USING (series_id, ts)""",
)
def unpivot_long(spark, sf):
    days = daily_users(spark, sf)
    wide = C.pivot(days.withColumn("ts", F.col("ts").cast("string")), "series_id", days_of(days))
    return tidy(C.unpivot(wide, "series_id"))


@query(
    "range_bounds",
    "SELECT min(ts)::TIMESTAMP AS first_ts, max(ts)::TIMESTAMP AS last_ts FROM events",
)
def range_bounds(spark, sf):
    return C.range_bounds(table(spark, sf, "events"))


@query(
    "union_all",
    f"""SELECT s_suppkey AS id, {rnd('s_acctbal')} AS level, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, {rnd('c_acctbal')}, c_mktsegment FROM customer
UNION ALL SELECT s_suppkey, {rnd('s_acctbal')}, NULL FROM supplier""",
)
def union_all(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("level"))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("level"), F.col("c_mktsegment").alias("segment")
    )
    return tidy(C.union_all(s, c, s))
