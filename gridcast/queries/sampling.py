from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import sampling as O
from gridcast.operators.rank import chrono_split, row_ordinal
from gridcast.queries.registry import daily_users, query, readings, rnd, table, tidy


def _digest(columns: str, seed: int) -> str:
    return f"md5(concat_ws('|', {columns}, '{seed}'))"


def _number(columns: str, seed: int, digits: int = 8) -> str:
    return f"('0x' || substr({_digest(columns, seed)}, 1, {digits}))::BIGINT"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), "o_orderkey", F.col("o_orderdate").alias("ts")
    )


@query(
    "chrono_split",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) rn, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type AS series_id, ts::TIMESTAMP AS ts, {rnd('value')} AS value, rn <= floor(n * 0.8) AS is_train FROM n""",
)
def chrono_split_query(spark, sf):
    return tidy(chrono_split(readings(spark, sf), 0.8))


@query(
    "chrono_split_ties",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) rn,
  count(*) OVER (PARTITION BY o_orderpriority) n FROM orders)
SELECT o_orderpriority AS series_id, o_orderkey, o_orderdate::TIMESTAMP AS ts, rn <= floor(n * 0.7) AS is_train FROM n""",
)
def chrono_split_ties(spark, sf):
    return chrono_split(_orders(spark, sf), 0.7, tie="o_orderkey")


@query(
    "row_ordinal",
    """SELECT o_orderpriority AS series_id, o_orderkey, o_orderdate::TIMESTAMP AS ts,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::BIGINT AS ordinal FROM orders""",
)
def row_ordinal_query(spark, sf):
    return row_ordinal(_orders(spark, sf), tie="o_orderkey")


@query(
    "hash_split",
    f"SELECT event_id, {_number('event_id', 42)} / 4294967296.0 < 0.33 AS is_test FROM events",
)
def hash_split(spark, sf):
    return O.hash_split(table(spark, sf, "events").select("event_id"), 0.33, ["event_id"])


@query(
    "hash_folds",
    f"SELECT event_id, ({_number('event_id', 21)} % 10)::BIGINT AS fold FROM events",
)
def hash_folds(spark, sf):
    return tidy(O.hash_fold(table(spark, sf, "events").select("event_id"), 10, ["event_id"]))


_DAILY = "SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY 1, 2"


@query(
    "hash_sample_series",
    f"""WITH d AS ({_DAILY}), s AS (SELECT DISTINCT series_id FROM d ORDER BY {_digest('series_id', 8)} LIMIT 6)
SELECT series_id, ts, {rnd('value')} AS value FROM d WHERE series_id IN (SELECT series_id FROM s)""".replace(
        "SELECT DISTINCT series_id FROM d", "SELECT series_id FROM (SELECT DISTINCT series_id FROM d)"
    ),
)
def hash_sample_series(spark, sf):
    return tidy(O.sample_series(daily_users(spark, sf), 6))


@query(
    "first_n_series",
    f"""WITH d AS ({_DAILY}), s AS (SELECT series_id FROM (SELECT DISTINCT series_id FROM d) ORDER BY series_id LIMIT 40)
SELECT series_id, ts, {rnd('value')} AS value FROM d WHERE series_id IN (SELECT series_id FROM s)""",
)
def first_n_series(spark, sf):
    return tidy(O.first_series(daily_users(spark, sf), 40))


@query(
    "series_holdout",
    f"""WITH d AS ({_DAILY}), s AS (SELECT series_id, row_number() OVER (ORDER BY series_id) rn, count(*) OVER () n
  FROM (SELECT DISTINCT series_id FROM d))
SELECT d.series_id, d.ts, {rnd('d.value')} AS value, rn > floor(n * (1 - 0.2::DOUBLE)) AS is_validation FROM d JOIN s USING (series_id)""",
)
def series_holdout(spark, sf):
    return tidy(O.series_holdout(daily_users(spark, sf)))


@query(
    "shuffle_batches",
    f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {_digest('event_id', 100)}, event_id) - 1 AS p FROM events)
SELECT event_id, (p // 128)::BIGINT AS batch, (p % 128)::BIGINT AS slot FROM o""",
)
def shuffle_batches(spark, sf):
    return tidy(O.shuffle_batches(table(spark, sf, "events").select("event_id"), 128, ["event_id"]))


@query(
    "first_batch",
    f"""SELECT event_id, {rnd('value')} AS value FROM events ORDER BY {_digest('event_id', 100)}, event_id LIMIT 128""",
)
def first_batch(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return tidy(O.take_batches(O.shuffle_batches(rows, 128, ["event_id"])).select("event_id", "value"))


@query(
    "consecutive_batches",
    """WITH o AS (SELECT event_type series_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p FROM events)
SELECT series_id, event_id, (p // 32)::BIGINT AS batch FROM o""",
)
def consecutive_batches(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "event_id", "ts")
    return tidy(O.consecutive_batches(row_ordinal(rows, tie="event_id"), 32).select("series_id", "event_id", "batch"))
