"""The budget ledger over events, as a stream that ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.plans.registry import query, table
from inkmill.sources.stages import shared_folder
from inkmill.streaming import budget

BUDGET, TIMEOUT, LATE = 900_000_000, 86_400, 3_600
_ACTIONS = {"view": "reserve", "signup": "reserve", "click": "reserve", "purchase": "settle", "error": "release"}


def requests(events: DataFrame) -> DataFrame:
    """Events as what a ledger is asked: users are keys, a user's requests are named by two days each."""
    ts = F.col("ts").cast("timestamp")
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _ACTIONS.items()])
    request = F.floor(F.unix_micros(ts) / 172_800_000_000).cast("string")
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), ts.alias("ts"), action.alias("action"), request.alias("request"), F.round(F.abs("value") * 1_000_000).cast("long").alias("amount"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())
_STEP = f"""SELECT s.user_id, s.k + 1 AS k, s.spent + coalesce(list_sum(list_transform(list_filter(s.held, lambda o: o.d <= e.t), lambda o: o.a)), 0) AS spent0, list_filter(s.held, lambda o: o.d > e.t) AS held0,
  s.expired + len(list_filter(s.held, lambda o: o.d <= e.t)) AS expired, e.t, e.action, e.request, e.amount, s.granted, s.refused, s.repeated, s.settled, s.released, s.unknown FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1"""
_LEDGER = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_type {_CASES} END AS action, (epoch_us(ts) // 172800000000)::VARCHAR AS request, round(abs(value) * 1000000)::BIGINT AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s(user_id, k, spent, held, granted, refused, repeated, settled, released, unknown, expired) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::HUGEINT, []::STRUCT(r VARCHAR, a BIGINT, d BIGINT)[], 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e UNION ALL
  SELECT user_id, k, spent0 + CASE WHEN what = 'settled' THEN amount ELSE 0 END, CASE WHEN what = 'granted' THEN list_append(held0, {{'r': request, 'a': amount, 'd': t + {TIMEOUT}000000}}) WHEN what IN ('settled', 'released') THEN list_filter(held0, lambda o: o.r <> request) ELSE held0 END,
    granted + (what = 'granted')::INT, refused + (what = 'refused')::INT, repeated + (what = 'repeated')::INT, settled + (what = 'settled')::INT, released + (what = 'released')::INT, unknown + (what = 'unknown')::INT, expired
  FROM (SELECT *, CASE WHEN action = 'reserve' THEN CASE WHEN has THEN 'repeated' WHEN spent0 + coalesce(list_sum(list_transform(held0, lambda o: o.a)), 0) + amount <= {BUDGET} THEN 'granted' ELSE 'refused' END WHEN NOT has THEN 'unknown' WHEN action = 'settle' THEN 'settled' ELSE 'released' END AS what
    FROM (SELECT *, list_contains(list_transform(held0, lambda o: o.r), request) AS has FROM ({_STEP})))),
f AS (SELECT *, (SELECT max(t) FROM e) - {LATE}000000 AS mark FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id::VARCHAR AS key, granted, refused, repeated, settled, released, unknown, expired + len(list_filter(held, lambda o: o.d <= mark)) AS expired,
  (spent + coalesce(list_sum(list_transform(list_filter(held, lambda o: o.d <= mark), lambda o: o.a)), 0))::BIGINT AS spent FROM f"""


@query("q_budget_ledger", _LEDGER)
def q_budget_ledger(s: SparkSession, d: str) -> DataFrame:
    """What each user's requests came to within a budget, decided row by row by a stream."""
    path = f"{shared_folder(s)}/inkmill-ledger-{uuid.uuid4().hex}"
    # a stream's source is a folder or a pattern, and the table may be one file
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    budget.run(requests(events), path, BUDGET, TIMEOUT, f"{LATE} seconds")
    return budget.balances(s.read.parquet(f"{path}/decisions"))
