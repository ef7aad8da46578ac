"""The cost of requests made of orders, by endpoints made of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import estimates
from inkmill.plans.registry import query, table


def listings(s: SparkSession, d: str) -> DataFrame:
    """A listing as JSON for each nation, the model: its suppliers are the endpoints."""
    k = F.col("s_suppkey")
    price = lambda n, m: F.concat(F.lit("0.0000"), F.lpad((k * n % m).cast("string"), 6, "0"))
    endpoint = F.concat(
        F.lit('{"provider_name":"p'), k.cast("string"), F.lit('","context_length":'), (100_000 + k * 7919 % 400_000).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"max_completion_tokens":'), (1000 + k * 31 % 9000).cast("string"))),
        F.lit(',"pricing":{"prompt":"'), price(7, 9973), F.lit('","completion":"'), price(13, 99991), F.lit('"},"supported_parameters":["seed"'), F.when(k % 2 == 0, ',"tools"').otherwise(""), F.lit("]}"),
    )
    per = table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(endpoint), ",").alias("e"))
    return per.select(F.concat(F.lit('{"data":{"id":"m'), F.col("s_nationkey").cast("string"), F.lit('","endpoints":['), "e", F.lit("]}}")).alias("json"))


_ESTIMATE = """WITH e AS (SELECT s_nationkey AS model, 'p' || s_suppkey AS provider, 100000 + s_suppkey * 7919 % 400000 AS context, CASE WHEN s_suppkey % 3 <> 0 THEN 1000 + s_suppkey * 31 % 9000 END AS most,
  ('0.0000' || lpad((s_suppkey * 7 % 9973)::VARCHAR, 6, '0'))::DECIMAL(20,14) AS prompt, ('0.0000' || lpad((s_suppkey * 13 % 99991)::VARCHAR, 6, '0'))::DECIMAL(20,14) AS completion, s_suppkey % 2 = 0 AS tools FROM supplier),
r AS (SELECT o_orderkey, o_orderpriority AS role, c_nationkey AS model, floor(o_totalprice)::BIGINT AS a, 200 + o_orderkey % 5000 AS b, o_orderkey % 4 = 0 AS tools FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT o_orderkey, role, (SELECT min((prompt * a::DECIMAL(12,0) + completion * b::DECIMAL(12,0))::DECIMAL(38,14)) FROM e WHERE e.model = r.model AND a + b <= context AND (most IS NULL OR b <= most) AND (e.tools OR NOT r.tools)) AS cost FROM r)
SELECT role, count(*) AS requests, count(*) FILTER (cost IS NULL) AS unfit, round(coalesce(sum(cost), 0)::DOUBLE, 6) AS cost, round((coalesce(sum(cost), 0) * 1.25)::DOUBLE, 6) AS with_reserve FROM p GROUP BY 1"""


@query("q_cost_estimate", _ESTIMATE)
def q_cost_estimate(s: SparkSession, d: str) -> DataFrame:
    """What requests of each role would cost at the cheapest endpoint that takes each."""
    i = F.col("o_orderkey")
    needs = F.when(i % 4 == 0, F.array(F.lit("tools"), F.lit("seed"))).otherwise(F.array(F.lit("seed")))
    orders = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    requests = orders.select(F.col("o_orderpriority").alias("role"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("model"), F.floor("o_totalprice").cast("long").alias("prompt_tokens"), (200 + i % 5000).alias("completion_tokens"), needs.alias("needs"))
    found = estimates.estimate(requests, listings(s, d), "role")
    return found.select("role", "requests", "unfit", F.round(F.col("cost").cast("double"), 6).alias("cost"), F.round(F.col("with_reserve").cast("double"), 6).alias("with_reserve"))
