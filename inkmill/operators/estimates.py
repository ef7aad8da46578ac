"""What a run would cost, before it is sent: requests priced by the cheapest endpoint of their model that takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a listing: nested, with prices as texts.
LISTING = "struct<data: struct<id: string, endpoints: array<struct<provider_name: string, context_length: bigint, max_completion_tokens: bigint, pricing: struct<prompt: string, completion: string>, supported_parameters: array<string>>>>>"
#: Models up to which their endpoints are broadcast.
MOST_BROADCAST = 100_000
PRICE = "decimal(20,14)"


def _worse(e: Column, than: Column) -> Column:
    """Whether `than` is chosen before e by every request with tokens to pay for: it takes all that e takes, costs no more, and is first by name where costs may tie."""
    as_wide = lambda k: than[k].isNull() | (e[k] <= than[k])
    first = than["provider"].isNull() | (than["provider"] <= e["provider"])
    dearer = (than["prompt"] < e["prompt"]) & (than["completion"] < e["completion"])
    all_ = (than["prompt"] <= e["prompt"]) & (than["completion"] <= e["completion"]) & as_wide("context") & as_wide("most") & (dearer | first) & (F.size(F.array_except(e["parameters"], than["parameters"])) == 0)
    return F.coalesce(all_, F.lit(False))


def endpoints(listings: DataFrame) -> DataFrame:
    """(model, free, endpoints) of listings(json): the endpoints of each model that have both prices, exact, with their limits, by what parameters they support; a limit that is missing is none.

    A model has two rows: all its endpoints, for requests that are free of tokens, and those that no other is better than,
    for the others: few of thousands. A better one comes earlier by price, so each is compared with those kept before it.
    """
    each = listings.select(F.from_json("json", LISTING).alias("j")).select(F.col("j.data.id").alias("model"), F.explode("j.data.endpoints").alias("e"))
    price = lambda k: F.col(f"e.pricing.{k}").try_cast(PRICE).alias(k)
    none = F.array().cast("array<string>")
    # in the order of the fold: prices first, then limits from wide to narrow (none before all)
    order = [price("prompt"), price("completion"), (-F.col("e.context_length")).alias("by_context"), (-F.col("e.max_completion_tokens")).alias("by_most"), (-F.size(F.coalesce("e.supported_parameters", none))).alias("by_parameters"), F.col("e.provider_name").alias("provider")]
    rows = each.select("model", F.struct(*order, F.col("e.context_length").alias("context"), F.col("e.max_completion_tokens").alias("most"), F.coalesce("e.supported_parameters", none).alias("parameters")).alias("e"))
    of = rows.where("model is not null and e.prompt >= 0 and e.completion >= 0").groupBy("model").agg(F.sort_array(F.collect_list("e")).alias("all"))
    kept = F.aggregate("all", F.array().cast(dict(of.dtypes)["all"]), lambda best, e: F.when(F.exists(best, lambda b: _worse(e, b)), best).otherwise(F.concat(best, F.array(e))))
    each = of.select("model", F.explode(F.array(F.struct(F.lit(True).alias("free"), F.col("all").alias("l")), F.struct(F.lit(False).alias("free"), kept.alias("l")))).alias("x"))
    e = each.select("model", "x.free", F.explode("x.l").alias("e")).select("model", "free", "e.*")
    rough = [F.col(k).cast("double").alias(f"about_{k}") for k in ("prompt", "completion")]
    # what endpoints support is looked at once for all that support the same
    alike = e.groupBy("model", "free", "parameters").agg(F.collect_list(F.struct("provider", "context", "most", "prompt", "completion", *rough)).alias("of"))
    return alike.groupBy("model", "free").agg(F.collect_list(F.struct("parameters", "of")).alias("endpoints"))


def priced(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """requests(model, prompt_tokens, completion_tokens, needs, ...) with provider and cost: of the model's endpoints that support what a request needs and whose context and completion it fits, the cheapest for it, then the first by name.

    Null where none does. A model's endpoints travel as one list, without those that are never chosen, and no row is made for a pair. Costs are exact.
    """
    of = endpoints(listings)
    of = F.broadcast(of) if of.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else of
    a, b, needs = F.col("prompt_tokens"), F.col("completion_tokens"), F.coalesce("needs", F.array().cast("array<string>"))
    paid = F.coalesce((a >= 0) & (b >= 0) & ((a > 0) | (b > 0)), F.lit(False))
    rows = requests.withColumn("free", ~paid).join(of, ["model", "free"], "left").drop("free")
    supported = F.filter(F.coalesce("endpoints", F.array().cast(dict(of.dtypes)["endpoints"])), lambda g: F.size(F.array_except(needs, g["parameters"])) == 0)
    fits = F.filter(F.flatten(F.transform(supported, lambda g: g["of"])), lambda e: (e["context"].isNull() | (a + b <= e["context"])) & (e["most"].isNull() | (b <= e["most"])))
    about = lambda e: e["about_prompt"] * a + e["about_completion"] * b
    exact = lambda e: F.struct((e["prompt"] * a.cast("decimal(12,0)") + e["completion"] * b.cast("decimal(12,0)")).cast("decimal(38,14)").alias("cost"), e["provider"].alias("provider"))
    # exact costs of those alone that are the cheapest by doubles, or too near to tell; a lambda's variable is worked out once
    among = lambda f, least: F.array_min(F.transform(F.filter(f, lambda e: ~paid | (about(e) <= least * (1 + 1e-9))), exact))
    best = F.get(F.flatten(F.transform(F.array(fits), lambda f: F.transform(F.array(F.array_min(F.transform(f, about))), lambda least: among(f, least)))), F.lit(0))
    return rows.withColumn("best", best).drop("endpoints").withColumns({"provider": F.col("best.provider"), "cost": F.col("best.cost")}).drop("best")


def estimate(requests: DataFrame, listings: DataFrame, by: str, reserve: str = "0.25") -> DataFrame:
    """(by, requests, unfit, cost, with_reserve): the sums of priced() by a column; with_reserve adds a part for what is sent again."""
    sums = priced(requests, listings).groupBy(by).agg(F.count("*").alias("requests"), F.count_if(F.col("cost").isNull()).alias("unfit"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,14)").alias("cost"))
    return sums.withColumn("with_reserve", (F.col("cost") * (F.lit(1) + F.lit(reserve).cast("decimal(4,2)"))).cast("decimal(38,14)"))
