"""Requests to a model and what comes back: payloads, replies and whether they hold, generation ids, costs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import canonical_json

#: What of an example a writer may see.
SEEN = ("context", "kind", "target_words")


def blinded(examples: DataFrame) -> DataFrame:
    """examples without what tells who wrote or checks them."""
    return examples.select(*SEEN)


def payload(cfg: dict, system: Column, data: Column) -> Column:
    """A request as canonical JSON: one provider and no other, the settings of cfg, instructions, and data as JSON."""
    alone = F.array(F.lit(cfg["provider"]))
    message = lambda role, x: F.named_struct(F.lit("content"), x, F.lit("role"), F.lit(role))
    none = F.array().cast("array<string>")
    #: The fields of a request.
    fields = {
        "max_tokens": F.lit(cfg["max_tokens"]),
        "messages": F.array(message("system", system), message("user", canonical_json(data))),
        "model": F.lit(cfg["model"]),
        "plugins": none,
        "provider": F.named_struct(F.lit("allow_fallbacks"), F.lit(False), F.lit("only"), alone, F.lit("order"), alone, F.lit("require_parameters"), F.lit(True)),
        "stream": F.lit(False),
        "temperature": F.lit(cfg["temperature"]),
        "transforms": none,
    }
    return canonical_json(F.to_json(F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])))


def _kind(reply: Column, path: str) -> Column:
    """The type of a part of a JSON text; null where there is none, VOID for null."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(reply), path, "variant"))


def valid_choice(reply: Column) -> Column:
    """Whether a reply's first choice has a message whose content, if any, is a text. False for what is no JSON."""
    message = F.coalesce(_kind(reply, "$.choices[0].message").startswith("OBJECT"), F.lit(False))
    content = F.coalesce(_kind(reply, "$.choices[0].message.content"), F.lit("VOID"))
    return message & content.isin("STRING", "VOID")


def succeeded(status: Column, reply: Column) -> Column:
    """Status 200, a valid choice, and no error but an empty one."""
    error = F.get_json_object(reply, "$.error")
    return (status == 200) & valid_choice(reply) & (error.isNull() | error.isin("", "null", "false", "0", "[]", "{}"))


def generation_id(response_id: Column, reply: Column) -> Column:
    """The id sent with the answer, or the one inside it; empty ones are none."""
    return F.coalesce(F.nullif(response_id, F.lit("")), F.nullif(F.get_json_object(reply, "$.id"), F.lit("")))


def closed(value: Column, *keys: str) -> Column:
    """Whether a JSON text is an object with exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(value)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def complete(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(reply, "$.choices[0].finish_reason") == "stop", F.lit(False))


def costs(attempts: DataFrame, look_up: Callable[[str], dict]) -> DataFrame:
    """(generation_id, cost, error): each distinct id looked up once; an answer of another id or without a finite cost of 0 or more is an error."""

    def one(i: str) -> tuple:
        try:
            found = look_up(i)
            cost = found["total_cost"]
            if found["id"] != i or isinstance(cost, bool) or not isinstance(cost, (int, float)) or not math.isfinite(cost) or cost < 0:
                raise ValueError("invalid id or cost")
            return i, float(cost), None
        except (OSError, ValueError, KeyError, TypeError) as e:
            return i, None, f"{type(e).__name__}: {e}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([one(i) for i in pdf.generation_id], columns=["generation_id", "cost", "error"])

    return attempts.select("generation_id").where("generation_id is not null").distinct().mapInPandas(run, "generation_id string, cost double, error string")


def graded(rubrics: DataFrame, grades: DataFrame, key: list[str]) -> DataFrame:
    """rubrics(key.., rubric) with each origin's grade; null where there is none. One pass over grades(key.., origin, total)."""
    both = grades.groupBy(*key).pivot("origin", ["human", "model"]).agg(F.first("total"))
    return rubrics.join(both, key, "left")
