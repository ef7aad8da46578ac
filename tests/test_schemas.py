import json
import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions import schemas


def first(value, schema, at="$"):
    """The first departure, in plain Python."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or kind in ("number", "integer") and isinstance(value, bool)):
        return f"{at}: not {'an' if kind[0] in 'aeio' else 'a'} {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if kind == "string":
        if len(value) < schema.get("minLength", 0):
            return f"{at}: shorter than {schema['minLength']}"
        if len(value) > schema.get("maxLength", 1 << 30):
            return f"{at}: longer than {schema['maxLength']}"
    if kind in ("number", "integer"):
        if value < schema.get("minimum", -1e300):
            return f"{at}: under {schema['minimum']}"
        if value > schema.get("maximum", 1e300):
            return f"{at}: over {schema['maximum']}"
    if kind == "object":
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}: no {k}"
        if schema.get("additionalProperties", True) is False and (more := set(value) - set(schema["properties"])):
            return f"{at}: also has {min(more)}"
        for k, s in schema.get("properties", {}).items():
            if k in value and (found := first(value[k], s, f"{at}.{k}")):
                return found
    if kind == "array":
        if len(value) < schema.get("minItems", 0):
            return f"{at}: fewer than {schema['minItems']}"
        if len(value) > schema.get("maxItems", 1 << 30):
            return f"{at}: more than {schema['maxItems']}"
        for i, x in enumerate(value):
            if found := first(x, schema.get("items", {}), f"{at}[{i}]"):
                return found
    return None


def damaged(rng, value):
    """value with something in it replaced, taken out or added."""
    if isinstance(value, dict) and value and rng.random() < 0.8:
        k = rng.choice(list(value))
        return rng.choice([lambda: value | {k: damaged(rng, value[k])}, lambda: {x: y for x, y in value.items() if x != k}, lambda: value | {rng.choice(["extra", "a b", "Id"]): 1}])()
    if isinstance(value, list) and value and rng.random() < 0.9:
        i = rng.randrange(len(value))
        return value[:i] + [damaged(rng, value[i])] + value[i + 1 :]
    return rng.choice(["", "é", "\U0001f600" * 4, 0, 10, 10.0001, -0.5, 1e20, 3, True, None, [], {}, [1], {"id": "x"}, "5"])


WIDE = schemas.closed_object({"kind": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 3}}, "on": {"type": "boolean"}, "none": {"type": "null"}, "deep": schemas.closed_object({"in": schemas.one_or_more(schemas.SCORE)})})
GOOD = [
    (schemas.RUBRIC, {"criteria": [dict.fromkeys(("id", "description", "low", "middle", "high"), "x")] * 3}),
    (schemas.GRADE, {"scores": [{"id": "a", "score": 0, "evidence": "é"}, {"id": "b", "score": 9.75, "evidence": "q"}]}),
    (schemas.PROPOSAL, {"prompt": "p", "rationale": "r"}),
    (WIDE, {"kind": "a", "n": 2, "tags": ["x", "yz"], "on": True, "none": None, "deep": {"in": [1, 10]}}),
]


@pytest.mark.parametrize("k", range(len(GOOD)))
def test_against_plain_python(spark, k):
    schema, good = GOOD[k]
    rng, values = random.Random(k), [good]
    for _ in range(200):
        v = good
        for _ in range(rng.randint(1, 3)):
            v = damaged(rng, v)
        values.append(v)
    rows = [(i, json.dumps(v, ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", schemas.departure(F.col("t"), schema).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: first(v, schema) for i, v in enumerate(values)}
    assert sum(r.d is None for r in got) >= 1


def test_what_is_no_json(spark):
    rows = [(None,), ("",), ("{",), ('{"prompt": "p", "rationale": NaN}',), ('{"prompt": "p", "prompt": "q", "rationale": "r"}',), ('{"prompt": "p", "rationale": "r"} x',)]
    got = spark.createDataFrame(rows, "t string").select(schemas.departure(F.col("t"), schemas.PROPOSAL).alias("d"), schemas.holds(F.col("t"), schemas.PROPOSAL).alias("h")).collect()
    assert {(r.d, r.h) for r in got} == {("not JSON", False)}


def test_unknown_words_raise():
    with pytest.raises(ValueError, match="pattern"):
        schemas.departure(F.lit("1"), {"type": "string", "pattern": "x"})
