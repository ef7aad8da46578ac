"""Closed JSON schemas, compiled to one column that tells where a text first departs from its schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of JSON by what Spark calls a variant of them.
TYPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
KNOWN = {"type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum", "enum"}


def _part(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    found = F.schema_of_variant(v)
    known = [F.startswith(found, F.lit(t)) for t in TYPES[kind]]
    out = known[0]
    for k in known[1:]:
        out |= k
    return out


def _quoted(key: str) -> str:
    if any(c in key for c in "'\"[]\\"):
        raise ValueError(f"a key that a path can't name: {key}")
    return f"$['{key}']"


def _within(checks: list[tuple[Column, Column]]) -> Column:
    """What the first check that fails says; null if none does."""
    return F.coalesce(*[F.when(bad, said) for bad, said in checks], F.lit(None).cast("string"))


def _node(schema: dict, v: Column, at: Column) -> Column:
    """The first departure of the variant v, which is there, from schema; at is its path."""
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"not known: {', '.join(sorted(unknown))}")
    said = lambda what: F.concat(at, F.lit(f": {what}"))
    kind = schema.get("type")
    checks = []

    def least(word: str, value: Column, what: str) -> None:
        if word in schema:
            checks.append((value < schema[word], said(f"{what} {schema[word]}")))

    def most(word: str, value: Column, what: str) -> None:
        if word in schema:
            checks.append((value > schema[word], said(f"{what} {schema[word]}")))

    if kind:
        checks.append((~_is(v, kind), said(f"not {'an' if kind[0] in 'aeio' else 'a'} {kind}")))
    if "enum" in schema:
        if not all(isinstance(x, str) for x in schema["enum"]):
            raise ValueError("enum of other than texts")
        checks.append((~(_is(v, "string") & F.coalesce(_part(v, "$", "string").isin(schema["enum"]), F.lit(False))), said("not one of the values")))
    if kind == "string":
        n = F.length(_part(v, "$", "string"))
        least("minLength", n, "shorter than")
        most("maxLength", n, "longer than")
    if kind in ("number", "integer"):
        x = _part(v, "$", "double")
        least("minimum", x, "under")
        most("maximum", x, "over")
    if kind == "object":
        properties = schema.get("properties", {})
        for key in schema.get("required", []):
            checks.append((_part(v, _quoted(key)).isNull(), said(f"no {key}")))
        if schema.get("additionalProperties", True) is False:
            more = F.array_except(F.map_keys(_part(v, "$", "map<string,variant>")), F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>"))
            checks.append((F.size(more) > 0, F.concat(at, F.lit(": also has "), F.array_min(more))))
        own = [_within(checks)] if checks else []
        for key, sub in properties.items():
            child = _part(v, _quoted(key))
            own.append(F.when(child.isNotNull(), _node(sub, child, F.concat(at, F.lit(f".{key}")))))
        return F.coalesce(*own, F.lit(None).cast("string"))
    if kind == "array":
        n = F.size(_part(v, "$", "array<variant>"))
        least("minItems", n, "fewer than")
        most("maxItems", n, "more than")
        own = _within(checks)
        if "items" in schema:
            each = F.transform(_part(v, "$", "array<variant>"), lambda x, i: _node(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
            own = F.coalesce(own, F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))
        return own
    return _within(checks) if checks else F.lit(None).cast("string")


def departure(text: Column, schema: dict) -> Column:
    """Where the JSON text first departs from the schema, and how; null where it holds.

    Keys and items are taken in the schema's order: the value's type and size, keys that are missing, the least of
    those that are too many, then each key, then each item. A null text, one that isn't JSON (NaN and
    objects with a key twice are none), or has something after it, says "not JSON". Schemas are dicts of KNOWN words; another
    word, or enums of other than texts, raise. Lengths count code points; true and false are no numbers.
    """
    # the parser leaves out what follows a value, but not inside an array
    alone = _part(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    v = F.when(F.size(alone) == 1, F.get(alone, F.lit(0)))
    return F.when(v.isNull(), "not JSON").otherwise(_node(schema, v, F.lit("$")))


def holds(text: Column, schema: dict) -> Column:
    return departure(text, schema).isNull()


def closed_object(properties: dict) -> dict:
    """The schema of an object with these keys, all of them, and no others."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def one_or_more(items: dict) -> dict:
    return {"type": "array", "minItems": 1, "items": items}


#: The replies that a rubric, a grade and a proposal must be.
TEXT, SCORE = {"type": "string", "minLength": 1}, {"type": "number", "minimum": 0, "maximum": 10}
RUBRIC = closed_object({"criteria": one_or_more(closed_object(dict.fromkeys(("id", "description", "low", "middle", "high"), TEXT)))})
GRADE = closed_object({"scores": one_or_more(closed_object({"id": TEXT, "score": SCORE, "evidence": TEXT}))})
PROPOSAL = closed_object({"prompt": TEXT, "rationale": TEXT})
