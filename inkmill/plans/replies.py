"""Queries over replies to a model, made of whole conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import schemas
from inkmill.plans.registry import query, table

#: A turn's sentences, of letters and spaces alone, so that engines write them alike in JSON.
_SENTENCES = "list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: trim(regexp_replace(x, '[^A-Za-z ]+', '', 'g'))), lambda x: x <> '')"
_CRITERION = """'{"id":"c' || i || '","description":"' || x || '"' || CASE WHEN (conv_id + turn + i) % 11 = 0 THEN '' ELSE ',"low":"l","middle":"m"' END || ',"high":"' || CASE WHEN (conv_id + i) % 13 = 0 THEN '' ELSE 'h' END || '"}'"""
_GRADE = """'{"id":"c' || i || '","score":' || (length(x) % 12) || CASE WHEN (conv_id + i) % 5 = 0 THEN '.5' ELSE '' END || CASE WHEN (turn + i) % 17 = 0 THEN ',"extra":null' ELSE '' END || ',"evidence":"' || x || '"}'"""
_REPLIES = f"""s AS (SELECT conv_id, turn, role, {_SENTENCES} AS s FROM conversations),
r AS (SELECT conv_id, turn, 'rubric' AS kind, '{{"criteria":[' || array_to_string(list_transform(s, lambda x, i: {_CRITERION}), ',') || ']' || CASE WHEN turn % 7 = 3 THEN '' ELSE '}}' END AS reply FROM s
  UNION ALL SELECT conv_id, turn, 'grade', '{{"scores":[' || array_to_string(list_transform(s, lambda x, i: {_GRADE}), ',') || ']}}' FROM s
  UNION ALL SELECT conv_id, turn, 'proposal', '{{"prompt":"' || array_to_string(s, ' ') || '","rationale":' || CASE WHEN role = 'user' THEN '7' ELSE '"r"' END || '}}' FROM s)"""


def replies(s: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, kind, reply): a rubric, a grade and a proposal of each turn's sentences, some of which have faults."""
    turns = table(s, d, "conversations").select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), r"\.").alias("s"))
    turns = turns.withColumn("s", F.filter(F.transform("s", lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z ]+", ""))), lambda x: x != ""))
    lit, c, t = F.lit, F.col("conv_id"), F.col("turn")

    def criterion(x, i):
        k = i + 1
        middle = F.when((c + t + k) % 11 == 0, "").otherwise(',"low":"l","middle":"m"')
        return F.concat(lit('{"id":"c'), k.cast("string"), lit('","description":"'), x, lit('"'), middle, lit(',"high":"'), F.when((c + k) % 13 == 0, "").otherwise("h"), lit('"}'))

    def grade(x, i):
        k = i + 1
        half, extra = F.when((c + k) % 5 == 0, ".5").otherwise(""), F.when((t + k) % 17 == 0, ',"extra":null').otherwise("")
        return F.concat(lit('{"id":"c'), k.cast("string"), lit('","score":'), (F.length(x) % 12).cast("string"), half, extra, lit(',"evidence":"'), x, lit('"}'))

    rubric = F.concat(lit('{"criteria":['), F.array_join(F.transform("s", criterion), ","), lit("]"), F.when(t % 7 == 3, "").otherwise("}"))
    grades = F.concat(lit('{"scores":['), F.array_join(F.transform("s", grade), ","), lit("]}"))
    proposal = F.concat(lit('{"prompt":"'), F.array_join("s", " "), lit('","rationale":'), F.when(F.col("role") == "user", "7").otherwise('"r"'), lit("}"))
    each = F.explode(F.array(*[F.struct(lit(k).alias("kind"), x.alias("reply")) for k, x in (("rubric", rubric), ("grade", grades), ("proposal", proposal))]))
    return turns.select("conv_id", "turn", each.alias("r")).select("conv_id", "turn", "r.*")


_KEYS = {"rubric": ["id", "description", "low", "middle", "high"], "grade": ["id", "score", "evidence"]}


def _item_sql(kind: str) -> str:
    """What an item's first departure says, by json functions."""
    keys = _KEYS[kind]
    missing = [f"WHEN NOT list_contains(json_keys(e), '{k}') THEN ': no {k}'" for k in keys]
    more = f"WHEN len(list_filter(json_keys(e), lambda k: NOT list_contains({keys}, k))) > 0 THEN ': also has ' || list_min(list_filter(json_keys(e), lambda k: NOT list_contains({keys}, k)))"
    texts = [f"WHEN length(json_extract_string(e, '$.{k}')) < 1 THEN '.{k}: shorter than 1'" for k in keys if k != "score"]
    score = "WHEN json_extract(e, '$.score')::DOUBLE > 10 THEN '.score: over 10'"
    order = [texts[0], score, texts[1]] if kind == "grade" else texts
    return "CASE " + " ".join([*missing, more, *order]) + " END"


def _list_sql(kind: str, key: str) -> str:
    return f"""SELECT conv_id, turn, kind, CASE WHEN NOT json_valid(reply) THEN 'not JSON' WHEN json_array_length(reply, '$.{key}') = 0 THEN '$.{key}: fewer than 1' ELSE
  (SELECT arg_min('$.{key}[' || (i - 1) || ']' || d, i) FROM (SELECT i, {_item_sql(kind)} AS d FROM (SELECT i, json_extract(reply, '$.{key}[' || (i - 1) || ']') AS e FROM (SELECT unnest(range(1, json_array_length(reply, '$.{key}')::BIGINT + 1)) AS i))) WHERE d IS NOT NULL) END AS departure
  FROM r WHERE kind = '{kind}'"""


_CLOSED = f"""WITH {_REPLIES}, v AS (SELECT conv_id, turn, kind, CASE WHEN json_valid(reply) THEN reply ELSE '{{"criteria":[]}}' END AS ok, reply FROM r)
SELECT conv_id, turn, kind, departure FROM ({_list_sql("rubric", "criteria").replace("json_array_length(reply", "json_array_length(ok").replace("json_extract(reply", "json_extract(ok").replace("FROM r ", "FROM v ")}
  UNION ALL {_list_sql("grade", "scores")}
  UNION ALL SELECT conv_id, turn, kind, CASE WHEN length(json_extract_string(reply, '$.prompt')) < 1 THEN '$.prompt: shorter than 1' WHEN json_type(reply, '$.rationale') <> 'VARCHAR' THEN '$.rationale: not a string' END FROM r WHERE kind = 'proposal')"""


@query("q_closed_schemas", _CLOSED)
def q_closed_schemas(s: SparkSession, d: str) -> DataFrame:
    """Where each reply first departs from the schema of its kind; null where it holds."""
    kinds = {"rubric": schemas.RUBRIC, "grade": schemas.GRADE, "proposal": schemas.PROPOSAL}
    said = F.coalesce(*[F.when(F.col("kind") == k, schemas.departure(F.col("reply"), x)) for k, x in kinds.items()])
    return replies(s, d).select("conv_id", "turn", "kind", said.alias("departure"))
