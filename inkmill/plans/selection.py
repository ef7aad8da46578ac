"""Queries that choose rows: seeded shortlists, and walks that keep them free of conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import sampling
from inkmill.plans.registry import query, table

SEED, SHORTLIST = 20261001, 60
_DRAW = "('0x' || substr(sha256('{seed}:' || {key}), 1, 15))::BIGINT"


@query("q_shortlists", f"SELECT source, doc_id, draw, pos FROM (SELECT source, doc_id, {_DRAW.format(seed=SEED, key='doc_id')} AS draw, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(seed=SEED, key='doc_id')}, doc_id)::INT AS pos FROM documents) WHERE pos <= {SHORTLIST}")
def q_shortlists(s: SparkSession, d: str) -> DataFrame:
    """A shortlist of documents for each source, in an order drawn by a seed."""
    docs = table(s, d, "documents").select("source", "doc_id").withColumn("draw", sampling.seeded(SEED, F.col("doc_id")))
    return sampling.bottom_k(docs, "source", "draw", SHORTLIST, "doc_id")


#: Works to keep of each field, in the order in which fields are walked.
QUOTAS = {"3-MEDIUM": 9, "1-URGENT": 8, "5-LOW": 3, "2-HIGH": 7, "4-NOT SPECIFIED": 6}


def works(s: SparkSession, d: str) -> DataFrame:
    """Orders as works: a field, a place in it drawn by a seed, the parts' suppliers as authors, the customer as the title."""
    authors = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("author"))
    orders = table(s, d, "orders").select(F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey").cast("string")).alias("title"))
    return orders.join(authors, orders.id == authors.l_orderkey).select("field", sampling.seeded(SEED, F.col("id")).alias("pos"), "id", "author", "title")


_WORKS = f"""works AS (SELECT o_orderpriority AS field, o_orderkey AS id, {_DRAW.format(seed=SEED, key='o_orderkey')} AS pos, authors, o_custkey AS title,
  list_position([{", ".join(f"'{f}'" for f in QUOTAS)}], o_orderpriority) AS f FROM orders JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
_FULL = f"[{', '.join(map(str, QUOTAS.values()))}]"
_WALK = f"""WITH RECURSIVE {_WORKS},
walk(f, pos, id, authors, titles, counts) AS (SELECT 0, -1::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[], [{", ".join("0" for _ in QUOTAS)}] UNION ALL
  SELECT n.f, n.pos, n.id, n.a, n.t, n.c FROM (SELECT arg_min({{{{'f': w.f, 'pos': w.pos, 'id': w.id, 'a': list_concat(s.authors, w.authors), 't': list_append(s.titles, w.title), 'c': list_transform(s.counts, lambda x, i: x + (i = w.f)::INT)}}}}, (w.f, w.pos)) AS n
    FROM works w, walk s WHERE (w.f, w.pos) > (s.f, s.pos) AND s.counts[w.f] < {_FULL}[w.f] AND NOT list_has_any(w.authors, s.authors) AND NOT list_contains(s.titles, w.title)) WHERE n IS NOT NULL),
kept AS (SELECT k.f, k.pos, k.id, w.authors, w.title, row_number() OVER (PARTITION BY k.f ORDER BY k.pos) AS n FROM walk k JOIN works w USING (id)),
judged AS (SELECT w.*, (SELECT k.pos FROM kept k WHERE k.f = w.f AND k.n = {_FULL}[w.f]) AS last, EXISTS (SELECT 1 FROM kept k WHERE k.id = w.id) AS is_kept,
  (SELECT arg_min(k.id, (k.f, k.pos)) FROM kept k WHERE (k.f, k.pos) < (w.f, w.pos) AND list_has_any(k.authors, w.authors)) AS by_author,
  (SELECT arg_min(k.id, (k.f, k.pos)) FROM kept k WHERE (k.f, k.pos) < (w.f, w.pos) AND k.title = w.title) AS by_title FROM works w)
SELECT field, pos, id, CASE WHEN is_kept THEN 'kept' WHEN last < pos THEN 'full' WHEN by_author IS NOT NULL THEN 'shared author' ELSE 'shared title' END AS status,
  CASE WHEN NOT is_kept AND (last IS NULL OR pos < last) THEN coalesce(by_author, by_title) END AS holder FROM judged""".replace("{{", "{").replace("}}", "}")


@query("q_conflict_free_walk", _WALK)
def q_conflict_free_walk(s: SparkSession, d: str) -> DataFrame:
    """Works kept field by field up to a quota, none of which shares an author or a title with one kept before, and why the others are not."""
    return sampling.conflict_free(works(s, d), QUOTAS, ["author", "title"])
