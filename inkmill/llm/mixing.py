"""A time-varying curriculum over sources, DataFrame functions only.

Each source has a target of words, and a schedule: its share of the mix at time t in [0, 1] is in
proportion to 1 + tilt * (2t - 1). The schedule's integral up to t, over that up to 1, is the part of
the target that the mix has demanded by t. A source's documents stand in a seeded order; the words
before a document are the demand at which it is needed; inverting the integral gives its position.
Documents are range-sorted by position.

Running sums are by three levels of hash ranges, each about the cube root of the rows wide, so that a
source with a third of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import ROW, carried, numbered, only, row_key, table, written
from inkmill.llm.quality import words_of

SHARE, MOST_REPEATS, WEIGHTS, SEED = 1.5, 2, (5.0, 2.0, 1.0), 42
#: Sources of each weight lean to the start (negative) or the end of training.
TILTS = (-0.8, 0.0, 0.8)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...) with rank, from 1, in code-point order, null last; numbered range by range, so that no task has all of them."""
    some = sources.where("source is not null").repartitionByRange(F.col("source")).withColumn("part", F.spark_partition_id())
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("source")))
    some = written(some.unionByName(sources.where("source is null").withColumns({"part": F.lit(1 << 30), "nth": F.lit(1)})), "ranked")
    # a row for each range
    ends = some.groupBy("part").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return some.join(F.broadcast(ends.select("part", "earlier")), "part").withColumn("rank", F.col("earlier") + F.col("nth")).drop("part", "nth", "earlier")


def targets(sizes: DataFrame, share: float = SHARE, repeats: float = MOST_REPEATS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target, tilt) from sizes(source, size): a row for each source.

    Sources in code-point order, null last, weigh weights, repeating, and share share * all sizes; none gets
    more than repeats * its size, and the excess goes to the others by weight. The words a unit of weight
    gets only rise as sources reach their limit, so each round settles those that have; a round is one sum
    over sources, of which three numbers reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = (F.col("rank") - 1) % len(weights)
    per = ranked(per).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), k)).withColumn("tilt", F.get(F.array(*[F.lit(t) for t in TILTS]), k % len(TILTS)))
    per = written(per.withColumn("most", F.lit(float(repeats)) * F.col("source_size")), "weighed")
    level, settled = -1.0, -1
    while True:
        full = (F.col("most") <= F.lit(level) * F.col("weight")) if level >= 0 else F.lit(False)
        zero = F.lit(0.0)
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(zero)).alias("taken"), F.sum(F.when(full, zero).otherwise(F.col("weight"))).alias("weight"), F.count_if(full).alias("full")).first()
        if not r.weight or r.full == settled:
            break
        level, settled = (share * r.all - r.taken) / r.weight, r.full
    target = F.when(F.col("most") <= F.lit(level) * F.col("weight"), F.col("most")).otherwise(F.lit(level) * F.col("weight")) if settled >= 0 and r.weight else F.col("most")
    return per.select("source", "source_size", target.alias("target"), "tilt")


def running(df: DataFrame, key: str, order: str, value: str, ties: list[str], rows: int) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same key that come earlier by (order, *ties); order is uniform from 0 to 2^60."""
    wide = max(1, round(rows ** (1 / 3)))
    step = (1 << 60) // (wide * wide) + 1
    df = df.withColumn("b2", F.expr(f"{order} div {step}L")).withColumn("b1", F.floor(F.col("b2") / wide).cast("long"))
    earlier = Window.unboundedPreceding, -1
    two = df.groupBy(key, "b1", "b2").agg(F.sum(value).alias("s"))
    one = two.groupBy(key, "b1").agg(F.sum("s").alias("s"))
    one = one.select(key, "b1", F.coalesce(F.sum("s").over(Window.partitionBy(key).orderBy("b1").rowsBetween(*earlier)), F.lit(0)).alias("p1"))
    two = two.select(key, "b1", "b2", F.coalesce(F.sum("s").over(Window.partitionBy(key, "b1").orderBy("b2").rowsBetween(*earlier)), F.lit(0)).alias("p2"))
    two = two.alias("x").join(one.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & (F.col("x.b1") == F.col("y.b1")))
    two = two.select(F.col(f"x.{key}").alias("k_"), F.col("x.b2").alias("b2_"), (F.col("p1") + F.col("p2")).alias("p"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(key, "b2").orderBy(order, *ties).rowsBetween(*earlier)), F.lit(0))
    inner = df.withColumn("own", own)
    out = inner.join(two, F.col(key).eqNullSafe(F.col("k_")) & (F.col("b2") == F.col("b2_")))
    return out.withColumn("before", F.col("p") + F.col("own")).drop("k_", "b2_", "p", "own", "b1", "b2")


def position(part: Column, tilt: Column) -> Column:
    """The t at which the integral of 1 + tilt * (2t - 1) over [0, t], (1 - tilt) t + tilt t^2, reaches part."""
    a = 1 - tilt
    return F.when(F.abs(tilt) < 1e-9, part).otherwise((F.sqrt(F.greatest(a * a + 4 * tilt * part, F.lit(0.0))) - a) / (2 * tilt))


def mixed(docs: DataFrame, *keys: str) -> DataFrame:
    """For each row of docs(doc_id, text, source): keys, size, source_size, target, taken, position, positions, sorted by position.

    taken is the words that the mix takes, repeats counted: every whole pass over the source, and one more
    of the documents that come first in its order; the document at the boundary gives the words that are
    left, so that a source's taken words are its target, rounded. positions has a place for each time that the
    document is taken: the k-th pass over a source is needed at the words before the document and k times the
    source's size; position is the first. Null texts have no words and null
    sources are one source, last in order. A document that isn't taken has no positions, and null as position.
    An empty table gives an empty result. Rows are told apart by id and text, so those that share an id, or
    have none, have places of their own, however they are dealt; rows alike in both stand one after the other.
    """
    rows = only(docs, *keys, "doc_id", "text", "source").select(*keys, "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("th"))
    said = F.concat(F.lit(f"{SEED} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.col("th"))
    rows = rows.withColumn("order", F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long"))
    # rows alike in all are counted before they travel, and dealt out again when their place is known
    sizes = written(rows.groupBy(*keys, "doc_id", "source", "size", "th", "order").agg(F.count("*").alias("copies")).withColumn("whole", F.col("size") * F.col("copies")), "sizes")
    n = sizes.count()
    per = written(targets(sizes.select("source", F.col("whole").alias("size"))), "targets").withColumnRenamed("source", "t_source")
    ordered = running(sizes, "source", "order", "whole", ["doc_id", "th", "size", *keys], n)
    ordered = ordered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    df = ordered.join(per, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    df = df.withColumn("taken", (passes * F.col("size") + extra).cast("long"))
    # a document is taken once in each whole pass, and once more if the pass that is cut short reaches it
    times = F.when(F.col("taken") > 0, passes + F.when(extra > 0, 1).otherwise(0)).otherwise(0)
    demand = lambda k: F.least(F.lit(1.0), (F.col("before") + k * F.col("source_size")) / goal)
    nth = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda k: F.abs(position(demand(k), F.col("tilt")))))
    df = df.withColumn("positions", F.coalesce(nth, F.array().cast("array<double>"))).withColumn("position", F.get("positions", F.lit(0)))
    return df.select(*keys, "doc_id", "size", "source_size", "target", "taken", "position", "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.withColumn("position", F.round("position", 9)).withColumn("positions", F.transform("positions", lambda x: F.round(x, 9)))


_POSITION = "abs(CASE WHEN abs(tilt) < 1e-9 THEN {p} ELSE (sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * {p}, 0.0)) - (1 - tilt)) / (2 * tilt) END)"
_NTH = _POSITION.format(p="least(1.0::DOUBLE, (before + x * source_size) / goal::DOUBLE)")
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS th FROM documents),
o AS (SELECT *, ('0x' || substr(md5('{SEED} ' || coalesce(doc_id::VARCHAR, '-') || ' ' || th), 1, 15))::BIGINT AS o FROM d),
b AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, th, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM o),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) AS k FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}][k % {len(WEIGHTS)} + 1] AS weight, [{", ".join(f"{x}::DOUBLE" for x in TILTS)}][k % {len(WEIGHTS)} % {len(TILTS)} + 1] AS tilt, {MOST_REPEATS}::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, row_number() OVER z AS rank, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW z AS (ORDER BY most / weight, k)),
t AS (SELECT source, source_size, tilt, CASE WHEN most <= level * weight THEN most ELSE (SELECT arg_min(level, rank) FROM r WHERE most > level * weight) * weight END AS target FROM r),
g AS (SELECT b.*, source_size, tilt, target, round(target)::BIGINT AS goal FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM g),
e AS (SELECT *, greatest(0, least(size, goal - passes * source_size - before)) AS extra FROM p),
n AS (SELECT *, (passes * size + extra)::BIGINT AS taken, CASE WHEN passes * size + extra > 0 THEN passes + (extra > 0)::INT ELSE 0 END AS times FROM e),
f AS (SELECT *, list_transform(range(times), lambda x: round({_NTH}, 9)) AS positions FROM n)
SELECT doc_id, size, source_size, target, taken, positions[1] AS position, positions FROM f
"""


@carried("pass", "taken", "position")
def in_order(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, a row each time, with pass, taken (words) and position, sorted by position.

    Columns of those names are replaced. Rows with null or repeated ids are rows of their own (see mixed());
    texts without words are not taken; an empty table gives an empty result.
    """
    plan = mixed(docs.withColumn("_key", row_key(*ROW)), "_key").where("taken > 0")
    # equal rows have the same key: each takes one of their plans
    plan = plan.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("positions", "size", "taken"))).alias("_plans"))
    rows = numbered(docs, *ROW).join(plan, "_key").withColumn("_plan", F.get("_plans", F.col("_n") - 1)).where("_plan is not null")
    rows = rows.select(*docs.columns, F.col("_plan.size").alias("_size"), F.col("_plan.taken").alias("_all"), F.posexplode("_plan.positions").alias("pass", "position"))
    rows = rows.withColumn("taken", F.least("_size", F.col("_all") - F.col("pass") * F.col("_size")))
    return rows.select(*docs.columns, "pass", "taken", "position").orderBy("position", "doc_id", "pass")
