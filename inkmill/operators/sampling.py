"""Seeded shortlists by field, and the walk over them that keeps rows free of conflicts up to a quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.sources.stages import removed, stage

#: Bits of a draw that its histogram tells apart; rows up to which a side is broadcast; parts of a key's rows beyond that.
BITS, MOST_BROADCAST, SALT = 12, 200_000, 32
#: Bits of a place by which places are counted before they are sorted; rows of a chunk for each row that a quota lacks.
COARSE, CHUNK = 18, 8


def seeded(seed: int, key: Column) -> Column:
    """A draw for each key: 60 bits of a digest of the seed and the key, which any engine can make."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15), 16, 10).cast("long")


def bottom_k(rows: DataFrame, field: str, draw: str, k: int, *ties: str) -> DataFrame:
    """rows(field, draw, ...) with pos, from 1: the k of the least draws of each field, ties by the columns named; null is a field, and null draws come first.

    A histogram of draws by field, which adds up before it travels, tells how far the k reach; only rows
    up to there are sorted. Draws are 60 bits and evenly spread, else a field's rows may share a bucket.
    """
    bucket = F.coalesce(F.shiftright(draw, 60 - BITS), F.lit(-1))
    counts = rows.groupBy(F.col(field).alias("_f"), bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = counts.withColumn("_before", before).where(F.col("_before") < k).groupBy("_f").agg(F.max("_b").alias("_last"))
    near = rows.join(F.broadcast(reach) if reach.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else reach, F.col(field).eqNullSafe(F.col("_f")) & (bucket <= F.col("_last")))
    place = F.row_number().over(Window.partitionBy(field).orderBy(F.col(draw).asc_nulls_first(), *ties))
    return near.drop("_f", "_last").withColumn("pos", place).where(F.col("pos") <= k)


def _with(rows: DataFrame, by: str, told: DataFrame) -> DataFrame:
    """rows joined with told, which has a row for each value of by. Many rows may share one: told is broadcast if it is small, else dealt out with it."""
    if told.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(told), by)
    told = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("at"), F.lit(SALT)).cast("int")).join(told, [by, "_salt"]).drop("_salt")


def _in_quota(rows: DataFrame, quota: DataFrame, bits: int) -> DataFrame:
    """Of rows(field_no, at, ...), those of which fewer than the field's quota come before."""
    near = F.shiftright("at.pos", max(0, bits - COARSE))
    counts = rows.groupBy("field_no", near.alias("_b")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("field_no").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("_before", before).join(F.broadcast(quota), "field_no").where("_before < quota").select("field_no", "_b", "_before", "quota")
    rows = rows.withColumn("_b", near).join(open_, ["field_no", "_b"])
    place = F.row_number().over(Window.partitionBy("field_no", "_b").orderBy("at")) + F.col("_before")
    return rows.withColumn("_place", place).where("_place <= quota").drop("_b", "_before", "quota", "_place")


def _reach(rows: DataFrame, size: int, near: Column) -> tuple[int | None, int]:
    """The range of places in which the first size of rows end, and how many rows there are up to its end. Rows are counted by ranges, not sorted."""
    counts = rows.groupBy(near.alias("b")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("b"))
    told = counts.select("b", upto.alias("upto"), (upto - F.col("n")).alias("before")).where(F.col("before") < size).agg(F.max("b"), F.max("upto")).first()
    return told[0], told[1] or 0


def _walk_chunk(chunk: DataFrame, kept: DataFrame, quota: DataFrame, bits: int) -> DataFrame:
    """Of chunk(at, keys), a stage, the rows that the walk keeps after kept(at, key), quota(field_no, quota) at most: (at, key), as kept has them."""
    links = stage(chunk.select("at", F.explode("keys").alias("key")), "keys")
    out = _with(links, "key", kept.where("key is not null").select("key").distinct()).select("at").distinct()
    open_ = stage(chunk.select("at", F.size("keys").cast("long").alias("n")).join(out, "at", "left_anti"), "open")
    won_by = stage(open_.select("at").limit(0), "new")
    while not open_.isEmpty():
        mine = links.join(open_.select("at"), "at", "left_semi")
        wins = mine.groupBy("key").agg(F.min("at").alias("at")).groupBy("at").agg(F.count("*").alias("won"))
        # rows kept in an earlier round may come after open ones, so those that fit are counted from all there are
        fits = _in_quota(open_.unionByName(won_by.select("at", F.lit(None).cast("long").alias("n"))).withColumn("field_no", F.col("at.field_no")), quota, bits)
        new = stage(fits.where("n is not null").join(wins, "at", "left").where("coalesce(won, 0) = n").select("at"), "new")
        held = links.join(new, "at", "left_semi").select("key").distinct()
        out = _with(mine, "key", held).select("at").distinct()
        more = stage(won_by.unionByName(new), "new")
        full = more.groupBy(F.col("at.field_no").alias("field_no")).agg(F.count("*").alias("k")).join(quota, "field_no").where("k >= quota")
        left = open_.join(new, "at", "left_anti").join(out, "at", "left_anti")
        left = stage(left.limit(0) if not full.isEmpty() else left, "open")
        for x in (new, open_, won_by):
            removed(x)
        open_, won_by = left, more
    found = stage(won_by.join(chunk, "at").select("at", F.explode_outer("keys").alias("key")), "won")
    for x in (links, open_, won_by):
        removed(x)
    return found


def conflict_free(rows: DataFrame, quotas: dict[str, int], keys: list[str], bits: int = 60) -> DataFrame:
    """(field, pos, id, status, holder): a walk over the fields in the order of quotas, each by pos, that keeps the first rows up to the field's quota which share no key with a row kept before.

    rows(field, pos, id, one array of strings for each name in keys); pos is from 0, under 2^bits and more or less evenly
    spread, as draws or numbers are; ids, which are unique, order rows of one place. Status is kept; shared and the first name of keys that has a shared key, with the holder's id; or full, where the quota was
    reached before. Fields without a quota have no rows here; null keys are none, empty ones are keys like others.

    The walk goes through the fields in order, and through a field in chunks of its first rows by place that share no key
    with a row kept before; a chunk has a few times as many rows as the quota lacks, the next one twice that. So what is
    sorted and joined follows the quotas, not the table; the table is read once for each chunk, and at the end. Within a
    chunk the walk is done in rounds on the graph whose edges are shared keys, without making its pairs: a row is settled
    once no row before it that shares a key is open, and all rows before it that are open would fit into the quota too: it
    is the least open row of all its keys. Rows that share a key with it leave. The least open row can always be settled,
    so the rounds end, and they come to what the walk does row by row.
    """
    spark = rows.sparkSession
    fields = spark.createDataFrame([(f, i, n) for i, (f, n) in enumerate(quotas.items())], "field string, field_no int, quota long")
    quota = fields.select("field_no", "quota")
    of = lambda j: lambda x: F.struct(F.lit(j).alias("kind"), x.alias("value"))
    named = [F.transform(F.array_distinct(F.array_compact(k)), of(j)) for j, k in enumerate(keys)]
    at = F.struct("field_no", "pos", "id")
    all_rows = stage(rows.join(F.broadcast(fields), "field").select("field_no", "field", "pos", "id", at.alias("at"), F.concat(*named).alias("keys")), "walk")
    links = all_rows.select("at", F.explode("keys").alias("key"))
    kept = stage(links.limit(0), "kept")  # a row for each key of a kept row; those without keys have one of a null key
    near = F.shiftright("pos", max(0, bits - COARSE))
    for number, most in enumerate(quotas.values()):
        lacking, begin, size = most, -1, CHUNK * most
        while lacking > 0:
            ahead = all_rows.where((F.col("field_no") == number) & (near > begin)).select("at", "keys", "pos")
            end, n = _reach(ahead, size, near)
            if not n:
                break
            chunk = stage(ahead.where(near <= end).select("at", "keys"), "chunk")
            new = _walk_chunk(chunk, kept, quota.where(F.col("field_no") == number).withColumn("quota", F.lit(lacking).cast("long")), bits)
            found = new.select("at").distinct().count()
            if found:
                kept, last = stage(kept.unionByName(new), "kept"), kept
                removed(last)
            for x in (new, chunk):
                removed(x)
            lacking, begin, size = lacking - found, end, 2 * size
    links_kept, kept = kept.where("key is not null"), kept.select("at", F.col("at.field_no").alias("field_no")).distinct()
    # why the others are not kept: the first key, by kind, that a row kept before holds, unless the field was full by then
    held = links_kept.select("key", F.col("at").alias("by"))
    clash = _with(links, "key", held).where("by < at").groupBy("at").agg(F.min(F.struct(F.col("key.kind").alias("kind"), "by")).alias("c"))
    ends = kept.join(quota, "field_no").withColumn("k", F.row_number().over(Window.partitionBy("field_no").orderBy("at"))).where("k = quota").select("field_no", F.col("at").alias("end"))
    judged = all_rows.join(kept.select("at", F.lit(True).alias("is_kept")), "at", "left").join(clash, "at", "left").join(F.broadcast(ends), "field_no", "left")
    judged = judged.join(F.broadcast(quota), "field_no")
    shared = F.concat(F.lit("shared "), F.get(F.array(*map(F.lit, keys)), F.col("c.kind")))
    status = F.when(F.col("is_kept"), "kept").when((F.col("quota") <= 0) | (F.col("end") < F.col("at")), "full").otherwise(shared)
    return judged.select("field", "pos", "id", status.alias("status"), F.when(F.startswith(status, F.lit("shared")), F.col("c.by.id")).alias("holder"))
