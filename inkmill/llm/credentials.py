"""Secret scans by corpus-wide ownership, DataFrame functions only.

Patterns find spans of three base kinds, and runs that look like keys (kind OWNED) where no base span is.
What each span holds is known by a hash. Hashes are counted by the distinct owners and repositories that have
them: a value that many share is an example that was copied; one that stays with an owner, and looks live,
is a credential. Base spans all stay, with their verdict; of the runs, the credentials alone become spans.

Places come from the lengths of what lies between matches, added up by doubling steps, so a text of n matches takes
n log n. Texts are read once and not shuffled. Values are aggregated before they meet, those with over a thousandth of
all spans (so fewer than a thousand) are broadcast, and the others are joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import only, table, written

#: The base kinds, in order, with what they hold and the least length of that.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
OWNED = "owned"
#: Runs that may be keys: of upper and lower case and digits, with so many different characters.
RUN, DIFFERENT = r"[A-Za-z0-9_-]{20,}", 12
#: What a live value has: so many different characters, and none of these words.
LIVE_DIFFERENT, PLACEHOLDER = 6, r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef(g|$)"
#: Owners and repositories that a value may have and still not be widely copied.
MOST_OWNERS, MOST_REPOS = 2, 4
#: A value with more than one in so many of all spans is broadcast.
HOT = 1000
_STEPS = [1 << k for k in range(31)]


def scanned(name: str, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of op over the array in a column: each step takes in those a power of two before."""
    steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s < F.size(name))
    return F.aggregate(steps, F.col(name), lambda a, s: F.transform(a, lambda x, i: F.when(i >= s, op(F.get(a, i - s), x)).otherwise(x)))


def _different(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def _live(value: Column) -> Column:
    return (_different(value) >= LIVE_DIFFERENT) & ~F.rlike(value, F.lit(PLACEHOLDER))


def _matches(df: DataFrame, name: str, pattern: str, group: int, keep: Callable[[Column], Column], kind: int) -> DataFrame:
    """df(t) with name: the matches of pattern in t as (start, kind, end, hash, live), those that keep lets through. kind sorts.

    What lambdas use stands in their elements or in columns, so nothing is worked out again for each element.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(F.rlike("t", F.lit(pattern)), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_v", F.when(F.size("_m") > 0, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col("_m"))
    df = df.withColumn("_p", F.when(F.exists("_v", keep), F.split("t", pattern, -1)))
    # from the end of a match, or the start of the text, to the next match, and the match before it
    gaps = F.zip_with(F.transform("_p", F.length), F.concat(F.array(F.lit(0)), F.transform("_m", F.length)), lambda p, m: p + m)
    df = df.withColumn("_gap", F.when(F.col("_p").isNotNull(), gaps))
    df = df.withColumn("_at", scanned("_gap", lambda a, b: a + b))
    each = F.filter(F.arrays_zip("_at", "_m", "_v"), lambda x: x["_m"].isNotNull() & keep(x["_v"]))
    spans = F.transform(each, lambda x: F.struct(x["_at"].alias("start"), F.lit(kind).alias("kind"), (x["_at"] + F.length(x["_m"])).alias("end"), _hash(x["_v"]).alias("hash"), _live(x["_v"]).alias("live")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>")
    return df.withColumn(name, F.when(F.col("_p").isNotNull(), spans).otherwise(empty)).drop("_m", "_v", "_p", "_gap", "_at")


def _at_least(n: int) -> Callable[[Column], Column]:
    return lambda value: F.length(value) >= n


def _run(value: Column) -> Column:
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[a-z]")) & (_different(value) >= DIFFERENT) & _live(value)


def _apart(df: DataFrame) -> DataFrame:
    """df(base, runs) with c: the spans of base, and those of runs that touch none of them, by start."""
    is_run = lambda s: s["kind"] == len(KINDS)
    df = df.withColumn("_c", F.array_sort(F.concat("base", "runs")))
    df = df.withColumn("_e", F.transform("_c", lambda s: F.when(is_run(s), 0).otherwise(s["end"])))
    df = df.withColumn("_s", F.reverse(F.transform("_c", lambda s: F.when(is_run(s), (1 << 31) - 1).otherwise(s["start"]))))
    df = df.withColumn("_ends", scanned("_e", F.greatest)).withColumn("_later", scanned("_s", F.least)).withColumn("_later", F.reverse("_later"))
    free = F.filter(F.arrays_zip("_c", "_ends", "_later"), lambda x: ~is_run(x["_c"]) | ((x["_ends"] <= x["_c"]["start"]) & (x["_later"] >= x["_c"]["end"])))
    return df.withColumn("c", F.when(F.size("runs") > 0, F.transform(free, lambda x: x["_c"])).otherwise(F.col("_c"))).drop("_c", "_e", "_s", "_ends", "_later")


def candidates(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """(u, doc_id, owner, repo, c) for each row of docs(doc_id, text): c holds its base spans and key-like runs by start. u numbers the rows."""
    df = docs.select(F.monotonically_increasing_id().alias("u"), F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.coalesce("text", F.lit("")).alias("t"))
    for k, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        df = _matches(df, name, pattern, group, _at_least(least), k)
    df = _matches(df, OWNED, RUN, 0, _run, len(KINDS))
    df = df.select("u", "doc_id", "owner", "repo", F.concat(*KINDS).alias("base"), F.col(OWNED).alias("runs"))
    return _apart(df).select("u", "doc_id", "owner", "repo", "c")


def owners(spans: DataFrame) -> DataFrame:
    """(hash, n, owners, repos) of spans(hash, owner, repo): rows, different owners, different pairs of owner and repository. Null is an owner, or repository, of its own."""
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    each = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return each.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text, ...): spans is sorted, of (start, kind, end, hash, live, owners, repos, copied).

    Places are code points, the end exclusive; kind is the number of KINDS, or after them that of OWNED; hash stands for
    the value; live tells whether it looks live, copied whether more than MOST_OWNERS owners or MOST_REPOS repositories have it.
    Base spans all stay; a run is a span if it touches no base span, looks live and is not copied. Null texts are empty and
    have no spans; rows that share an id, or are alike in all, are rows of their own; an empty table gives an empty result.
    """
    rows = written(candidates(docs, owner, repo), "candidates")
    each = rows.select("u", "owner", "repo", F.explode("c").alias("s")).select("u", "owner", "repo", "s.*")
    counts = written(owners(each), "owners")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = counts.withColumn("copied", (F.col("owners") > MOST_OWNERS) | (F.col("repos") > MOST_REPOS))
    hot = F.col("n") * HOT > total
    told, rest = F.broadcast(counts.where(hot)), counts.where(~hot)
    judged = each.join(told, "hash").unionByName(each.join(told.select("hash"), "hash", "left_anti").join(rest, "hash"))
    judged = judged.where((F.col("kind") < len(KINDS)) | (F.col("live") & ~F.col("copied")))
    spans = judged.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "live", "owners", "repos", "copied"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,live:boolean,owners:bigint,repos:bigint,copied:boolean>>")
    found = rows.where(F.size("c") > 0).select("u", "doc_id").join(spans, "u", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return found.unionByName(rows.where(F.size("c") == 0).select("doc_id", none.alias("spans")))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, OWNED]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Documents have no repositories: their sources are owners, and a source's languages its repositories."""
    docs = table(spark, sf_dir, "documents")
    found = scan(only(docs, "doc_id", "text", "source", "lang"), F.col("source"), F.col("lang"))
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    of = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    kinds = [count(of(k)).alias(f"n_{name}") for k, name in enumerate([*KINDS, OWNED])]
    return found.select("doc_id", *kinds[:-1], F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), kinds[-1], count(lambda s: s["live"] & ~s["copied"]).alias("n_live"), count(lambda s: s["copied"]).alias("n_copied"))


def _find(kind: int, pattern: str, group: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT u, {kind} AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, v[i] AS v FROM
  (SELECT u, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT u, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, regexp_split_to_array(t, '{quoted}') AS p FROM d)) WHERE {keep.format(v="v[i]")}"""


_DIFFERENT = "len(list_distinct(string_split({v}, '')))"
_LIVE = _DIFFERENT + f" >= {LIVE_DIFFERENT} AND NOT regexp_matches({{v}}, '{PLACEHOLDER}')"
_RUN = "regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '[A-Z]') AND regexp_matches({v}, '[a-z]') AND " + _DIFFERENT + f" >= {DIFFERENT} AND " + _LIVE
_NAMES = "['" + "', '".join([*KINDS, OWNED]) + "']"
_SAY = f"string_agg({_NAMES}[kind + 1] || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, kind)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_find(k, p, g, f"length({{v}}) >= {n}") for k, (p, g, n) in enumerate(KINDS.values()))}),
runs AS ({_find(len(KINDS), RUN, 0, _RUN)}),
c AS (SELECT * FROM base UNION ALL SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.u = r.u AND b.a < r.a + r.n AND r.a < b.a + b.n)),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT (coalesce('=' || source, ''), coalesce('=' || lang, ''))) AS repos FROM c JOIN d USING (u) GROUP BY v),
j AS (SELECT c.*, owners > {MOST_OWNERS} OR repos > {MOST_REPOS} AS copied, {_LIVE.format(v="v")} AS live FROM c JOIN o USING (v)),
s AS (SELECT * FROM j WHERE kind < {len(KINDS)} OR live AND NOT copied)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate([*KINDS, OWNED]))}, sha256(coalesce({_SAY} FILTER (kind < {len(KINDS)}), '')) AS base_sha256, coalesce({_SAY} FILTER (kind IS NOT NULL), '') AS spans,
  count(*) FILTER (live AND NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM d LEFT JOIN s USING (u) GROUP BY u
"""
