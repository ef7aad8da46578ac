"""Queries that choose books out of catalogs, and the interval of a gap over resampled sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import text
from inkmill.operators import catalogs, intervals
from inkmill.plans.queries import _ROWS, WSW, score_rows
from inkmill.plans.registry import query, table

_ROWS_OF = """b AS (SELECT doc_id AS book_id, CASE WHEN doc_id % 9 = 0 THEN 'Sound' ELSE 'Text' END AS type, coalesce(text, '') AS t, CASE WHEN lang = 'en' OR doc_id % 4 = 0 THEN 'en' ELSE lang END AS language, source, doc_id,
  CASE WHEN doc_id % 10 = 0 THEN source || '; other' WHEN doc_id % 10 = 1 THEN source || ' ; x [Illustrator]; ' WHEN doc_id % 10 = 2 THEN source || '; y [Translator]' WHEN doc_id % 10 = 3 THEN 'z [Editor]' ELSE source END AS authors,
  CASE WHEN doc_id % 7 = 0 THEN 'History' WHEN doc_id % 7 = 1 THEN 'Fiction -- Juvenile' WHEN doc_id % 7 = 2 THEN 'Short STORIES; fiction' ELSE 'Science FICTION; ' || lang END AS subjects,
  CASE doc_id % 8 WHEN 0 THEN 'Vol. iv of ' WHEN 1 THEN 'Volumes of ' WHEN 2 THEN 'SKETCHES\n and ' WHEN 3 THEN 'vol 3 ' ELSE ' ' END AS prefix FROM documents)"""


def catalog_rows(s: SparkSession, d: str) -> DataFrame:
    """Documents as rows of a catalog: the source's name among the authors, the text as the title, with what the rules look for."""
    i = F.col("doc_id")
    of = lambda n, *cases: F.coalesce(*[F.when(i % n == k, x) for k, x in cases[:-1]], cases[-1])
    source, lit = F.col("source"), F.lit
    return table(s, d, "documents").select(
        i.alias("book_id"), of(9, (0, lit("Sound")), lit("Text")).alias("type"),
        F.concat(of(8, (0, lit("Vol. iv of ")), (1, lit("Volumes of ")), (2, lit("SKETCHES\n and ")), (3, lit("vol 3 ")), lit(" ")), F.coalesce("text", lit(""))).alias("title"),
        F.when((F.col("lang") == "en") | (i % 4 == 0), "en").otherwise(F.col("lang")).alias("language"),
        of(10, (0, F.concat(source, lit("; other"))), (1, F.concat(source, lit(" ; x [Illustrator]; "))), (2, F.concat(source, lit("; y [Translator]"))), (3, lit("z [Editor]")), source).alias("authors"),
        of(7, (0, lit("History")), (1, lit("Fiction -- Juvenile")), (2, lit("Short STORIES; fiction")), F.concat(lit("Science FICTION; "), F.col("lang"))).alias("subjects"),
    )


_CATALOG = f"""{_ROWS_OF}, n AS (SELECT *, trim(regexp_replace(prefix || t, '\\s+', ' ', 'g')) AS title, list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '') AS names FROM b),
p AS (SELECT *, list_filter(names, lambda x: NOT contains(x, '[')) AS first, replace(lower(subjects), 'ß', 'ss') AS sub FROM n),
c AS (SELECT book_id, title, CASE WHEN len(first) = 1 THEN first[1] END AS author, subjects, CASE WHEN type <> 'Text' THEN 'not a text' WHEN language <> 'en' THEN 'not in English' WHEN book_id % 50 = 7 THEN 'excluded' WHEN len(first) <> 1 THEN 'not one principal author'
  WHEN first[1] NOT IN (SELECT source FROM documents GROUP BY 1 HAVING min(doc_id) % 5 <> 2) THEN 'not an author of the list' WHEN len(list_filter(names, lambda x: contains(x, '[') AND NOT suffix(x, '[Illustrator]'))) > 0 THEN 'names others than illustrators'
  WHEN NOT contains(sub, 'fiction') THEN 'not fiction' WHEN regexp_matches(sub, 'short stories|drama|poetry|juvenile') THEN 'another kind of fiction'
  WHEN regexp_matches(title, '(?i)\\bvol(?:ume|\\.)?\\s*(?:\\d|[ivx]+\\b)|\\b(?:stories|tales|essays|sketches)\\b') THEN 'a volume or a collection' END AS reason FROM p)"""


def _chosen(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    authors = docs.groupBy("source").agg(F.min("doc_id").alias("first")).where("first % 5 <> 2").select(F.col("source").alias("name"))
    return catalogs.catalog(catalog_rows(s, d), authors, docs.where("doc_id % 50 = 7").select(F.col("doc_id").alias("book_id")))


@query("q_catalog_novels", f"WITH {_CATALOG} SELECT book_id, sha256(title) AS title_hash, author, subjects, reason FROM c")
def q_catalog_novels(s: SparkSession, d: str) -> DataFrame:
    """Novels of the list's authors in a catalog, and the rule that each other row breaks first."""
    return _chosen(s, d).select("book_id", F.sha2("title", 256).alias("title_hash"), "author", "subjects", "reason")


@query("q_eligible_books", f"""WITH {_CATALOG} SELECT book_id, CASE WHEN book_id % 6 = 0 THEN 'Rights: ' || CASE WHEN book_id % 12 = 0 THEN 'Copyrighted.' ELSE '' END WHEN n * 40 < 30000 THEN 'Story has ' || n * 40 || ' words; at least 30000 required' END AS reason
  FROM c JOIN (SELECT doc_id AS book_id, len({WSW}) AS n FROM documents) USING (book_id) WHERE reason IS NULL""")
def q_eligible_books(s: SparkSession, d: str) -> DataFrame:
    """Of the novels, those in the public domain and long enough: a document stands for a story forty times as long."""
    i = F.col("book_id")
    rights = F.when(i % 6 != 0, catalogs.RIGHTS).when(i % 12 == 0, "Copyrighted.")
    lengths = table(s, d, "documents").select(F.col("doc_id").alias("book_id"), (F.size(text.ws_words(F.col("text"))) * 40).alias("story_words"))
    novels = _chosen(s, d).where("reason is null").select("book_id", rights.alias("rights")).join(lengths, "book_id")
    return catalogs.eligible(novels).select("book_id", "reason")


REPLICATES, SEED = 200, 7
_DRAW = "('0x' || substr(sha256('{seed}:' || {key}), 1, 15))::BIGINT"
_INTERVAL = f"""WITH {_ROWS}, per AS (SELECT checkpoint, source_id, coalesce(sum(gap::DECIMAL(20,6)), 0) AS s, count(gap) AS n FROM rows_ GROUP BY 1, 2),
names AS (SELECT source_id, row_number() OVER (ORDER BY {_DRAW.format(seed=SEED, key="coalesce('=' || source_id, '')")}, source_id) - 1 AS i FROM (SELECT DISTINCT source_id FROM per)),
picks AS (SELECT b, {_DRAW.format(seed=SEED, key="b || ':' || i")} % (SELECT count(*) FROM names) AS i FROM names, (SELECT unnest(range({REPLICATES})) AS b)),
m AS (SELECT checkpoint, b, sum(s)::DOUBLE / sum(n) AS m FROM picks JOIN names USING (i) JOIN per p ON p.source_id IS NOT DISTINCT FROM names.source_id GROUP BY 1, 2 HAVING sum(n) > 0),
e AS (SELECT checkpoint, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1)
SELECT checkpoint, count(*) FILTER (n > 0) AS sources, sum(n)::BIGINT AS n, round(sum(s)::DOUBLE / sum(n), 6) AS mean, any_value(low) AS low, any_value(high) AS high FROM per LEFT JOIN e USING (checkpoint) GROUP BY 1"""


@query("q_source_interval", _INTERVAL)
def q_source_interval(s: SparkSession, d: str) -> DataFrame:
    """Each checkpoint's mean gap and its interval over resampled sources."""
    return intervals.source_interval(score_rows(s, d), ["checkpoint"], "source_id", "gap", REPLICATES, SEED)
