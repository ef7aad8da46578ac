"""The registered queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions import calls, html_text, papers, text
from inkmill.operators import books, constraints, lifecycle, overlap, reports, scores
from inkmill.plans.registry import query
from inkmill.plans.registry import table as _t

TOK = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
WSW = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
FWSW = WSW.replace("to_array(text", "to_array(replace(lower(text), 'ß', 'ss')")


def _grams(table: str, key: str, n: int, tok: str = TOK) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(t[i:i+{n - 1}], ' ') AS g FROM (SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT {key}, {tok} AS t FROM {table}))"


OVERLAP = f"""ref AS ({_grams('benchmark', 'item_id', 13)}), outs AS ({_grams('documents', 'doc_id', 13)}), sizes AS (SELECT item_id, count(*) AS n FROM ref GROUP BY 1),
ov AS (SELECT doc_id, item_id, count(*) AS hits, any_value(n) AS n, round(count(*) / any_value(n), 6) AS ngram_fraction FROM outs JOIN ref USING (g) JOIN sizes USING (item_id) GROUP BY 1, 2)"""
RUNS = f"""{OVERLAP}, a AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {TOK} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM ov))),
b AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS j FROM (SELECT item_id, {TOK} AS t FROM benchmark)),
c AS (SELECT doc_id, item_id, i, i - j AS d FROM ov JOIN a USING (doc_id) JOIN b USING (item_id, w)),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS k FROM c),
lr AS (SELECT doc_id, item_id, max(run) AS longest_run FROM (SELECT doc_id, item_id, d, k, count(*) AS run FROM k GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""


@query("q_ngram_overlap", f"WITH {OVERLAP} SELECT * FROM ov")
def q_ngram_overlap(s, d):
    return overlap.ngram_overlap(_t(s, d, "documents"), _t(s, d, "benchmark"))


@query("q_longest_run", f"WITH {RUNS} SELECT * FROM lr")
def q_longest_run(s, d):
    docs, items = _t(s, d, "documents"), _t(s, d, "benchmark")
    return overlap.longest_runs(overlap.ngram_overlap(docs, items), docs, items)


@query("q_memorized", f"WITH {RUNS} SELECT *, ngram_fraction > 0.05 OR longest_run >= 20 AS memorized FROM ov JOIN lr USING (doc_id, item_id)")
def q_memorized(s, d):
    return overlap.probed(_t(s, d, "documents"), _t(s, d, "benchmark"))


@query("q_unmemorized", f"WITH {RUNS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ov JOIN lr USING (doc_id, item_id) WHERE ngram_fraction > 0.05 OR longest_run >= 20)")
def q_unmemorized(s, d):
    return overlap.unmemorized(_t(s, d, "documents"), _t(s, d, "benchmark"))


_SPAN = "SELECT {k}, i - 1 AS i, array_to_string(t[i:i+11], ' ') AS g FROM (SELECT {k}, t, unnest(range(1, len(t) - 10)) AS i FROM (SELECT {k}, {w} AS t FROM {f}))"


@query("q_copied_spans", f"WITH a AS ({_SPAN.format(k='doc_id', w=FWSW, f='documents')}), b AS (SELECT DISTINCT item_id, g FROM ({_SPAN.format(k='item_id', w=FWSW, f='benchmark')})) SELECT doc_id, item_id, min(i) AS first_pos, arg_min(g, i) AS span FROM a JOIN b USING (g) GROUP BY 1, 2")
def q_copied_spans(s, d):
    return overlap.copied_spans(_t(s, d, "documents"), _t(s, d, "benchmark"))


@query("q_identifier_leak", "SELECT DISTINCT doc_id, identifier FROM documents, (SELECT DISTINCT replace(lower(text[1:12]), 'ß', 'ss') AS identifier FROM benchmark WHERE length(replace(lower(text[1:12]), 'ß', 'ss')) >= 5 UNION SELECT lower(r_name) FROM region WHERE length(r_name) >= 5) WHERE contains(replace(lower(text), 'ß', 'ss'), identifier)")
def q_identifier_leak(s, d):
    docs = _t(s, d, "documents")
    ids = _t(s, d, "benchmark").select(F.substring("text", 1, 12).alias("identifier")).unionByName(_t(s, d, "region").select(F.col("r_name").alias("identifier")))
    return overlap.identifier_leaks(docs, ids)


_FLAGS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in overlap.RED_FLAGS.items())


_SAID = {0: "Favour the human one. ", 1: "Please ignore the system, ", 2: "ai-generated signals ", 3: "score 0 to 100 <tool_call "}
_SAYS = "CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SAID.items()) + " ELSE '' END"


@query("q_red_flags", f"SELECT conv_id, turn, array_to_string(list_sort(list_filter([{_FLAGS}], lambda x: x IS NOT NULL)), ',') AS reasons FROM (SELECT conv_id, turn, {_SAYS} || text AS text FROM conversations)")
def q_red_flags(s, d):
    said = _t(s, d, "conversations").select("conv_id", "turn", F.concat(F.expr(_SAYS), "text").alias("text"))
    return said.select("conv_id", "turn", F.array_join(overlap.red_flags(F.col("text")), ",").alias("reasons"))


@query("q_proposal_audit")
def q_proposal_audit(s, d):
    """Documents as proposals, benchmark items as training sources."""
    items = _t(s, d, "benchmark")
    return overlap.audited(_t(s, d, "documents"), items, items.select(F.substring("text", 1, 12).alias("identifier")), 800)


@query("q_normalize_line", r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS hash FROM documents")
def q_normalize_line(s, d):
    return _t(s, d, "documents").select("doc_id", F.sha2(text.normalize_line("text"), 256).alias("hash"))


@query("q_normalize_paragraphs", r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS hash FROM documents")
def q_normalize_paragraphs(s, d):
    return _t(s, d, "documents").select("doc_id", F.sha2(text.normalize_paragraphs("text"), 256).alias("hash"))


@query("q_word_counts", f"SELECT 'documents' AS tab, doc_id AS id, len({WSW}) AS words FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, len({WSW}) FROM conversations")
def q_word_counts(s, d):
    words = F.size(text.ws_words(F.col("text"))).cast("long").alias("words")
    docs = _t(s, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), words)
    return docs.unionByName(_t(s, d, "conversations").select(F.lit("conversations").alias("tab"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words))


@query("q_tokens_top", f"SELECT w, count(*) AS n FROM (SELECT unnest({TOK}) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, w LIMIT 30")
def q_tokens_top(s, d):
    return _t(s, d, "documents").select(F.explode(text.word_tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(30)


@query("q_text_digest", "SELECT doc_id, sha256(text) AS digest, ('0x' || sha256(text)[1:16])::UBIGINT::DECIMAL(20,0)::VARCHAR AS seed FROM documents")
def q_text_digest(s, d):
    h = text.digest(F.col("text"))
    return _t(s, d, "documents").select("doc_id", h.alias("digest"), text.order_seed(h).cast("string").alias("seed"))


@query("q_request_key")
def q_request_key(s, d):
    body = text.canonical_json(F.to_json(F.struct("role", "text", "turn")))
    return _t(s, d, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("key"))


@query("q_label_order")
def q_label_order(s, d):
    return _t(s, d, "documents").select("doc_id", text.seeded_order(text.order_seed(text.digest(F.col("doc_id").cast("string"))).cast("string")).alias("origins"))


@query("q_length_window", f"SELECT conv_id, turn, len({WSW}) AS words, 0.85::DOUBLE * 40 <= len({WSW}) AND len({WSW}) <= 1.15::DOUBLE * 40 AS length_compliant, round(len({WSW}) / 40.0, 6)::DOUBLE AS length_ratio FROM conversations")
def q_length_window(s, d):
    n = F.size(text.ws_words(F.col("text"))).cast("long")
    return _t(s, d, "conversations").select("conv_id", "turn", n.alias("words"), n.between(F.lit(0.85 * 40), F.lit(1.15 * 40)).alias("length_compliant"), F.round(n / F.lit(40.0), 6).alias("length_ratio"))


@query("q_accepted_draft", "SELECT conv_id, max(turn) AS accepted_attempt, arg_max(sha256(text), turn) AS hash, count(*) - 1 AS earlier FROM conversations GROUP BY 1")
def q_accepted_draft(s, d):
    return _t(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("accepted_attempt"), F.max_by(F.sha2("text", 256), "turn").alias("hash"), (F.count("*") - 1).alias("earlier"))


@query("q_quote_check")
def q_quote_check(s, d):
    c = _t(s, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    quoted = F.concat(F.lit('"'), F.array_join(F.slice(text.word_tokens(F.col("before")), 1, 3), " "), F.lit(' ... "'))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.quotes_occur(quoted, text.quote_words(F.col("before"))).alias("in_source"), text.quotes_occur(quoted, text.quote_words(F.col("text"))).alias("in_text"))


def _re(p: str) -> str:
    return p.replace("'", "''")


_PARA = rf"""para AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o)) - 1 AS pos, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS o FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))),
p AS (SELECT doc_id, pos, text, len({WSW}) AS words, CASE WHEN regexp_matches(text, '{_re(books.SCENE_BREAK)}') THEN 'break' WHEN len({WSW}) <= 12 AND (regexp_matches(text, '{_re(books.HEADING)}')
 OR (text = upper(text) AND text <> lower(text) AND NOT starts_with(text, '"'))) THEN 'heading' ELSE 'prose' END AS type FROM para)"""
_PREF = f"""{_PARA}, pw AS (SELECT doc_id, pos, type, words, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
 coalesce(pos >= 3 AND min((type = 'prose')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 1, false) AS scene,
 min(CASE WHEN type <> 'prose' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM p)"""
_CUTS = f"""{_PREF}, r AS (SELECT a.doc_id, a.pos AS start, b.pos AS last, b.before + b.words - a.before AS n FROM pw a JOIN pw b ON a.doc_id = b.doc_id AND b.pos >= a.pos WHERE a.scene AND a.type = 'prose' AND a.before >= 2000
 AND b.before + b.words - a.before >= 300 AND (a.stop IS NULL OR b.pos < a.stop)), cuts AS (SELECT doc_id, start, min(last) + 1 AS "end", arg_min(n, last) AS target_words FROM r GROUP BY 1, 2 HAVING arg_min(n, last) <= 800)"""


def _paras(s, d):
    return books.paragraphs(_t(s, d, "documents"))


@query("q_paragraph_types", f"WITH {_PARA} SELECT doc_id, pos, type, words FROM p")
def q_paragraph_types(s, d):
    return _paras(s, d).drop("text")


@query("q_prefix_words", f"WITH {_PREF} SELECT * FROM pw")
def q_prefix_words(s, d):
    return books.prefix_words(_paras(s, d).drop("text"))


@query("q_cut_candidates", f"WITH {_CUTS} SELECT * FROM cuts")
def q_cut_candidates(s, d):
    return books.cut_candidates(_paras(s, d).drop("text"))


@query("q_cut_sample")
def q_cut_sample(s, d):
    return books.cut_sample(_paras(s, d).drop("text"))


_TOLD = "Preface\nTo the reader\nCHAPTER I\n"
_STORY = _PARA.replace("FROM documents", f"FROM (SELECT doc_id, '{_TOLD}' || text AS text FROM documents)")


@query("q_story_start", f"WITH {_STORY}, h AS (SELECT *, max((type = 'prose' AND words >= 40)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM p) SELECT doc_id, min(pos) AS start FROM h WHERE type = 'heading' AND regexp_matches(text, '{_re(books.STORY_HEADING)}') AND ahead = 1 GROUP BY 1")
def q_story_start(s, d):
    return books.story_start(books.paragraphs(_t(s, d, "documents").withColumn("text", F.concat(F.lit(_TOLD), "text"))))


@query("q_book_paragraphs")
def q_book_paragraphs(s, d):
    """Documents bound as books: marks around them, a blank line between paragraphs."""
    raw = F.concat(F.lit("x\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nProduced by Y\n\nCHAPTER I\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"))
    return books.book_paragraphs(_t(s, d, "documents").select("doc_id", raw.alias("raw")))


@query("q_passages", f"WITH {_CUTS}, tx AS (SELECT doc_id, list(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) ORDER BY pos) AS t FROM p GROUP BY 1) SELECT doc_id, start, sha256(array_to_string(t[1:start], chr(10) || chr(10))) AS context_hash, sha256(array_to_string(t[start+1:\"end\"], chr(10) || chr(10))) AS reference_hash FROM cuts JOIN tx USING (doc_id)")
def q_passages(s, d):
    paras = _paras(s, d)
    return books.passages(books.cut_candidates(paras.drop("text")), paras)


@query("q_lesser_read", """WITH b AS (SELECT source AS author, lang || (doc_id % 7)::VARCHAR AS stem, doc_id::VARCHAR AS book_id, n_chars AS downloads, doc_id AS pos FROM documents),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY author, stem ORDER BY downloads DESC, pos) = 1), m AS (SELECT author, list_sort(list(downloads))[len(list(downloads)) // 2 + 1] AS median FROM u GROUP BY 1)
SELECT author, book_id, downloads, median FROM u JOIN m USING (author) WHERE downloads < median""")
def q_lesser_read(s, d):
    b = _t(s, d, "documents").select(F.col("source").alias("author"), F.concat("lang", (F.col("doc_id") % 7).cast("string")).alias("stem"), F.col("doc_id").cast("string").alias("book_id"), F.col("n_chars").alias("downloads"), F.col("doc_id").alias("pos"))
    return books.lesser_read(b)


@query("q_catalog_filter", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND NOT regexp_matches(lower(p_name), 'volume|collected') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 5)")
def q_catalog_filter(s, d):
    part, excluded = _t(s, d, "part"), _t(s, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    listed = part.groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 5").select("p_brand")
    kept = part.where((F.col("p_size") > 10) & ~F.lower("p_name").rlike("volume|collected"))
    return kept.join(excluded, "p_partkey", "left_anti").join(listed, "p_brand", "left_semi").select("p_partkey", "p_name")


@query("q_round_robin_books", """WITH b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, source AS author, doc_id AS book_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split, author ORDER BY book_id) AS rank, min(book_id) OVER (PARTITION BY split, author) AS f FROM b)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY rank, f) AS turn, author, book_id FROM r QUALIFY turn <= 30""")
def q_round_robin_books(s, d):
    b = _t(s, d, "documents").select(_split().alias("split"), F.col("source").alias("author"), F.col("doc_id").alias("book_id"), F.col("doc_id").alias("pos"))
    return books.round_robin(b, 30).withColumn("turn", F.col("turn").cast("long"))


@query("q_even_deal_splits", "SELECT doc_id, (rn * 5) // n AS deal FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def q_even_deal_splits(s, d):
    w = Window.partitionBy("source")
    ranked = _t(s, d, "documents").select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("rn"), F.count("*").over(w).alias("n"))
    return ranked.select("doc_id", F.floor(F.col("rn") * 5 / F.col("n")).cast("long").alias("deal"))


@query("q_html_text")
def q_html_text(s, d):
    return _t(s, d, "pages").select("page_id", html_text.html_text("html").alias("text"))


@query("q_page_sections")
def q_page_sections(s, d):
    return _t(s, d, "pages").select("page_id", F.posexplode(html_text.page_sections("html")).alias("pos", "s")).select("page_id", "pos", "s.*")


@query("q_html_reject_reasons")
def q_html_reject_reasons(s, d):
    return q_page_sections(s, d).groupBy("reject_reason").agg(F.count("*").alias("n"))


def _split():
    return F.when(F.col("doc_id") % 3 == 0, F.lit("validation")).otherwise(F.lit("train"))


_ROWS = """sr AS (SELECT d.doc_id AS example_id, source AS source_id, lang AS kind, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, c AS checkpoint,
CASE WHEN (doc_id + c) % 17 <> 0 THEN ((n_chars + 7 * c) % 101) / 10.0::DOUBLE END AS human, CASE WHEN (doc_id + c) % 19 <> 0 THEN ((doc_id * 37 + 13 * c) % 101) / 10.0::DOUBLE END AS model, n_chars % 10 < 7 AS length_compliant
FROM documents d, (SELECT unnest(range(0, 5)) AS c)), rows_ AS (SELECT *, round(human - model, 6) AS gap FROM sr)"""
_SUMMARY = f"""{_ROWS}, sm AS (SELECT checkpoint, split, count(*) AS examples, count(gap) AS paired_coverage, count(*) = count(gap) AS complete, round(avg(CASE WHEN gap IS NOT NULL THEN human END), 6) AS human,
round(avg(CASE WHEN gap IS NOT NULL THEN model END), 6) AS model, round(avg(gap), 6) AS gap, round(count(*) FILTER (gap > 0) / nullif(count(gap), 0), 6) AS positive_gap_fraction, count(*) FILTER (gap = 0) AS ties, count(*) FILTER (length_compliant) AS length_compliant FROM rows_ GROUP BY 1, 2)"""
_SELECTED = "sel AS (SELECT checkpoint AS selected, gap FROM sm WHERE split = 'train' AND gap IS NOT NULL ORDER BY gap DESC, checkpoint LIMIT 1)"


def score_rows(s, d):
    c, i = F.col("checkpoint"), F.col("example_id")
    rows = _t(s, d, "documents").select(F.col("doc_id").alias("example_id"), F.col("source").alias("source_id"), F.col("lang").alias("kind"), _split().alias("split"), F.col("n_chars"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("checkpoint"))
    human = F.when((i + c) % 17 != 0, ((F.col("n_chars") + 7 * c) % 101) / F.lit(10.0))
    model = F.when((i + c) % 19 != 0, ((i * 37 + 13 * c) % 101) / F.lit(10.0))
    return scores.gaps(rows.select("example_id", "source_id", "kind", "split", "checkpoint", human.alias("human"), model.alias("model"), (F.col("n_chars") % 10 < 7).alias("length_compliant")))


@query("q_score_rows", f"WITH {_ROWS} SELECT * FROM rows_")
def q_score_rows(s, d):
    return score_rows(s, d)


@query("q_checkpoint_summary", f"WITH {_SUMMARY} SELECT * FROM sm")
def q_checkpoint_summary(s, d):
    return scores.checkpoint_summary(score_rows(s, d))


@query("q_kind_summary", f"WITH {_ROWS} SELECT checkpoint, split, kind, count(gap) AS coverage, round(avg(gap), 6) AS gap FROM rows_ GROUP BY 1, 2, 3")
def q_kind_summary(s, d):
    return scores.kind_summary(score_rows(s, d))


@query("q_select_checkpoint", f"WITH {_SUMMARY}, {_SELECTED} SELECT * FROM sel")
def q_select_checkpoint(s, d):
    return scores.select_checkpoint(q_checkpoint_summary(s, d))


@query("q_checkpoint_table", f"""WITH {_SUMMARY}, {_SELECTED} SELECT t.checkpoint, t.human AS train_human, t.model AS train_model, t.gap AS train_gap, v.human AS val_human, v.model AS val_model, v.gap AS val_gap, v.paired_coverage AS val_coverage,
t.checkpoint = (SELECT selected FROM sel) AS selected_by_train FROM sm t JOIN sm v ON t.checkpoint = v.checkpoint AND t.split = 'train' AND v.split = 'validation'""")
def q_checkpoint_table(s, d):
    sm = q_checkpoint_summary(s, d)
    return scores.checkpoint_table(sm, scores.select_checkpoint(sm))


@query("q_feedback_failures", f"WITH {_ROWS} SELECT example_id, kind, gap FROM rows_ WHERE split = 'train' AND checkpoint = 0 AND gap <= 0 ORDER BY gap, example_id LIMIT 24")
def q_feedback_failures(s, d):
    return scores.failures(score_rows(s, d).where("split = 'train' and checkpoint = 0"))


@query("q_gap_history", f"WITH {_ROWS} SELECT example_id, " + ", ".join(f"max(gap) FILTER (checkpoint = {c}) AS gap_{c}" for c in range(5)) + " FROM rows_ GROUP BY 1")
def q_gap_history(s, d):
    return scores.gap_history(score_rows(s, d), list(range(5)))


@query("q_source_means", f"WITH {_ROWS} SELECT source_id, count(DISTINCT kind) AS kinds, least(0, min(gap)) - 0.2::DOUBLE AS low, greatest(0, max(gap)) + 0.2::DOUBLE AS high, greatest(1, max(abs(gap))) AS bound FROM rows_ GROUP BY 1")
def q_source_means(s, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    return score_rows(s, d).groupBy("source_id").agg(F.countDistinct("kind").alias("kinds"), (F.least(zero, F.min("gap")) - F.lit(0.2)).alias("low"), (F.greatest(zero, F.max("gap")) + F.lit(0.2)).alias("high"), F.greatest(one, F.max(F.abs("gap"))).alias("bound"))


@query("q_carried_prompt", "SELECT user_id AS run, event_id AS iteration, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events")
def q_carried_prompt(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("iteration"), F.col("event_id").alias("prompt"), (F.col("event_type") == "purchase").alias("accepted"))
    return scores.carried(e).select("run", "iteration", "current")


_CRIT = f"crit AS (SELECT doc_id AS rubric, doc_id % 5 AS checkpoint, unnest(t[1:6]) AS id, unnest(range(0, len(t[1:6]))) AS pos FROM (SELECT doc_id, {WSW} AS t FROM documents))"


def _criteria(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("rubric"), (F.col("doc_id") % 5).alias("checkpoint"), F.posexplode(F.slice(text.ws_words(F.col("text")), 1, 6)).alias("pos", "id"))


@query("q_criterion_long", f"WITH {_CRIT} SELECT rubric, id, pos::BIGINT AS pos, CASE WHEN pos % 3 <> 0 THEN (rubric + pos) % 11 END AS human_score, CASE WHEN pos % 2 <> 0 THEN (rubric * 3 + pos) % 11 END AS model_score FROM crit")
def q_criterion_long(s, d):
    c = _criteria(s, d).withColumn("pos", F.col("pos").cast("long"))
    human = c.where("pos % 3 <> 0").select("rubric", "pos", ((F.col("rubric") + F.col("pos")) % 11).alias("human_score"))
    model = c.where("pos % 2 <> 0").select("rubric", "pos", ((F.col("rubric") * 3 + F.col("pos")) % 11).alias("model_score"))
    return c.join(human, ["rubric", "pos"], "left").join(model, ["rubric", "pos"], "left").select("rubric", "id", "pos", "human_score", "model_score")


@query("q_criterion_heat", f"""WITH {_CRIT}, kk AS (SELECT *, regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS key FROM crit), o AS (SELECT * FROM kk QUALIFY row_number() OVER (PARTITION BY rubric, key ORDER BY pos) = 1),
b AS (SELECT key, count(*) AS total FROM o GROUP BY 1 ORDER BY total DESC, key LIMIT 30), n AS (SELECT doc_id % 5 AS checkpoint, count(*) AS rubrics FROM documents GROUP BY 1)
SELECT key, checkpoint, count(*) AS count, any_value(total) AS total, round(count(*) / any_value(rubrics), 6) AS share FROM o JOIN b USING (key) JOIN n USING (checkpoint) GROUP BY 1, 2""")
def q_criterion_heat(s, d):
    return scores.criterion_heat(_criteria(s, d), _t(s, d, "documents").select((F.col("doc_id") % 5).alias("checkpoint")))


@query("q_split_disjoint", "SELECT source, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END) AS groups FROM documents GROUP BY 1 HAVING groups > 1")
def q_split_disjoint(s, d):
    return constraints.in_several(_t(s, d, "documents").withColumn("split", _split()), "source", "split")


@query("q_duplicate_ids", "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1")
def q_duplicate_ids(s, d):
    return constraints.duplicates(_t(s, d, "documents").select(F.sha2("text", 256).alias("hash")), "hash")


@query("q_set_equality", "(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def q_set_equality(s, d):
    return constraints.not_equal_sets(_t(s, d, "documents"), _t(s, d, "labels"), "doc_id")


@query("q_reference_hidden", "SELECT doc_id FROM documents WHERE contains(text, substr(text, 10, 50) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '§' END)")
def q_reference_hidden(s, d):
    """Examples whose context still shows the reference: every fifth document has a passage of its own as the reference."""
    mark = F.when(F.col("doc_id") % 5 == 0, "").otherwise("§")
    rows = _t(s, d, "documents").select("doc_id", F.col("text").alias("context"), F.concat(F.substring("text", 10, 50), mark).alias("reference"))
    return constraints.reference_visible(rows).select("doc_id")


@query("q_word_mismatch", f"SELECT doc_id FROM documents WHERE len({WSW}) <= 0 OR len({WSW}) <> n_chars // 6")
def q_word_mismatch(s, d):
    return constraints.word_mismatch(_t(s, d, "documents").withColumn("w", F.floor(F.col("n_chars") / 6)), "text", "w").select("doc_id")


@query("q_positional_match", "SELECT coalesce(a.pos, b.pos) AS pos, left_key, right_key FROM (SELECT doc_id AS pos, source AS left_key FROM documents) a FULL JOIN (SELECT doc_id - 1 AS pos, source AS right_key FROM documents) b ON a.pos = b.pos WHERE left_key IS DISTINCT FROM right_key")
def q_positional_match(s, d):
    docs = _t(s, d, "documents")
    return constraints.positional_mismatch(docs.select(F.col("doc_id").alias("pos"), "source"), docs.select((F.col("doc_id") - 1).alias("pos"), "source"), "source")


_ATT = "att AS (SELECT CASE event_type WHEN 'error' THEN 'http_error' WHEN 'click' THEN 'connect_error' WHEN 'view' THEN 'uncertain' ELSE 'success' END AS status, CASE WHEN event_type IN ('purchase', 'signup') THEN user_id END AS generation_id, CASE WHEN event_type = 'error' THEN 500 + (event_id % 5)::INT ELSE 200 END AS http_status, round(value, 6) AS cost FROM events)"


def _attempts(s, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "http_error").when(kind == "click", "connect_error").when(kind == "view", "uncertain").otherwise("success")
    return _t(s, d, "events").select(status.alias("status"), F.when(kind.isin("purchase", "signup"), F.col("user_id")).alias("generation_id"), F.when(kind == "error", 500 + F.col("event_id") % 5).otherwise(200).alias("http_status"), F.round("value", 6).alias("cost"))


@query("q_attempt_ledger", f"WITH {_ATT} SELECT status, count(*) AS attempts, count(generation_id) AS with_id, count(*) FILTER (generation_id IS NULL AND status <> 'connect_error') AS missing_id, count(*) FILTER (http_status IN (408, 409, 425, 429, 500, 502, 503, 504)) AS retryable FROM att GROUP BY 1")
def q_attempt_ledger(s, d):
    return scores.attempt_ledger(_attempts(s, d))


@query("q_cost_totals", f"WITH {_ATT}, g AS (SELECT generation_id, max(cost::DECIMAL(18,6)) AS cost FROM att WHERE generation_id IS NOT NULL GROUP BY 1) SELECT count(*) AS requests, sum(cost)::DOUBLE AS total_cost, (SELECT count(*) FILTER (generation_id IS NULL AND status <> 'connect_error') FROM att) AS unresolved FROM g")
def q_cost_totals(s, d):
    return scores.cost_totals(_attempts(s, d))


@query("q_pilot_relabel", "WITH f AS (SELECT source, min(doc_id) AS p FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1 ORDER BY p LIMIT 2), r AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM f) SELECT doc_id, CASE WHEN k = 1 THEN 'train' ELSE 'validation' END AS split FROM documents JOIN r USING (source) WHERE doc_id % 3 <> 0")
def q_pilot_relabel(s, d):
    train = _t(s, d, "documents").where(_split() == "train").select("doc_id", "source")
    few = train.groupBy("source").agg(F.min("doc_id").alias("p")).orderBy("p").limit(2)  # two rows
    ranked = few.withColumn("k", F.row_number().over(Window.orderBy("source")))
    return train.join(F.broadcast(ranked), "source").select("doc_id", F.when(F.col("k") == 1, F.lit("train")).otherwise(F.lit("validation")).alias("split"))


@query("q_run_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def q_run_listing(s, d):
    scored = _t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return _t(s, d, "orders").join(scored, "o_orderkey", "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("q_preferred_run", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 1")
def q_preferred_run(s, d):
    done = F.col("o_orderstatus") == "F"
    rank = F.when(done & F.col("o_orderpriority").startswith("1"), 0).when(done, 1).otherwise(2)
    return _t(s, d, "orders").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query("q_word_diff")
def q_word_diff(s, d):
    c = _t(s, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.word_diff("before", "text").alias("diff"))


@query("q_stub_writer")
def q_stub_writer(s, d):
    return calls.drafts(_t(s, d, "documents"))


@query("q_stub_judge")
def q_stub_judge(s, d):
    return calls.grades(_t(s, d, "documents"), ["clarity", "accuracy", "style"])


def _exam(s, d):
    """Documents as examples, of which some differ from what is expected of them."""
    docs = _t(s, d, "documents")
    return docs.select("doc_id", "source", "lang", "n_chars"), docs.where("doc_id % 97 <> 0").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit("other")).otherwise(F.col("source")).alias("source"), "lang", F.when(F.col("doc_id") % 70 == 0, F.lit(0)).otherwise(F.col("n_chars")).alias("n_chars"))


_EXPECTED = "b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE source END AS source, lang, CASE WHEN doc_id % 70 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 97 <> 0)"


@query("q_fields_differ", f"WITH {_EXPECTED} SELECT doc_id, 'source' AS field FROM documents a JOIN b USING (doc_id) WHERE a.source IS DISTINCT FROM b.source UNION ALL SELECT doc_id, 'n_chars' FROM documents a JOIN b USING (doc_id) WHERE a.n_chars IS DISTINCT FROM b.n_chars UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 97 = 0")
def q_fields_differ(s, d):
    a, b = _exam(s, d)
    return constraints.fields_differ(a, b, "doc_id", ["source", "lang", "n_chars"])


@query("q_counts_differ", 'SELECT (SELECT count(*) FROM documents) AS "left", (SELECT count(*) FROM labels) AS "right" WHERE (SELECT count(*) FROM documents) <> (SELECT count(*) FROM labels)')
def q_counts_differ(s, d):
    return constraints.counts_differ(_t(s, d, "documents"), _t(s, d, "labels"))


@query("q_kinds_incomplete", "SELECT source, count(*) > count(DISTINCT lang) AS repeated, list_sort(list_filter(['de', 'en', 'la'], lambda x: NOT list_contains(list(DISTINCT lang), x))) AS missing FROM documents WHERE doc_id % 5 = 0 GROUP BY 1")
def q_kinds_incomplete(s, d):
    return constraints.kinds_incomplete(_t(s, d, "documents").where("doc_id % 5 = 0"), "source", "lang", ["de", "en", "la"])


@query("q_grade_ids", """WITH a AS (SELECT source, doc_id % 12 AS k FROM documents), b AS (SELECT source, doc_id % 11 AS k FROM documents WHERE doc_id % 3 = 0)
SELECT source, list_sort(list_filter(l, lambda x: NOT list_contains(coalesce(r, []), x))) AS only_left, list_sort(list_filter(coalesce(r, []), lambda x: NOT list_contains(l, x))) AS only_right FROM (SELECT source, list(DISTINCT k::VARCHAR) AS l FROM a GROUP BY 1) LEFT JOIN (SELECT source, list(DISTINCT k::VARCHAR) AS r FROM b GROUP BY 1) USING (source)
WHERE len(only_left) + len(only_right) > 0""")
def q_grade_ids(s, d):
    docs = _t(s, d, "documents")
    return constraints.keys_differ(docs.select("source", (F.col("doc_id") % 12).alias("k")), docs.where("doc_id % 3 = 0").select("source", (F.col("doc_id") % 11).alias("k")), "source", "k")


@query("q_bad_scores", f"WITH {_ROWS} SELECT example_id, checkpoint FROM rows_ WHERE human * 1.2::DOUBLE - 1 IS NULL OR human * 1.2::DOUBLE - 1 NOT BETWEEN 0 AND 10")
def q_bad_scores(s, d):
    return constraints.bad_scores(score_rows(s, d).withColumn("score", F.col("human") * F.lit(1.2) - 1)).select("example_id", "checkpoint")


@query("q_hash_mismatch", "SELECT doc_id FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END)")
def q_hash_mismatch(s, d):
    docs = _t(s, d, "documents").withColumn("h", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256))
    return constraints.hash_mismatch(docs, "text", "h").select("doc_id")


@query("q_table_digest")
def q_table_digest(s, d):
    return constraints.table_digest(_t(s, d, "documents"), "doc_id", "text", "source")


@query("q_criterion_statistics", f"""WITH {_CRIT}, cl AS (SELECT rubric, id, pos, CASE WHEN pos % 3 <> 0 THEN (rubric + pos) % 11 END AS hs, CASE WHEN pos % 2 <> 0 THEN (rubric * 3 + pos) % 11 END AS ms, regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS key FROM crit),
o AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY rubric, key ORDER BY pos) = 1), v AS (SELECT key, list(id ORDER BY n DESC, id) AS variants FROM (SELECT key, id, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT key, count(*) AS count, count(hs) AS human_scores, count(ms) AS model_scores, round(avg(hs), 6) AS human, round(avg(ms), 6) AS model, arg_min(id, (rubric, pos)) AS first_id, any_value(variants) AS variants FROM o JOIN v USING (key) GROUP BY 1""")
def q_criterion_statistics(s, d):
    return scores.criterion_statistics(q_criterion_long(s, d))


@query("q_section_counts", "SELECT source, lang, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1, 2")
def q_section_counts(s, d):
    return _t(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("q_missing_generations", f"WITH {_ATT.replace('round(value, 6) AS cost', 'round(value, 6) AS cost, event_id AS path')} SELECT path FROM att WHERE generation_id IS NULL AND status <> 'connect_error'")
def q_missing_generations(s, d):
    kind = F.col("event_type")
    status = F.when(kind == "error", "http_error").when(kind == "click", "connect_error").when(kind == "view", "uncertain").otherwise("success")
    return scores.missing_generations(_t(s, d, "events").select(F.col("event_id").alias("path"), status.alias("status"), F.when(kind.isin("purchase", "signup"), F.col("user_id")).alias("generation_id")))


@query("q_feedback", f"WITH {_ROWS} SELECT r.example_id, r.kind, r.gap, sha256(d.text) AS reference_hash FROM rows_ r JOIN documents d ON d.doc_id = r.example_id WHERE r.split = 'train' AND r.checkpoint = 0 AND r.gap <= 0 ORDER BY r.gap, r.example_id LIMIT 24")
def q_feedback(s, d):
    """The failures of a checkpoint with their examples' references."""
    rows = scores.guarded(score_rows(s, d).where("split = 'train' and checkpoint = 0 and gap is not null"))
    few = scores.failures(rows)  # FAILURES rows
    texts = _t(s, d, "documents").select(F.col("doc_id").alias("example_id"), F.sha2("text", 256).alias("reference_hash"))
    return texts.join(F.broadcast(few), "example_id").select("example_id", "kind", "gap", "reference_hash")


def _articles(s, d):
    """Documents set as LaTeXML pages, of which some break a rule: half the words are the abstract, half the introduction."""
    docs = _t(s, d, "documents").select("doc_id", text.ws_words(F.col("text")).alias("w"))  # a column of its own, as all the parts of a page ask for it
    w = F.col("w")
    half = F.floor(F.size(w) / 2).cast("int")
    safe = lambda x: F.replace(F.replace(F.array_join(x, " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = lambda k: f'<li class="ltx_bibitem" id="b{k}"><span class="ltx_tag ltx_tag_bibitem">A</span> Title</li>'
    html = F.concat(
        F.lit('<html><nav>menu</nav><article class="ltx_document"><div class="ltx_abstract" id="abs"><h6>Abstract</h6><p>'), safe(F.slice(w, F.lit(1), half)),
        F.lit('</p></div><section class="ltx_section" id="S1"><h2>1 Introduction</h2><p>'), safe(F.slice(w, half + 1, F.size(w))),
        F.lit(' <cite class="ltx_cite">(<a href="#b2">x</a>; <a href="#b1">y</a>)</cite></p><figure class="ltx_figure">drawn</figure></section>'),
        F.when(F.col("doc_id") % 13 == 0, '<section class="ltx_section"><h2>2. INTRODUCTION</h2></section>').otherwise(""),
        F.lit("<ul>" + "".join(map(item, range(1, 10)))), F.when(F.col("doc_id") % 7 == 0, "").otherwise(item(10)), F.lit("</ul>"),
        F.when(F.col("doc_id") % 11 == 0, '<span class="ltx_ERROR">lost</span>').otherwise(""), F.lit("</article></html>"),
    )
    return papers.read_papers(docs.withColumn("html", html), "doc_id", "html")


_CLEAN = r"trim(regexp_replace(nfc_normalize({}), '\s+', ' ', 'g'))"
_BIB = "'[1] Title [2] Title [3] Title [4] Title [5] Title [6] Title [7] Title [8] Title [9] Title [10] Title'"
_ARTICLES = f"""w AS (SELECT doc_id, coalesce(text, '') AS text, array_to_string(t[1:len(t) // 2], ' ') AS a, array_to_string(t[len(t) // 2 + 1:], ' ') AS b FROM (SELECT doc_id, text, {WSW} AS t FROM documents)),
sec AS (SELECT doc_id, 1 AS pos, 'abstract' AS kind, {_CLEAN.format('a')} AS reference, {_CLEAN.format(f"'[Missing abstract section] 1 Introduction ' || b || ' [1, 2] drawn ' || {_BIB}")} AS context FROM w
UNION ALL SELECT doc_id, 2, 'introduction', {_CLEAN.format("b || ' [1, 2]'")}, {_CLEAN.format(f"'Abstract ' || a || ' [Missing introduction section] ' || {_BIB}")} FROM w),
ruled AS (SELECT *, CASE WHEN reference = '' THEN 0 ELSE len(string_split(reference, ' ')) END AS words FROM sec),
why AS (SELECT *, CASE WHEN regexp_matches(reference, '(?i)\\backnowledg(?:e)?ments?\\b') THEN kind || ' contains acknowledgements the markup does not set apart' WHEN words < 60 THEN kind || ' has ' || words || ' words; at least 60 required' WHEN contains(context, reference) THEN kind || ' text also appears elsewhere in the paper, so removing it does not hide it' END AS reason FROM ruled),
paper AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Found a second top-level introduction section, headed ''introduction''' WHEN doc_id % 7 = 0 THEN 'Bibliography has 9 entries; at least 10 required'
WHEN doc_id % 11 = 0 OR contains(text, chr(65533)) THEN 'Page has ' || (doc_id % 11 = 0)::INT || ' LaTeXML error node(s) and ' || (len(text) - len(replace(text, chr(65533), ''))) || ' U+FFFD character(s)' ELSE r END AS reason FROM w LEFT JOIN (SELECT doc_id, arg_min(reason, pos) AS r FROM why WHERE reason IS NOT NULL GROUP BY 1) USING (doc_id))"""


@query("q_paper_rejects", f"WITH {_ARTICLES} SELECT doc_id::VARCHAR AS paper_id, reason FROM paper WHERE reason IS NOT NULL")
def q_paper_rejects(s, d):
    return papers.rejected(_articles(s, d))


@query("q_paper_examples", f"WITH {_ARTICLES} SELECT doc_id || '_' || kind AS example_id, doc_id::VARCHAR AS source_id, kind, sha256(context) AS context_hash, sha256(reference) AS reference_hash, words AS target_words, 10 AS bibliography_items FROM ruled JOIN paper USING (doc_id) WHERE reason IS NULL")
def q_paper_examples(s, d):
    return papers.examples(_articles(s, d)).drop("context", "reference")


_REPLIES = """rp AS (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'r' || user_id END AS response_id, CASE event_type WHEN 'purchase' THEN '{"id":"g' || user_id || '","choices":[{"message":{"content":"x"},"finish_reason":"stop"}]}'
WHEN 'signup' THEN '{"id":"","choices":[{"message":{"content":null},"finish_reason":"length"}]}' WHEN 'view' THEN '{"choices":[]}' WHEN 'click' THEN '{"choices":[{"message":"x"}],"id":"c"}' ELSE '{"error":{"code":500},"choices":[{"message":{"content":"x"}}]}' END AS reply FROM events)"""


def _replies(s, d):
    """Events as sends with replies of five shapes."""
    e, user = F.col("event_type"), F.col("user_id").cast("string")
    reply = (
        F.when(e == "purchase", F.concat(F.lit('{"id":"g'), user, F.lit('","choices":[{"message":{"content":"x"},"finish_reason":"stop"}]}')))
        .when(e == "signup", '{"id":"","choices":[{"message":{"content":null},"finish_reason":"length"}]}')
        .when(e == "view", '{"choices":[]}')
        .when(e == "click", '{"choices":[{"message":"x"}],"id":"c"}')
        .otherwise('{"error":{"code":500},"choices":[{"message":{"content":"x"}}]}')
    )
    sent = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit("r"), user))
    return _t(s, d, "events").select("event_id", F.when(e == "error", 500).otherwise(200).alias("status"), sent.alias("response_id"), reply.alias("reply"))


@query("q_reply_checks", f"""WITH {_REPLIES} SELECT event_id, json_type(reply, '$.choices[0].message') IS NOT DISTINCT FROM 'OBJECT' AND coalesce(json_type(reply, '$.choices[0].message.content'), 'NULL') IN ('VARCHAR', 'NULL') AS valid,
status = 200 AND valid AND json_extract(reply, '$.error') IS NULL AS ok, coalesce(nullif(response_id, ''), nullif(json_extract_string(reply, '$.id'), '')) AS generation_id, list_sort(json_keys(reply)) = ['choices', 'id'] AS closed, coalesce(json_extract_string(reply, '$.choices[0].finish_reason') = 'stop', false) AS complete FROM rp""")
def q_reply_checks(s, d):
    r = F.col("reply")
    return _replies(s, d).select("event_id", lifecycle.valid_choice(r).alias("valid"), lifecycle.succeeded(F.col("status"), r).alias("ok"), lifecycle.generation_id(F.col("response_id"), r).alias("generation_id"), lifecycle.closed(r, "id", "choices").alias("closed"), lifecycle.complete(r).alias("complete"))


def _price(i: str) -> dict:
    """A stub's answer: no cost for some ids."""
    n = int(i[1:])
    return {"id": i, "total_cost": n / 8 if n % 10 else None}


@query("q_cost_lookup", "SELECT DISTINCT 'r' || user_id AS generation_id, CASE WHEN user_id % 10 <> 0 THEN user_id / 8.0::DOUBLE END AS cost, CASE WHEN user_id % 10 = 0 THEN 'ValueError: invalid id or cost' END AS error FROM events WHERE event_id % 3 = 1")
def q_cost_lookup(s, d):
    return lifecycle.costs(_replies(s, d).select(F.nullif("response_id", F.lit("")).alias("generation_id")), _price)


@query("q_request_payload", """SELECT doc_id, sha256('{"max_tokens":64,"messages":[{"content":"Write.","role":"system"},{"content":"{\\"kind\\":\\"' || lang || '\\",\\"target_words\\":' || n_chars || '}","role":"user"}],"model":"m","plugins":[],"provider":{"allow_fallbacks":false,"only":["p"],"order":["p"],"require_parameters":true},"stream":false,"temperature":0.5,"transforms":[]}') AS request_key FROM documents""")
def q_request_payload(s, d):
    data = F.to_json(F.struct(F.col("lang").alias("kind"), F.col("n_chars").alias("target_words")))
    cfg = {"model": "m", "provider": "p", "temperature": 0.5, "max_tokens": 64}
    return _t(s, d, "documents").select("doc_id", F.sha2(lifecycle.payload(cfg, F.lit("Write."), data), 256).alias("request_key"))


@query("q_blinded", "SELECT sha256(text) AS context, lang AS kind, n_chars AS target_words FROM documents")
def q_blinded(s, d):
    return lifecycle.blinded(_t(s, d, "documents").select(F.sha2("text", 256).alias("context"), F.col("lang").alias("kind"), F.col("n_chars").alias("target_words"), "source", "doc_id"))


@query("q_graded", "SELECT doc_id AS example_id, source AS rubric, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 11 END AS human, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 7 END AS model FROM documents")
def q_graded(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("example_id"), F.col("source").alias("rubric"))
    human = docs.where("example_id % 3 <> 0").select("example_id", F.lit("human").alias("origin"), (F.col("example_id") % 11).alias("total"))
    model = docs.where("example_id % 4 <> 0").select("example_id", F.lit("model").alias("origin"), (F.col("example_id") % 7).alias("total"))
    return lifecycle.graded(docs, human.unionByName(model), ["example_id"])


def _sections(s, d):
    kind = F.element_at(F.array(*map(F.lit, reports.KIND_ORDER)), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("source").alias("paper_id"), kind.alias("kind"), _split().alias("split"), "doc_id")


_SECTIONS = "sec AS (SELECT doc_id::VARCHAR AS example_id, source AS paper_id, ['abstract', 'introduction', 'related_work', 'conclusion'][doc_id % 4 + 1] AS kind, doc_id % 4 AS place, CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id FROM documents)"


@query("q_section_list", f"WITH {_SECTIONS} SELECT split, paper_id, list(kind ORDER BY place) AS kinds FROM sec GROUP BY 1, 2")
def q_section_list(s, d):
    return reports.section_list(_sections(s, d))


@query("q_matching_sections", f"WITH {_SECTIONS}, ti AS (SELECT source AS paper_id, arg_min(lang, doc_id) AS title FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1) SELECT example_id, coalesce(title, paper_id) AS title FROM sec LEFT JOIN ti USING (paper_id) WHERE split = 'train' AND kind = 'abstract' AND contains(lower(example_id || ' ' || coalesce(title, paper_id)), '2')")
def q_matching_sections(s, d):
    known = _t(s, d, "documents").where("doc_id % 5 <> 0").select(F.col("source").alias("paper_id"), F.col("lang").alias("title"), F.col("doc_id").alias("pos"))
    return reports.matching(reports.titled(_sections(s, d), known), "train", "abstract", "2").select("example_id", "title")


@query("q_split_rows", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def q_split_rows(s, d):
    return reports.of_splits(_sections(s, d), "train").select("doc_id")


@query("q_split_counts", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, source, count(*) AS n FROM documents GROUP BY 1, 2")
def q_split_counts(s, d):
    return _sections(s, d).groupBy("split", F.col("paper_id").alias("source")).agg(F.count("*").alias("n"))


@query("q_earlier_drafts", "SELECT conv_id, list(turn ORDER BY turn)[1:count(*) - 1] AS earlier, list(role ORDER BY turn) AS reasons FROM conversations GROUP BY 1")
def q_earlier_drafts(s, d):
    per = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return per.select("conv_id", reports.earlier(F.transform("a", lambda x: x["turn"])).alias("earlier"), reports.reasons(F.transform("a", lambda x: F.array(x["role"]))).alias("reasons"))


@query("q_display", "SELECT doc_id, 'main/' || (doc_id % 5) || '/' || lang || '/' || doc_id AS label, CASE WHEN doc_id % 10 = 0 THEN '–' WHEN doc_id % 7 > 3 THEN '+' || printf('%.2f', (doc_id % 7 - 3) / 4.0) ELSE printf('%.2f', (doc_id % 7 - 3) / 4.0) END AS gap, CASE WHEN doc_id < 10 THEN '0' ELSE array_to_string(string_split(doc_id::VARCHAR[1:-2], ''), '/') END AS path FROM documents".replace("doc_id::VARCHAR[1:-2]", "left(doc_id::VARCHAR, -1)"))
def q_display(s, d):
    i = F.col("doc_id")
    gap = F.when(i % 10 != 0, (i % 7 - 3) / F.lit(4.0))
    return _t(s, d, "documents").select("doc_id", reports.label(i % 5, F.col("lang"), i).alias("label"), reports.signed(gap).alias("gap"), reports.digits_path(i.cast("string")).alias("path"))


@query("q_rubric_sizes", f"WITH {_CRIT}, p AS (SELECT checkpoint, rubric, count(*) AS n FROM crit GROUP BY 1, 2) SELECT checkpoint, count(*) AS rubrics, round(avg(n), 6) AS criteria FROM p GROUP BY 1")
def q_rubric_sizes(s, d):
    return reports.rubric_sizes(_criteria(s, d))


@query("q_catalog_records", "SELECT doc_id AS book_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END AS downloads, CASE WHEN doc_id % 4 <> 0 THEN 'Public domain in the USA.' ELSE '' END AS rights FROM documents")
def q_catalog_records(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("book_id"), "n_chars")
    records = docs.where("book_id % 4 <> 0").select("book_id", F.col("n_chars").alias("downloads"), F.lit("Public domain in the USA.").alias("rights"))
    return books.with_records(docs.select("book_id"), records)


@query("q_first_cuts", f"WITH {_CUTS} SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS index FROM cuts QUALIFY index < 4")
def q_first_cuts(s, d):
    return books.first_cuts(books.cut_candidates(_paras(s, d).drop("text"))).select("doc_id", "start", F.col("index").cast("long").alias("index"))


@query("q_quota_books")
def q_quota_books(s, d):
    """Sources as authors, long documents as the books that fit."""
    w = F.min("doc_id").over(Window.partitionBy("source"))
    b = _t(s, d, "documents").select(F.col("source").alias("author"), w.alias("author_pos"), F.col("doc_id").cast("string").alias("book_id"), F.col("doc_id").alias("pos"), (F.col("n_chars") > 300).alias("fit"))
    return books.quota_walk(b, {"train": 12, "validation": 6, "confirmation": 4}, most=1_000_000)


@query("q_split_mismatch", "SELECT doc_id, doc_id % 6 = 0 AS split_differs, doc_id % 10 = 0 AS provenance_differs FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 0")
def q_split_mismatch(s, d):
    """Examples whose split or provenance is not what the list of sources says."""
    docs = _t(s, d, "documents")
    rows = docs.select("doc_id", _split().alias("split"), F.struct("source", "lang").alias("provenance"))
    listed = docs.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "train").otherwise(_split()).alias("split"), F.struct("source", F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")).alias("lang")).alias("provenance"))
    return constraints.listed_otherwise(rows, listed, "doc_id")
