"""Queries of the retrieve plan, evaluation, the store's plans and text functions, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import report
from ..functions import prompts
from ..functions import text as T
from ..operators import evaluation, indexing, retrieval
from ..operators.retrieve import Options, diagnostic_pool, retrieve
from ..sources import files, questions
from ..store import reason_counts
from . import catalogue

OPTIONS = Options(threshold=0.2)


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _store(s, d):
    """chunks, questions, ranges, catalog."""
    e = _t(s, d, "embeddings")
    chunks = e.join(_t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    chunks = chunks.select(F.col("vec_id").alias("key"), F.concat(F.lit("f"), F.floor(F.col("vec_id") / 8).cast("string")).alias("file_path"), (F.col("vec_id") % 8).cast("int").alias("chunk_index"), "text", F.col("embedding").alias("vector"))
    drafts = e.where("vec_id % 100 = 1").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("hyde"))
    items = _t(s, d, "benchmark").select((F.col("item_id") * 50).alias("query_id"), F.col("text").alias("question"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(drafts, "query_id", "left").join(items, "query_id", "left")
    start = (F.lit(20240105) + F.floor(F.col("query_id") / 50) % 10).cast("int")
    return chunks, q, q.select("query_id", start.alias("start_day"), (start + 3).alias("end_day")), chunks.select("key", (F.lit(20240101) + F.col("key") % 28).cast("int").alias("day"))


def _passages(s, d, depth):
    chunks, q, ranges, days = _store(s, d)
    return retrieve(chunks, q, replace(OPTIONS, depth=depth), ranges, days)


def _shown(df):
    return df.select("query_id", "position", "key", F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"), F.array_join("lanes", ",").alias("lanes"))


def retrieve_low(s, d):
    return _shown(_passages(s, d, "low"))


def retrieve_medium(s, d):
    return _shown(_passages(s, d, "medium"))


def retrieve_high(s, d):
    return _shown(_passages(s, d, "high"))


def diagnostic_pool_high(s, d):
    chunks, q, ranges, days = _store(s, d)
    return diagnostic_pool(chunks, q, 50, replace(OPTIONS, depth="high"), ranges, days)


def diagnostic_pool_low(s, d):
    chunks, q, _, _ = _store(s, d)
    return diagnostic_pool(chunks, q, 20, replace(OPTIONS, depth="low"))


def signal_counts(s, d):
    return retrieval.lane_counts(_passages(s, d, "high"))


def answer_prompt(s, d):
    chunks, q, _, _ = _store(s, d)
    rows = _passages(s, d, "medium").withColumn("context_header", F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("[File: "), "file_path", F.lit("]"))).otherwise(""))
    out = prompts.answer_context(rows, q.select("query_id", F.coalesce("question", F.lit("")).alias("question")), "{{rag_context}}\n--\n{{user_query}}", 300, 0.5)
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"), "used")


def citations(s, d):
    c = prompts.cited(_passages(s, d, "medium"))
    return c.select("query_id", "position", F.md5("citation").alias("citation_md5"), F.round("score", 9).alias("score"), "source")


def date_catalog(s, d):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    day = F.col("o_orderdate")
    posted = F.to_json(F.struct(iso(day).alias("start"), iso(day).alias("end")))
    dates = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.array(F.struct(iso(day).alias("start"), iso(F.date_add(day, 40)).alias("end"))))).when(F.col("o_orderkey") % 3 == 1, "{not json")
    rows = _t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), posted.alias("posted_date"), dates.alias("dates"))
    return indexing.catalog(rows)


def catalog_years(s, d):
    return indexing.years_present(date_catalog(s, d))


def dated_chunks(s, d):
    n = _t(s, d, "nation").select(F.col("n_nationkey").alias("query_id"))
    year = F.lit(1992) + F.col("query_id") % 8
    return retrieval.dated_chunks(date_catalog(s, d), n.select("query_id", (year * 10000 + 301).cast("int").alias("start_day"), (year * 10000 + 10315 - 10000 * (F.col("query_id") % 2)).cast("int").alias("end_day")))


def rebuilt_files(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 64, 8).withColumnRenamed("doc_id", "file_path")
    return evaluation.file_words(c).select(F.col("file_path").alias("doc_id"), F.md5("text").alias("text_md5"))


def _kept(df):
    """Written once into the folder of spark.checkpoint.dir (on a local master without one, of this machine), so that a plan which reads it often makes it once and knows its size; else as it is."""
    s = df.sparkSession
    folder = s.conf.get("spark.checkpoint.dir", None) or ("file:///tmp/quarry-shared" if s.sparkContext.master.startswith("local") and "cluster" not in s.sparkContext.master else None)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/questions-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


def _question_set(s, d):
    """Every snippet with the documents that hold it and with the ones after those, which may not."""
    hits = evaluation.locate(_t(s, d, "documents"), _t(s, d, "benchmark")).select("item_id", "doc_id")
    both = hits.union(hits.select("item_id", F.col("doc_id") + 1)).distinct()
    rows = both.join(_t(s, d, "benchmark").select("item_id", "text"), "item_id")
    return _kept(rows.select(F.concat_ws(":", "item_id", "doc_id").alias("id"), F.col("text").alias("question"), F.col("doc_id").alias("sourceFile"), F.col("text").alias("answerSnippet")))


def _named(docs, q):
    """The documents that a question names, before they are cut into words."""
    return docs.join(q.select(F.col("sourceFile").alias("doc_id")).distinct(), "doc_id", "left_semi")


def evidence_location(s, d):
    q = _question_set(s, d)
    c = indexing.window_chunks(_named(_t(s, d, "documents"), q), 64, 8).withColumnRenamed("doc_id", "file_path")
    return evaluation.evidence_location(c, q)


def _ranked_chunks(s, d):
    """Each question's own file, its chunks in an order by hash."""
    q = _question_set(s, d)
    c = indexing.window_chunks(_named(_t(s, d, "documents"), q), 64, 0).withColumnRenamed("doc_id", "file_path")
    rows = q.select(F.col("id").alias("query_id"), "sourceFile").join(c, F.col("sourceFile") == F.col("file_path"))
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", "query_id", "chunk_index")))
    return q, rows.select("query_id", F.row_number().over(order).alias("rank"), "file_path", "chunk_index", "text", "start_index", "end_index")


def evidence_depth(s, d):
    q, rows = _ranked_chunks(s, d)
    return evaluation.evidence_depth(rows, q)


def scored_questions(s, d):
    q, rows = _ranked_chunks(s, d)
    chunks = indexing.window_chunks(_named(_t(s, d, "documents").where("doc_id % 10 <> 3"), q), 64, 0).withColumnRenamed("doc_id", "file_path")
    return evaluation.score_questions(q, rows.where("rank <= 6"), rows, chunks.select("file_path").distinct(), evaluation.evidence_location(chunks, q))


def question_problems(s, d):
    c = _t(s, d, "conversations")
    fields = [F.when(F.col("conv_id") % 4 == 0, F.col("role")).otherwise(F.concat_ws("-", "conv_id", "turn")).alias("id"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("question"), F.col("role").alias("sourceFile"), F.when(F.col("conv_id") % 5 != 0, F.col("text")).alias("answerSnippet")]
    return evaluation.question_problems(c.select(*fields))


def candidate_checks(s, d):
    x = _t(s, d, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(40)).alias("item_id")).join(_t(s, d, "benchmark").select("item_id", F.col("text").alias("item")), "item_id")
    snippet = F.when(F.col("doc_id") % 4 == 0, F.col("item")).otherwise(F.col("text"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit('{"question": 3, "answerSnippet": "x"}')).when(F.col("doc_id") % 11 == 0, F.lit("no json")).otherwise(F.to_json(F.struct(F.concat(F.lit(" "), "item").alias("question"), snippet.alias("answerSnippet"))))
    rows = x.select("doc_id", "text", evaluation.parsed_answer(raw).alias("qa"))
    return rows.select("doc_id", F.when(F.col("qa").isNull(), "generation-failed").otherwise(evaluation.drop_reason(F.col("qa.question"), F.col("qa.answerSnippet"), F.col("text"), 0.3)).alias("reason"))


def known_failures(s, d):
    e = _t(s, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("file_path"), (F.col("event_id") % 3).cast("string").alias("file_hash"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason"), F.col("event_id").alias("at"))
    scanned = e.select("file_path", F.lit("1").alias("file_hash")).distinct()
    last = indexing.last_failures(e)
    kept = indexing.skip_failures(scanned, last)
    return last.select("file_path", "file_hash", "reason", F.lit("known").alias("kind")).union(kept.select("file_path", "file_hash", F.lit(None), F.lit("try")))


def run_summary(s, d):
    plan = catalogue.incremental_plan(s, d)
    reason = F.when((F.col("action") == "new") & F.col("file_path").endswith("3"), "text.empty").when((F.col("action") == "updated") & F.col("file_path").endswith("6"), "html.error")
    rows = plan.withColumn("reason", reason)
    t = indexing.run_tallies(rows)
    return t.crossJoin(indexing.changed(t))


def failure_reasons(s, d):
    return reason_counts(_t(s, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason")))


def keyword_terms(s, d):
    terms = F.array_join(T.keyword_terms(F.col("text")), " ")
    return _t(s, d, "documents").select("doc_id", F.md5(terms).alias("terms_md5"))


def error_lines(s, d):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "  Error ").otherwise("┌──┐ "), "text", F.when(F.col("doc_id") % 3 == 0, "\n   at f (x.js:1)\n more").otherwise(""))
    return _t(s, d, "documents").select("doc_id", T.summarise_error(F.when(F.col("doc_id") % 50 == 0, "  ").otherwise(raw)).alias("line"))


def short_texts(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(T.shortened(F.col("text"))).alias("short_md5"))


def match_labels(s, d):
    lanes = F.array_compact(F.array(*[F.when(F.col("o_orderkey").bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(("vector", "hyde", "keyword", "date", "other"))]))
    return _t(s, d, "orders").select("o_orderkey", T.match_label((F.col("o_orderkey") % 9).cast("int"), lanes, F.col("o_totalprice") / 1e6).alias("label"))


def relative_paths(s, d):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/docs/").when(F.col("page_id") % 3 == 1, "/docs/../").otherwise("/other/"), F.replace("url", F.lit("/"), F.lit("\\")))
    return _t(s, d, "pages").select("page_id", T.relative_path("/docs/", path).alias("path"))


PATTERNS = ["*.html", "en/**", "**/fr/*", "[0-9]*?page=2*", "page.{php,asp}"]


def excluded_files(s, d):
    relative = F.regexp_replace("url", r"^https?://[^/]+/", "")
    return _t(s, d, "pages").select("page_id", files.excluded_by(relative, PATTERNS).alias("pattern"))


def embedding_texts(s, d):
    x = _t(s, d, "documents")
    return x.select("doc_id", F.md5(T.prefixed("text-embedding-Nomic-Embed-v1", F.col("text"), "document")).alias("document_md5"), F.md5(T.prefixed("nomic-embed", F.col("text"), "query")).alias("query_md5"), F.md5(T.prefixed("other", F.col("text"), "query")).alias("plain_md5"))


def vectors(s, d):
    v = T.finite_vector(F.col("embedding"))
    return _t(s, d, "embeddings").select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def chunk_keys(s, d):
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.chunk_key(F.concat(F.lit("shard_"), (F.col("l_orderkey") % 7).cast("string")), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("chunk_key"))


def calibrated_chunks(s, d):
    """Windows of tokens: one for every four characters here."""
    c = indexing.window_chunks(_t(s, d, "documents"), 200, 40, F.ceil(F.length("text") / 4))
    return c.select("doc_id", "chunk_index", "start_index", "end_index", F.md5("text").alias("text_md5"))


def converted_papers(s, d):
    """Conversations as papers: turns are sections, and every text is asked for."""
    c = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    evidence = lambda x: F.array(F.lit("FLOAT SELECTED: a"), F.substring(x["text"], F.lit(3), F.length(x["text"])), x["text"], F.concat(x["text"], F.lit("!!")))
    answers = lambda x: F.array(F.struct((x["turn"] % 2 == 0).alias("unanswerable"), F.slice(evidence(x), 1, F.when(x["turn"] % 3 == 0, 4).otherwise(3)).alias("evidence")))
    papers = c.select(
        F.lpad(F.col("conv_id").cast("string"), 6, "0").alias("id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, " about ").alias("abstract"),
        F.transform("t", lambda x: F.struct(x["role"].alias("section_name"), F.array(x["text"]).alias("paragraphs"))).alias("full_text"),
        F.transform("t", lambda x: F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), x["turn"].cast("string")).alias("question_id"), x["role"].alias("question"), answers(x).alias("answers"))).alias("qas"),
    )
    asked = questions.paper_questions(papers, 50)
    return asked.select("id", "question", "sourceFile", F.md5("answerSnippet").alias("snippet_md5"))


def structure_report(s, d):
    """Every other line of the texts as a heading of one to four marks."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (i % 8 / 2 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    r = report.structure_report(_t(s, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")), 128, 16)
    return r.select("doc_id", "h1", "h2", "h3", "legacy_chunks")


QUERIES = {
    f.__name__: f
    for f in (
        retrieve_low, retrieve_medium, retrieve_high, diagnostic_pool_high, diagnostic_pool_low, signal_counts, answer_prompt, citations, date_catalog, catalog_years, dated_chunks, rebuilt_files, evidence_location,
        evidence_depth, scored_questions, question_problems, candidate_checks, known_failures, run_summary, failure_reasons, keyword_terms, error_lines, short_texts, match_labels, relative_paths, excluded_files,
        embedding_texts, vectors, chunk_keys, calibrated_chunks, converted_papers, structure_report,
    )
}

_RETRIEVE = f"""c AS (SELECT e.vec_id AS key, 'f' || (e.vec_id // 8) AS file_path, (e.vec_id % 8)::INT AS chunk_index, d.text, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
 q AS (SELECT e.vec_id AS query_id, e.embedding::DOUBLE[] AS v, h.embedding::DOUBLE[] AS h, b.text AS question FROM embeddings e LEFT JOIN embeddings h ON h.vec_id = e.vec_id + 1 AND e.vec_id % 100 = 0
  LEFT JOIN benchmark b ON b.item_id * 50 = e.vec_id WHERE e.vec_id % 50 = 0),
 sim AS (SELECT query_id, key, 0 AS no, round(list_cosine_similarity(c.v, q.v), 12) AS s FROM c, q UNION ALL SELECT query_id, key, 1, round(list_cosine_similarity(c.v, q.h), 12) FROM c, q WHERE h IS NOT NULL AND {{high}}),
 lane AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY s DESC, key) AS rank FROM sim WHERE s >= 0.2) WHERE rank <= 50),
 seen AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS base, min(no * 1000 + rank) AS first, arg_max(s, no) AS similarity, string_agg(CASE no WHEN 0 THEN 'vector' ELSE 'hyde' END, ',' ORDER BY no) AS lanes FROM lane GROUP BY 1, 2),
 tok AS (SELECT query_id, key, first, unnest({catalogue.terms_sql("text")}) AS term FROM seen JOIN c USING (key)), qt AS (SELECT DISTINCT query_id, unnest({catalogue.terms_sql("question")}) AS term FROM q),
 n AS (SELECT query_id, count(*) AS n FROM seen GROUP BY 1), tf AS (SELECT query_id, key, any_value(first) AS first, term, count(*) AS tf FROM tok JOIN qt USING (query_id, term) GROUP BY query_id, key, term),
 k AS (SELECT query_id, key, any_value(first) AS first, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)) AS s FROM (SELECT tf.*, n, count(*) OVER (PARTITION BY query_id, term) AS df FROM tf JOIN n USING (query_id)) GROUP BY 1, 2),
 kw AS (SELECT query_id, key, 1.0::DOUBLE / (60 + p) AS boost FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, first) AS p FROM k) WHERE p <= 10),
 dt AS (SELECT query_id, key, 1.0::DOUBLE / 61 AS boost FROM q, c WHERE 20240101 + key % 28 BETWEEN 20240105 + (query_id // 50) % 10 AND 20240108 + (query_id // 50) % 10),
 f AS (SELECT s.*, base + coalesce(kw.boost, 0) + coalesce(dt.boost, 0) AS score, lanes || CASE WHEN kw.key IS NULL THEN '' ELSE ',keyword' END || CASE WHEN dt.key IS NULL THEN '' ELSE ',date' END AS all_lanes
  FROM seen s LEFT JOIN kw USING (query_id, key) LEFT JOIN dt USING (query_id, key)),
 pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, base DESC, first, key) AS p FROM f),
 w AS (SELECT pool.query_id, p, score, pool.similarity, all_lanes, file_path, chunk_index FROM pool JOIN c USING (key) WHERE p <= 5),
 near AS (SELECT w.query_id, p, score, w.similarity, o, all_lanes, c.key, c.file_path, c.chunk_index, c.text,
  row_number() OVER (PARTITION BY w.query_id, c.key ORDER BY o <> 0, p) AS r FROM w, (SELECT unnest([-1, 0, 1]) AS o), c, seen WHERE c.file_path = w.file_path AND c.chunk_index = w.chunk_index + o AND seen.query_id = w.query_id AND seen.key = c.key),
 got AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, o)::INT AS position, CASE WHEN o = 0 THEN all_lanes ELSE '' END AS lanes FROM near WHERE r = 1)"""
_PLAN = _RETRIEVE.format(high="false")
_HIGH = _RETRIEVE.format(high="true")
_DAYS = """cat AS (SELECT DISTINCT o_orderkey::VARCHAR AS key, strftime(x, '%Y%m%d')::INT AS day FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderdate::DATE, o_orderdate::DATE + 40] ELSE [o_orderdate::DATE] END) AS x FROM orders))"""
_SET = f"""d AS (SELECT doc_id, {catalogue._norm("text")} AS t FROM documents), b AS (SELECT item_id, {catalogue._norm("text")} AS s FROM benchmark),
 hits AS (SELECT item_id, doc_id FROM d, b WHERE s <> '' AND contains(' ' || t || ' ', ' ' || s || ' ')),
 qs AS (SELECT DISTINCT item_id || ':' || doc_id AS id, item_id, doc_id FROM (SELECT * FROM hits UNION ALL SELECT item_id, doc_id + 1 FROM hits)),
 located AS (SELECT id, qs.doc_id, s, coalesce(s <> '' AND contains(' ' || t || ' ', ' ' || s || ' '), false) AS found FROM qs JOIN b USING (item_id) LEFT JOIN d ON d.doc_id = qs.doc_id)"""


def _depth() -> str:
    """Runs of every prefix of the ranked chunks, as the definition says."""
    return f"""{catalogue._chunks(64, 0)}, {_SET}, r AS (SELECT id, chunk_index, {catalogue._norm("array_to_string(ws, ' ')")} AS t, s, row_number() OVER (PARTITION BY id ORDER BY md5(id || ':' || chunk_index)) AS rank FROM located JOIN chunks USING (doc_id)),
 pre AS (SELECT a.id, a.rank AS k, b.chunk_index, b.t, a.s FROM r a JOIN r b ON a.id = b.id AND b.rank <= a.rank),
 run AS (SELECT id, k, s, ' ' || string_agg(t, ' ' ORDER BY chunk_index) || ' ' AS t FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY id, k ORDER BY chunk_index) AS g FROM pre) GROUP BY id, k, s, g),
 deep AS (SELECT id, min(k)::INT AS depth FROM run WHERE contains(t, ' ' || s || ' ') GROUP BY 1)"""


SQL = {
    "retrieve_low": f"""WITH {_PLAN}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM sim WHERE s >= 0.2)
 SELECT query_id, rank::INT AS position, key, round(s, 9) AS score, NULL::DOUBLE AS similarity, '' AS lanes FROM t WHERE rank <= 5""",
    "retrieve_medium": f"WITH {_PLAN} SELECT query_id, position, key, round(score, 9) AS score, round(similarity, 6) AS similarity, lanes FROM got",
    "retrieve_high": f"WITH {_HIGH} SELECT query_id, position, key, round(score, 9) AS score, round(similarity, 6) AS similarity, lanes FROM got",
    "diagnostic_pool_high": f"WITH {_HIGH} SELECT query_id, key, p::INT AS position FROM pool WHERE p <= 50",
    "diagnostic_pool_low": f"WITH {_PLAN} SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key)::INT AS position FROM sim) WHERE position <= 20",
    "signal_counts": f"WITH {_HIGH} SELECT query_id, {', '.join(f"count(*) FILTER (list_contains(string_split(lanes, ','), '{x}')) AS {x}" for x in ('vector', 'hyde', 'keyword', 'date'))} FROM got GROUP BY 1",
    "answer_prompt": f"""WITH {_PLAN}, kept AS (SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS top, CASE WHEN chunk_index % 2 = 0 THEN '[File: ' || file_path || ']' || chr(10) ELSE '' END || text AS shown FROM got) WHERE position = 1 OR top <= 0 OR similarity >= 0.5 * top),
 fit AS (SELECT * FROM (SELECT *, sum(len(list_filter(string_split_regex(shown, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY query_id ORDER BY position) AS cum FROM kept) WHERE cum <= 300 OR position <= 1),
 ctx AS (SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY position DESC) AS ctx, count(*) AS used FROM fit GROUP BY 1)
 SELECT q.query_id, md5(coalesce(ctx, '') || chr(10) || '--' || chr(10) || coalesce(question, '')) AS prompt_md5, coalesce(used, 0) AS used FROM q LEFT JOIN ctx ON ctx.query_id = q.query_id""",
    "citations": f"""WITH {_PLAN} SELECT query_id, position, md5(text || ' ' || chr(10) || chr(10) || ' [' || CASE WHEN lanes = '' THEN 'score: ' || printf('%.3f', score) ELSE 'match #' || position || ' via ' ||
 replace(replace(replace(replace(replace(lanes, ',', ', '), 'vector', 'meaning'), 'hyde', 'likely wording'), 'keyword', 'keywords'), 'date', 'dates') END || ']') AS citation_md5, round(score, 9) AS score, file_path AS source FROM got""",
    "date_catalog": f"WITH {_DAYS} SELECT key, day FROM cat",
    "catalog_years": f"WITH {_DAYS} SELECT DISTINCT (day // 10000)::INT AS year FROM cat",
    "dated_chunks": f"WITH {_DAYS} SELECT DISTINCT n_nationkey AS query_id, key FROM nation, cat WHERE day BETWEEN (1992 + n_nationkey % 8) * 10000 + 301 AND (1992 + n_nationkey % 8) * 10000 + 10315 - 10000 * (n_nationkey % 2)",
    "rebuilt_files": f"SELECT doc_id, md5({catalogue._norm('text')}) AS text_md5 FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0",
    "evidence_location": f"WITH {_SET} SELECT id, found FROM located",
    "evidence_depth": f"WITH {_depth()} SELECT id, depth FROM deep",
    "scored_questions": f"""WITH {_depth()}, x AS (SELECT l.id, CASE WHEN l.doc_id % 10 = 3 OR c.doc_id IS NULL THEN 'file-not-indexed' WHEN NOT found THEN 'evidence-not-in-index' END AS reason, depth, n FROM located l
 LEFT JOIN (SELECT DISTINCT doc_id FROM chunks) c USING (doc_id) LEFT JOIN deep USING (id) LEFT JOIN (SELECT id, least(count(*), 6) AS n FROM r GROUP BY 1) USING (id))
 SELECT id, reason, reason IS NULL AS scored, reason IS NULL AND coalesce(depth <= 6, false) AS hit, reason IS NULL AND n IS NOT NULL AS right_file, CASE WHEN reason IS NULL THEN depth END AS pool_rank, coalesce(n, 0) AS returned FROM x""",
    "question_problems": """WITH c AS (SELECT CASE WHEN conv_id % 4 = 0 THEN role ELSE conv_id || '-' || turn END AS id, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS question, role AS f, CASE WHEN conv_id % 5 <> 0 THEN text END AS a FROM conversations)
 SELECT id, 'id is empty' AS problem FROM c WHERE trim(coalesce(id, '')) = '' UNION ALL SELECT id, 'question is empty' FROM c WHERE trim(coalesce(question, '')) = '' UNION ALL SELECT id, 'sourceFile is empty' FROM c WHERE trim(coalesce(f, '')) = ''
 UNION ALL SELECT id, 'answerSnippet is empty' FROM c WHERE trim(coalesce(a, '')) = '' UNION ALL SELECT id, 'id occurs twice' FROM c GROUP BY id HAVING count(*) > 1""",
    "candidate_checks": f"""WITH x AS (SELECT doc_id, d.text, b.text AS q, CASE WHEN doc_id % 4 = 0 THEN b.text ELSE d.text END AS a FROM documents d JOIN benchmark b ON b.item_id = doc_id % 40),
 w AS (SELECT *, list_filter(string_split({catalogue._norm("q")}, ' '), lambda x: length(x) > 1 AND x NOT IN ({catalogue._quoted(T.QUESTION_STOP)})) AS qw, string_split({catalogue._norm("text")}, ' ') AS tw FROM x)
 SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR trim(q) = '' OR trim(a) = '' THEN 'generation-failed' WHEN {catalogue._norm("a")} = '' OR NOT contains(' ' || {catalogue._norm("text")} || ' ', ' ' || {catalogue._norm("a")} || ' ') THEN 'snippet-not-found'
 WHEN len(qw) = 0 OR len(list_filter(qw, lambda x: list_contains(tw, x))) / len(qw)::DOUBLE > 0.3 THEN 'wording-leak' END AS reason FROM w""",
    "known_failures": """WITH e AS (SELECT 'p' || (user_id % 50) AS p, (event_id % 3)::VARCHAR AS h, CASE WHEN event_type <> 'view' THEN event_type END AS r, event_id FROM events),
 l AS (SELECT p, arg_max(h, event_id) AS h, (SELECT r FROM e x WHERE x.p = e.p ORDER BY event_id DESC LIMIT 1) AS r FROM e GROUP BY p)
 SELECT p AS file_path, h AS file_hash, r AS reason, 'known' AS kind FROM l WHERE r IS NOT NULL UNION ALL SELECT DISTINCT p, '1', NULL, 'try' FROM e WHERE p NOT IN (SELECT p FROM l WHERE r IS NOT NULL AND h = '1')""",
    "run_summary": f"""WITH plan AS ({catalogue.SQL["incremental_plan"]}), x AS (SELECT *, (action = 'new' AND file_path LIKE '%3') OR (action = 'updated' AND file_path LIKE '%6') AS bad FROM plan),
 t AS (SELECT count(*) FILTER (action <> 'delete') AS files, count(*) FILTER (action <> 'delete' AND NOT bad) AS successful, count(*) FILTER (bad) AS failed, count(*) FILTER (action = 'skip') AS skipped,
 count(*) FILTER (action = 'new' AND NOT bad) AS new_files, count(*) FILTER (action = 'updated' AND NOT bad) AS updated, count(*) FILTER (action = 'delete') AS deleted FROM x) SELECT *, updated + new_files + deleted > 0 AS changed FROM t""",
    "failure_reasons": "SELECT event_type AS reason, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1",
    "keyword_terms": f"SELECT doc_id, md5(array_to_string({catalogue.terms_sql('text')}, ' ')) AS terms_md5 FROM documents",
    "error_lines": r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '  ' ELSE CASE WHEN doc_id % 2 = 0 THEN '  Error ' ELSE '┌──┐ ' END || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '   at f (x.js:1)' || chr(10) || ' more' ELSE '' END END AS r FROM documents),
 t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '(?s)(?:</>\s*STACK TRACE|\n\s*at\s).*$', ''), '[\x{2500}-\x{257f}]', ' ', 'g'), '^\s*Error\b', ' '), '\s+', ' ', 'g')) AS t FROM r)
 SELECT doc_id, CASE WHEN t = '' THEN 'unknown error' WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS line FROM t""",
    "short_texts": r"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS l FROM documents), c AS (SELECT *, left(array_to_string(l[1:3], chr(10)), 400) AS c FROM t)
 SELECT doc_id, md5(CASE WHEN len(l) > 3 OR length(text) > length(c) THEN rtrim(c) || '…' ELSE c END) AS short_md5 FROM c""",
    "match_labels": """WITH o AS (SELECT o_orderkey, o_totalprice / 1e6 AS s, list_filter([CASE WHEN o_orderkey & 1 > 0 THEN 'meaning' END, CASE WHEN o_orderkey & 2 > 0 THEN 'likely wording' END, CASE WHEN o_orderkey & 4 > 0 THEN 'keywords' END, CASE WHEN o_orderkey & 8 > 0 THEN 'dates' END, CASE WHEN o_orderkey & 16 > 0 THEN 'other' END], lambda x: x IS NOT NULL) AS l FROM orders)
 SELECT o_orderkey, CASE WHEN len(l) = 0 THEN 'score: ' || printf('%.3f', s) ELSE 'match #' || (o_orderkey % 9) || ' via ' || array_to_string(l, ', ') END AS label FROM o""",
    "relative_paths": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS path FROM pages",
    "excluded_files": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS r FROM pages), b AS (SELECT *, string_split(r, '/')[-1] AS n FROM p)
 SELECT page_id, CASE WHEN n LIKE '%.html' THEN '*.html' WHEN r LIKE 'en/%' THEN 'en/**' WHEN r LIKE 'fr/%' AND length(r) - length(replace(r, '/', '')) = 1 OR r LIKE '%/fr/%' AND regexp_matches(r, '/fr/[^/]*$') THEN '**/fr/*'
 WHEN regexp_matches(n, '^[0-9].*.page=2') THEN '[0-9]*?page=2*' WHEN n IN ('page.php', 'page.asp') THEN 'page.{php,asp}' END AS pattern FROM b""",
    "embedding_texts": "SELECT doc_id, md5('search_document: ' || text) AS document_md5, md5('search_query: ' || text) AS query_md5, md5(text) AS plain_md5 FROM documents",
    "vectors": "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "chunk_keys": "SELECT l_orderkey, l_linenumber, 'shard_' || (l_orderkey % 7) || '/' || l_orderkey || '-' || l_linenumber AS chunk_key FROM lineitem",
    "calibrated_chunks": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, ceil(length(text) / 4.0::DOUBLE) AS tk FROM documents),
 m AS (SELECT *, greatest(1, floor(200 / (tk / len(w)) + 0.5))::INT AS size, floor(40 / (tk / len(w)) + 0.5)::INT AS lap FROM w WHERE len(w) > 0), z AS (SELECT *, greatest(1, size - least(greatest(lap, 0), size - 1)) AS step FROM m),
 c AS (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - size) / step::DOUBLE))::INT + 1))::INT AS chunk_index FROM z)
 SELECT doc_id, chunk_index, chunk_index * step AS start_index, least(chunk_index * step + size, len(w))::INT AS end_index, md5(array_to_string(list_slice(w, chunk_index * step + 1, chunk_index * step + size), ' ')) AS text_md5 FROM c""",
    "structure_report": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 h AS (SELECT doc_id, count(*) FILTER (i % 8 = 0) AS h1, count(*) FILTER (i % 8 = 2) AS h2, count(*) FILTER (i % 8 IN (4, 6)) AS h3 FROM l WHERE i % 2 = 0 AND regexp_matches(x, '\S') GROUP BY 1),
 p AS (SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 AND regexp_matches(x, '\S') THEN x WHEN i % 2 = 0 THEN '' ELSE regexp_replace(x, '^[ \t]*-[ \t]+', '') END, ' ' ORDER BY i) AS t FROM l GROUP BY 1),
 w AS (SELECT doc_id, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n FROM p), m AS (SELECT doc_id, n, greatest(1, floor(128 / (ceil(n * 1.3::DOUBLE) / n) + 0.5)) AS win, floor(16 / (ceil(n * 1.3::DOUBLE) / n) + 0.5) AS lap FROM w WHERE n > 0),
 c AS (SELECT doc_id, (greatest(0, ceil((n - win) / greatest(1, win - least(lap, win - 1)))) + 1)::BIGINT AS k FROM m)
 SELECT d.doc_id, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2, coalesce(h3, 0) AS h3, coalesce(k, 0) AS legacy_chunks FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "converted_papers": """WITH ids AS (SELECT DISTINCT conv_id FROM conversations ORDER BY lpad(conv_id::VARCHAR, 6, '0') LIMIT 50)
 SELECT conv_id || '-' || turn AS id, role AS question, lpad(conv_id::VARCHAR, 6, '0') || '.txt' AS sourceFile, md5(text) AS snippet_md5 FROM conversations JOIN ids USING (conv_id) WHERE turn % 2 <> 0 AND turn % 3 <> 0 AND trim(text) = text AND text <> ''""",
}
