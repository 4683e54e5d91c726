"""Registered queries of the retrieval engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluation, indexing, retrieval


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _lane(s: SparkSession, d: str, limit: int = 50) -> DataFrame:
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), q, limit, 0.2)


def vector_topk(s, d):
    return _lane(s, d, 10).select("query_id", "key", "rank", F.round("score", 6).alias("score"))


def two_lane_rrf(s, d):
    e = _t(s, d, "embeddings")
    drafts = e.where("vec_id % 50 = 1").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("vector"))
    v = _lane(s, d).withColumn("lane", F.lit("vector")).withColumn("lane_no", F.lit(0))
    k = retrieval.vector_topk(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), drafts, 50, 0.2).withColumn("lane", F.lit("hyde")).withColumn("lane_no", F.lit(1))
    out = retrieval.fuse(v.unionByName(k).withColumn("weight", F.lit(1.0)))
    return out.where("position <= 5").select("query_id", "key", "position", F.round("score", 9).alias("score"), F.array_join("lanes", ",").alias("lanes"))


def relevance_cut(s, d):
    p = _lane(s, d, 10).withColumn("similarity", F.lit(None).cast("double"))
    return retrieval.relevance_cut(p, 0.9).select("query_id", "key", "rank")


def context_fit(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 128, 16).select(F.col("doc_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), (F.col("end_index") - F.col("start_index")).cast("long").alias("tokens"))
    return retrieval.fit_budget(c, 600).select("query_id", "rank", "cum_tokens")


def legacy_chunks(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 128, 16)
    return c.select("doc_id", "chunk_index", "start_index", "end_index", F.md5("text").alias("text_md5"))


def trim_overlap(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 64, 8).withColumn("file_path", F.col("doc_id"))
    return retrieval.trim_overlap(c).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def neighbours(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 64, 8).select(F.col("doc_id").alias("file_path"), "chunk_index")
    w = c.where("chunk_index % 5 = 0").select(F.lit(0).alias("query_id"), (F.col("chunk_index") + 1).alias("winner_rank"), "file_path", "chunk_index", (1 / (F.col("chunk_index") + 1)).alias("score"))
    return retrieval.neighbours(w, c).select("file_path", "chunk_index", "winner_rank", "offset", F.round("score", 9).alias("score"))


def adjacent_runs(s, d):
    c = indexing.window_chunks(_t(s, d, "documents"), 64, 0).where("chunk_index % 3 <> 2").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("file_path"), "chunk_index", "text", (100 - F.col("chunk_index")).alias("rank"))
    return retrieval.adjacent_runs(c).select("file_path", F.md5("text").alias("text_md5"), "first_position", "n_chunks")


def store_stats(s, d):
    x = _t(s, d, "documents")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.sha2("text", 256)).alias("files"))


def incremental_plan(s, d):
    x = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "doc_id", "text")
    old = x.where("doc_id % 5 <> 0").select("file_path", F.md5("text").alias("file_hash"))
    new = x.where("doc_id % 7 <> 0").select("file_path", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("file_hash"))
    return indexing.incremental_plan(old, new)


def md_plain(s, d):
    md = F.concat(F.lit("## Document "), F.col("doc_id").cast("string"), F.lit("\n# "), F.regexp_replace("text", "\n", "\n  - "))
    return _t(s, d, "documents").select("doc_id", F.md5(T.markdown_plain(md)).alias("plain_md5"))


def context_header(s, d):
    x = _t(s, d, "orders")
    section = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit(""))
    return x.select("o_orderkey", T.context_header(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), section).alias("header"))


def normalised_text(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("norm_md5"))


def bm25(s, d):
    items = _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.keyword_terms(F.col("text"))).alias("term"))
    n = F.lit(40)
    c = _t(s, d, "documents").select(F.pmod("doc_id", n).alias("query_id"), F.col("doc_id").alias("key"), T.keyword_terms(F.col("text")).alias("tokens"))
    return retrieval.bm25(c, items, 1.2, 0.4).select("query_id", "key", F.round("score", 6).alias("score"))


def snippet_containment(s, d):
    return evaluation.locate(_t(s, d, "documents"), _t(s, d, "benchmark"))


def eval_metrics(s, d):
    e = _t(s, d, "events").select((F.col("event_id") % 5 != 0).alias("scored"), (F.col("event_id") % 3 == 0).alias("hit"), (F.col("event_id") % 2 == 0).alias("right_file"), F.when(F.col("event_id") % 4 != 1, F.col("event_id") % 7 + 1).alias("pool_rank"))
    m = evaluation.metrics(e)
    return m.select("scored", "unscorable", "hits", *[F.round(c, 6).alias(c) for c in ("filter_loss", "hit_rate", "pool_hit_rate", "passage_accuracy", "mrr", "median_pool_rank")])


def latencies(s, d):
    t = evaluation.latencies(_t(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
    return t.select("stage", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def wording_leak(s, d):
    x = _t(s, d, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(40)).alias("item_id"))
    y = _t(s, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return x.join(y, "item_id").select("doc_id", F.round(evaluation.leak_ratio(F.col("question"), F.col("text")), 6).alias("ratio"), evaluation.is_leak(F.col("question"), F.col("text"), 0.3).alias("leak"))


def round_robin_sample(s, d):
    x = _t(s, d, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("key"), "text")
    return evaluation.round_robin(x, 42, 30, evaluation.MIN_WORDS).select("file_path", "key", "turn")


def structured_chunks(s, d):
    return chunking.chunk_documents(_t(s, d, "documents"), 128).select("doc_id", "chunk_index", "start_index", "end_index", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (vector_topk, two_lane_rrf, relevance_cut, context_fit, legacy_chunks, trim_overlap, neighbours, adjacent_runs, store_stats, incremental_plan, md_plain, context_header, normalised_text, bm25, snippet_containment, eval_metrics, latencies, wording_leak, round_robin_sample, structured_chunks)}

_LANE = """lane AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS key, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
 FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.2) WHERE rank <= {n})"""


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def terms_sql(c: str) -> str:
    """Keyword terms by the rules as they are written down: stop words and single letters out, then the first ending that fits."""
    stop = """a an and are as at be but by can did do does for from had has have he her his how i if in into is it its me my of on or our she so some than that the
        their them then there these they this to was we were what when where which who why will with would you your""".split()
    kept = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({_quoted(stop)}))"
    return rf"""list_transform({kept}, lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN left(x, -3) || 'y' WHEN length(x) > 4 AND x LIKE '%ing' THEN left(x, -3)
        WHEN length(x) > 3 AND (x LIKE '%ed' OR x LIKE '%es') THEN left(x, -2) WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, -1) ELSE x END)"""


def _chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
 c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {step}::DOUBLE))::INT + 1))::INT AS chunk_index FROM w WHERE len(w) > 0),
 chunks AS (SELECT doc_id, chunk_index, chunk_index * {step} AS start_index, least(chunk_index * {step} + {size}, len(w))::INT AS end_index,
 list_slice(w, chunk_index * {step} + 1, chunk_index * {step} + {size}) AS ws FROM c)"""


SQL = {
    "vector_topk": f"WITH {_LANE.format(n=10)} SELECT query_id, key, rank::INT AS rank, round(score, 6) AS score FROM lane",
    "two_lane_rrf": f"""WITH {_LANE.format(n=50)}, h AS (SELECT q.vec_id - 1 AS query_id, c.vec_id AS key, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 1),
 l AS (SELECT query_id, key, rank, 0 AS no, 'vector' AS lane FROM lane UNION ALL
 SELECT query_id, key, rank, 1, 'hyde' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key) AS rank FROM h WHERE score >= 0.2) WHERE rank <= 50),
 f AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(no * 100000 + rank) AS first, string_agg(lane, ',' ORDER BY no) AS lanes FROM l GROUP BY 1, 2)
 SELECT query_id, key, position::INT AS position, round(score, 9) AS score, lanes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS position FROM f) WHERE position <= 5""",
    "relevance_cut": f"WITH {_LANE.format(n=10)} SELECT query_id, key, rank::INT AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM lane) WHERE rank = 1 OR score >= 0.9 * top",
    "context_fit": f"WITH {_chunks(128, 16)}, s AS (SELECT doc_id AS query_id, chunk_index + 1 AS rank, sum(end_index - start_index) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS cum_tokens FROM chunks) SELECT * FROM s WHERE cum_tokens <= 600 OR rank <= 1",
    "legacy_chunks": f"WITH {_chunks(128, 16)} SELECT doc_id, chunk_index, start_index, end_index, md5(array_to_string(ws, ' ')) AS text_md5 FROM chunks",
    "trim_overlap": f"""WITH {_chunks(64, 8)}, o AS (SELECT *, lag(end_index) OVER (PARTITION BY doc_id ORDER BY chunk_index) - start_index AS o FROM chunks)
 SELECT doc_id, chunk_index, md5(array_to_string(CASE WHEN o > 0 AND o < len(ws) THEN list_slice(ws, o + 1, len(ws)) ELSE ws END, ' ')) AS text_md5 FROM o""",
    "neighbours": f"""WITH {_chunks(64, 8)}, n AS (SELECT a.doc_id AS file_path, a.chunk_index + o.o AS chunk_index, a.chunk_index + 1 AS winner_rank, o.o AS "offset"
 FROM chunks a, (SELECT unnest([-1, 0, 1])::INT AS o) o WHERE a.chunk_index % 5 = 0)
 SELECT file_path, chunk_index, winner_rank, "offset", round(1.0::DOUBLE / winner_rank, 9) AS score FROM (SELECT n.*, row_number() OVER (PARTITION BY n.file_path, n.chunk_index ORDER BY abs("offset") > 0, winner_rank) AS r
 FROM n JOIN chunks c ON c.doc_id = n.file_path AND c.chunk_index = n.chunk_index) WHERE r = 1""",
    "adjacent_runs": f"""WITH {_chunks(64, 0)}, k AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS island FROM chunks WHERE chunk_index % 3 <> 2)
 SELECT doc_id AS file_path, md5(string_agg(array_to_string(ws, ' '), ' ' ORDER BY chunk_index)) AS text_md5, min(100 - chunk_index) AS first_position, count(*) AS n_chunks FROM k GROUP BY doc_id, island""",
    "store_stats": "SELECT source, count(*) AS chunks, count(DISTINCT sha256(text)) AS files FROM documents GROUP BY 1",
    "incremental_plan": """WITH a AS (SELECT doc_id::VARCHAR AS p, text AS h FROM documents WHERE doc_id % 5 <> 0),
 b AS (SELECT doc_id::VARCHAR AS p, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS h FROM documents WHERE doc_id % 7 <> 0)
 SELECT coalesce(a.p, b.p) AS file_path, CASE WHEN b.p IS NULL THEN 'delete' WHEN a.p IS NULL THEN 'new' WHEN a.h = b.h THEN 'skip' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.p = b.p""",
    "md_plain": r"""SELECT doc_id, md5(regexp_replace(regexp_replace('## Document ' || doc_id || chr(10) || '# ' || replace(text, chr(10), chr(10) || '  - '), '(?m)^#{1,6}[ \t]+', '', 'g'), '(?m)^[ \t]*-[ \t]+', '', 'g')) AS plain_md5 FROM documents""",
    "context_header": """SELECT o_orderkey, '[File: o' || o_orderkey || ' | Posted: ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' | Section: ' || o_orderpriority ELSE '' END || ']' AS header FROM orders""",
    "normalised_text": r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm_md5 FROM documents",
    "bm25": f"""WITH t AS (SELECT doc_id % 40 AS q, doc_id, {terms_sql("text")} AS w FROM documents), i AS (SELECT DISTINCT item_id AS q, unnest({terms_sql("text")}) AS term FROM benchmark),
 n AS (SELECT q, count(*) AS n, avg(len(w)) AS mean FROM t GROUP BY 1), tf AS (SELECT q, doc_id, len(w) AS len, term, count(*) AS tf FROM (SELECT q, doc_id, w, unnest(w) AS term FROM t) JOIN i USING (q, term) GROUP BY ALL),
 s AS (SELECT tf.*, n, mean, count(*) OVER (PARTITION BY tf.q, term) AS df FROM tf JOIN n USING (q))
 SELECT q AS query_id, doc_id AS key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.6 + 0.4 * len / mean))), 6) AS score FROM s GROUP BY 1, 2""",
    "snippet_containment": r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents),
 b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS s FROM benchmark)
 SELECT doc_id, item_id FROM d, b WHERE trim(s) <> '' AND contains(t, s)""",
    "eval_metrics": """WITH e AS (SELECT event_id % 5 <> 0 AS scored, event_id % 3 = 0 AS hit, event_id % 2 = 0 AS rf, CASE WHEN event_id % 4 <> 1 THEN event_id % 7 + 1 END AS pr FROM events),
 x AS (SELECT count(*) FILTER (scored)::DOUBLE AS n, count(*) FILTER (NOT scored) AS u, count(*) FILTER (scored AND hit) AS h, count(*) FILTER (scored AND rf AND NOT hit) AS w, count(*) FILTER (scored AND pr IS NOT NULL) AS p,
 count(*) FILTER (scored AND NOT hit AND pr IS NOT NULL) AS f, avg(coalesce(1.0::DOUBLE / pr, 0)) FILTER (scored) AS mrr, median(pr) FILTER (scored) AS mid FROM e)
 SELECT n::BIGINT AS scored, u AS unscorable, h AS hits, round(f / n, 6) AS filter_loss, round(h / n, 6) AS hit_rate, round(p / n, 6) AS pool_hit_rate, round(h / (h + w)::DOUBLE, 6) AS passage_accuracy, round(mrr, 6) AS mrr, round(mid, 6) AS median_pool_rank FROM x""",
    "latencies": """WITH x AS (SELECT event_type AS stage, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT stage, round(median(ms), 6) AS median, round(max(ms) FILTER (k = ceil(0.95 * n)), 6) AS p95 FROM x GROUP BY 1""",
    "wording_leak": f"""WITH m AS (SELECT doc_id, doc_id % 40 AS item_id, {_norm("text")} AS t FROM documents), b AS (SELECT item_id, list_filter(string_split({_norm("text")}, ' '), lambda x: length(x) > 1 AND x NOT IN ({_quoted(T.QUESTION_STOP)})) AS q FROM benchmark),
 r AS (SELECT doc_id, CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(q, lambda x: list_contains(string_split(t, ' '), x))) / len(q)::DOUBLE END AS r FROM m JOIN b USING (item_id))
 SELECT doc_id, round(r, 6) AS ratio, r > 0.3 AS leak FROM r""",
    "round_robin_sample": "SELECT file_path, key, turn::INT AS turn FROM (SELECT source AS file_path, doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 40) ORDER BY turn, md5('42:' || file_path), file_path LIMIT 30",
}
