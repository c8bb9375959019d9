"""Retrieval over the vector stand-in, and over sliding chunks for questions taken from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..functions import chunking as C
from ..operators import retrieval as R
from ..registry import query

#: The stated query set of vector search: rows whose id is divisible by 50, against all rows.
VECTOR_QUERIES = "SELECT vec_id AS query_id, namespace, embedding FROM vectors WHERE vec_id % 50 = 0"
SCORED = "SELECT q.query_id, v.chunk_id, v.raptor_level, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM vectors v JOIN ({0}) q ON v.namespace = q.namespace".format(VECTOR_QUERIES)
QUESTIONS = """
    SELECT conv_id AS query_id, concat('src', CAST(conv_id % 20 AS STRING)) AS course_id, text AS question
    FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') x WHERE r = 1"""
#: The same chunks in DuckDB.
CHUNKS = """
    SELECT course_id, doc_id * 1000000 + CAST(s / 700 AS BIGINT) AS chunk_id, filename, page_number AS page, substring(text, s + 1, 800) AS content
    FROM (SELECT p.course_id, p.doc_id, p.filename, p.page_number, p.text, unnest(range(0, CAST(length(p.text) AS BIGINT), 700)) AS s FROM corpus_pages p JOIN materials m ON p.doc_id = m.material_id WHERE m.status = 'ready' AND length(p.text) > 0) y"""
KEYWORD = f"""
    q AS (SELECT *, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: length(w) > 2) AS ws FROM ({QUESTIONS}) q0), c AS ({CHUNKS}),
    s AS (SELECT q.query_id, q.question, q.ws, c.chunk_id, c.filename, c.page, c.content, len(list_filter(q.ws, lambda w: contains(lower(c.content), w))) AS score FROM c JOIN q ON c.course_id = q.course_id),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 OR len(ws) = 0) z WHERE rank <= 5)"""


def questions(v: Views) -> DataFrame:
    return v.sql(QUESTIONS)


def chunks(v: Views) -> DataFrame:
    ready = v.materials.where("status = 'ready'").select(F.col("material_id").alias("doc_id"))
    cut = C.sliding_chunks(v.corpus_pages.join(ready, "doc_id", "left_semi").select("doc_id", "course_id", "filename", F.col("page_number").alias("page"), "text"))
    return cut.select("course_id", (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), "filename", "page", F.lit(0).alias("raptor_level"), "content")


def keyword(v: Views) -> DataFrame:
    return R.keyword_top_k(questions(v), chunks(v))


@query("j9_vector_join", f"SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS avg_score FROM ({SCORED}) x WHERE raptor_level IN (0, 1) GROUP BY query_id")
def j9(v: Views) -> DataFrame:
    scored = R.vector_scores(v.sql(VECTOR_QUERIES), v.vectors, (0, 1))
    return scored.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


TOP = "SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ({0}) x) y WHERE rank <= {1}"


def _top(v: Views, k: int) -> DataFrame:
    return R.exact_top_k(v.sql(VECTOR_QUERIES), v.vectors, k).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("k1_vector_top_100", TOP.format(SCORED, 100))
def k1(v: Views) -> DataFrame:
    return _top(v, R.TOP_VECTORS)


@query("v2_exact_top_10", TOP.format(SCORED, 10))
def v2(v: Views) -> DataFrame:
    return _top(v, 10)


@query("w1_result_rank", f"SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM ({TOP.format(SCORED, 20)}) t WHERE rank > 10")
def w1(v: Views) -> DataFrame:
    return _top(v, 20).where("rank > 10").select("query_id", "chunk_id", "rank")


@query("v3_approximate_top_10")
def v3(v: Views) -> DataFrame:
    return R.approximate_top_k(v.sql(VECTOR_QUERIES), v.vectors, 10)


@query("v1_embedding")
def v1(v: Views) -> DataFrame:
    made = R.embed(v.conversations.select("conv_id", "turn", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select("conv_id", "turn", F.round(norm, 4).alias("norm"), F.size(F.filter("embedding", lambda x: x != 0)).alias("n_terms"))


@query("k3_keyword_top_5", f"WITH {KEYWORD.strip()} SELECT query_id, chunk_id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM k")
def k3(v: Views) -> DataFrame:
    return keyword(v).select("query_id", "chunk_id", "score", "rank")


OVERLAP = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
RERANKED = f"""WITH {KEYWORD.strip()}, o AS (SELECT k.*, {OVERLAP.format('question')} AS qt, {OVERLAP.format('content')} AS ct FROM k),
    r AS (SELECT query_id, chunk_id, score AS first_score, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt) ELSE 0.0 END AS second FROM o)"""


@query("v4_rerank", f"{RERANKED} SELECT query_id, chunk_id, round(second, 6) AS score FROM r")
def v4(v: Views) -> DataFrame:
    return R.rerank(keyword(v)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("k2_rerank_top_2", f"{RERANKED} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, true AS reranked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, first_score DESC, chunk_id) AS rank FROM r) t WHERE rank <= 2")
def k2(v: Views) -> DataFrame:
    return R.rerank(keyword(v), 2).select("query_id", "chunk_id", "rank", "reranked")


@query("j14_score_by_index", f"WITH {KEYWORD.strip()} SELECT query_id, chunk_id, CAST(1.0 / rank AS DOUBLE) AS second_score FROM k WHERE rank <= 3")
def j14(v: Views) -> DataFrame:
    candidates = keyword(v).withColumn("candidate_index", F.col("rank") - 1)
    scores = candidates.where("candidate_index < 3").select("query_id", F.col("candidate_index").alias("index"), (1.0 / (F.col("candidate_index") + 1)).alias("score"))
    return R.attach_by_index(candidates, scores).select("query_id", "chunk_id", "second_score")


@query("w3_context_budget", f"""
    WITH {KEYWORD.strip()}, b AS (SELECT query_id, rank, sum(length(concat('[Source ', CAST(rank AS VARCHAR), ': ', filename, ', p.', CAST(page AS VARCHAR), ']', chr(10), content))) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM k)
    SELECT query_id, CAST(sum(CASE WHEN so_far <= 2000 THEN 1 ELSE 0 END) AS BIGINT) AS n_used, CAST(sum(CASE WHEN so_far <= 2000 THEN 0 ELSE 1 END) AS BIGINT) AS n_truncated FROM b GROUP BY query_id""")
def w3(v: Views) -> DataFrame:
    return R.pack_context(keyword(v), 2000).select("query_id", "n_used", "n_truncated")


@query("f9_citations", f"WITH {KEYWORD.strip()} SELECT query_id, CAST(rank AS INT) AS rank, filename, page, substring(content, 1, 300) AS excerpt FROM k WHERE rank % 2 = 1")
def f9(v: Views) -> DataFrame:
    marked = keyword(v).withColumn("chunk_type", F.when(F.col("rank") % 2 == 0, "raptor_summary").otherwise("text"))
    return R.citations_of(marked).select("query_id", "rank", "filename", "page", "excerpt")


@query("x18_citation_list", f"WITH {KEYWORD.strip()} SELECT query_id, string_agg(concat(filename, ' p.', CAST(page AS VARCHAR)), '; ' ORDER BY rank) AS citations FROM k GROUP BY query_id")
def x18(v: Views) -> DataFrame:
    return R.citation_list(keyword(v))


CITES = "SELECT doc_id AS citation_id, source AS course_id, concat('DOC_', CAST(doc_id AS STRING), '.txt') AS file_name, CAST(NULLIF(doc_id % 6, 0) AS INT) AS page, substring(text, 1, 400) AS excerpt FROM documents"


@query("j7_match_citations", f"""
    WITH c AS ({CITES}), h AS (SELECT c.citation_id, max(m.material_id) AS material_id FROM c JOIN materials m ON c.course_id = m.course_id AND m.status = 'ready' AND contains(lower(m.file_name), lower(regexp_replace(c.file_name, '\\.[^.]*$', ''))) GROUP BY 1)
    SELECT c.citation_id, h.material_id, coalesce(page, 0) AS page, substring(excerpt, 1, 240) AS snippet FROM c LEFT JOIN h ON c.citation_id = h.citation_id""")
def j7(v: Views) -> DataFrame:
    return R.match_citations(v.sql(CITES), v.materials)


@query("x23_fallback_answer", f"""
    WITH {KEYWORD.strip()}, a AS (SELECT query_id, concat('From ', string_agg(concat(filename, ' (Page ', CAST(page AS VARCHAR), ')'), ', ' ORDER BY rank), ':', chr(10), chr(10), string_agg(concat('> ', trim(content)), concat(chr(10), chr(10)) ORDER BY rank)) AS answer FROM k WHERE rank <= 2 GROUP BY query_id)
    SELECT q.query_id, q.question, coalesce(a.answer, '{R.NO_MATCH}') AS answer FROM q LEFT JOIN a ON q.query_id = a.query_id""")
def x23(v: Views) -> DataFrame:
    return R.fallback_answers(questions(v), keyword(v))


@query("v5_two_stage", f"""{RERANKED}, top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, first_score DESC, chunk_id) AS rank FROM r)
    SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids FROM top GROUP BY query_id""")
def v5(v: Views) -> DataFrame:
    ranked = R.rerank(keyword(v))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))
