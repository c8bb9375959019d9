"""Learning analytics over the session, interaction and event stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..operators import analytics as A
from ..registry import query

STRUGGLE = """
    WITH asked AS (SELECT session_id, count(*) AS n FROM chat_messages WHERE role = 'user' GROUP BY session_id)
    SELECT s.course_id, lower(trim(s.title)) AS topic, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS questions_asked, coalesce(round(avg(s.confidence_score), 4), 0.0) AS avg_confidence,
           CAST(count(DISTINCT CASE WHEN s.confidence_score < 0.5 THEN s.user_id END) AS BIGINT) AS struggling_students
    FROM chat_sessions s LEFT JOIN asked a ON s.session_id = a.session_id WHERE trim(s.title) <> ''"""


@query("a1_topic_struggle", STRUGGLE + " AND s.course_id = 'src3' GROUP BY 1, 2")
def a1(v: Views) -> DataFrame:
    return A.topic_struggle(v.chat_sessions.where("course_id = 'src3'"), v.chat_messages)


@query("a2_full_recompute", STRUGGLE + " GROUP BY 1, 2")
def a2(v: Views) -> DataFrame:
    return A.topic_struggle(v.chat_sessions, v.chat_messages)


WORDS = "array_to_string(list_slice(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''), 1, 3), ' ')"


@query("a3_keyword_heatmap", f"""
    WITH m AS (SELECT session_id, {WORDS.format('content')} AS topic FROM chat_messages WHERE role = 'user')
    SELECT s.course_id, m.topic, CAST(count(*) AS BIGINT) AS questions_asked, CAST(count(DISTINCT s.user_id) AS BIGINT) AS students, 0.5 AS avg_confidence
    FROM m JOIN chat_sessions s ON m.session_id = s.session_id WHERE m.topic <> '' GROUP BY 1, 2""")
def a3(v: Views) -> DataFrame:
    return A.keyword_heatmap(v.chat_sessions, v.chat_messages)


@query("x15_leading_words", f"SELECT session_id, turn, {WORDS.format('content')} AS topic FROM chat_messages")
def x15(v: Views) -> DataFrame:
    return v.chat_messages.select("session_id", "turn", A.leading_words(F.col("content")).alias("topic"))


SCORED = "SELECT *, " + ", ".join(f"TRY_CAST(json_extract_string(ragas_json, '$.{s}') AS DOUBLE) AS {s}" for s in A.SCORES) + " FROM interactions"


@query("a4_failure_heatmap", f"SELECT course_id, bloom_level, CAST(count(*) AS BIGINT) AS n, coalesce(round(avg(CASE WHEN faithfulness < 0.5 THEN 1.0 ELSE 0.0 END), 4), 0) AS failure_rate, CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions FROM ({SCORED}) x GROUP BY 1, 2")
def a4(v: Views) -> DataFrame:
    return A.failure_heatmap(v.interactions)


@query("a5_quality_summary", f"""
    SELECT course_id, CAST(count(*) AS BIGINT) AS n, CAST(count(ragas_json) AS BIGINT) AS scored, CAST(sum(CASE WHEN context_precision IS NOT NULL AND context_recall IS NOT NULL AND faithfulness IS NOT NULL AND answer_relevancy IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS complete_count,
           {', '.join(f'round(avg({s}), 4) AS avg_{s}' for s in A.SCORES)}, CASE WHEN avg(faithfulness) IS NULL THEN 'unknown' WHEN avg(faithfulness) >= 0.85 THEN 'low' WHEN avg(faithfulness) >= 0.6 THEN 'medium' ELSE 'high' END AS risk
    FROM ({SCORED}) x GROUP BY course_id""")
def a5(v: Views) -> DataFrame:
    return A.quality_summary(v.interactions)


@query("x13_risk_band", f"SELECT id, CASE WHEN faithfulness IS NULL THEN 'unknown' WHEN faithfulness >= 0.85 THEN 'low' WHEN faithfulness >= 0.6 THEN 'medium' ELSE 'high' END AS risk FROM ({SCORED}) x")
def x13(v: Views) -> DataFrame:
    return v.interactions.select("id", A.risk_band(A.score_of(F.col("ragas_json"), "faithfulness")).alias("risk"))


RAW_SCORES = "SELECT id, raw FROM (VALUES (-1, '0.5'), (-2, 'NaN'), (-3, '-0.2'), (-4, '1.3'), (-5, 'abc'), (-6, NULL)) AS t(id, raw) UNION ALL SELECT event_id, CAST(value / 100 AS STRING) FROM events"


@query("x14_sanitised_scores", f"""
    WITH s AS (SELECT id, TRY_CAST(raw AS DOUBLE) AS x FROM ({RAW_SCORES}) r)
    SELECT id, CASE WHEN x IS NULL OR isnan(x) THEN NULL ELSE round(least(greatest(x, 0.0), 1.0), 4) END AS score FROM s""")
def x14(v: Views) -> DataFrame:
    return v.sql(RAW_SCORES).select(F.col("id").cast("long").alias("id"), A.sanitised_score(F.col("raw")).alias("score"))


@query("a9_total_and_page", "SELECT course_id, id, CAST(total AS BIGINT) AS total FROM (SELECT course_id, id, count(*) OVER (PARTITION BY course_id) AS total, row_number() OVER (PARTITION BY course_id ORDER BY ts DESC, id) AS r FROM interactions) x WHERE r BETWEEN 6 AND 25")
def a9(v: Views) -> DataFrame:
    return A.total_and_page(v.interactions, "course_id", [F.desc("ts"), F.asc("id")], 20, 5).select("course_id", "id", "total")


@query("a11_ingest_stats", "SELECT course_id, CAST(sum(CASE WHEN doc_id % 9 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_text, CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_multimodal FROM corpus_pages GROUP BY course_id")
def a11(v: Views) -> DataFrame:
    kinds = v.corpus_pages.select("course_id", F.when(F.col("doc_id") % 9 == 0, "multimodal").otherwise("text").alias("chunk_type"))
    return A.ingest_stats(kinds, "course_id")


@query("w6_request_rates", """
    WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_day,
           count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM e""")
def w6(v: Views) -> DataFrame:
    return A.request_rates(v.events, "user_id", "ts", limit=3).select("event_id", "in_day", "over_limit")


@query("j12_cache_lookup", """
    WITH e AS (SELECT event_id, cache_key, kind, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM cache_events),
    r AS (SELECT *, max(CASE WHEN kind = 'register' THEN s END) OVER (PARTITION BY cache_key ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS reg FROM e)
    SELECT event_id, cache_key, CASE WHEN reg IS NULL THEN 'miss' WHEN s < reg + 86400 - 300 THEN 'hit' ELSE 'expired' END AS outcome FROM r WHERE kind = 'request'""")
def j12(v: Views) -> DataFrame:
    return A.cache_lookup(v.cache_events)


@query("x17_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens, floor(length(text) / 4) >= 32768 AS eligible FROM corpus_pages")
def x17(v: Views) -> DataFrame:
    tokens = A.token_estimate(F.col("text"))
    return v.corpus_pages.select("doc_id", tokens.alias("tokens"), A.cache_eligible(tokens).alias("eligible"))
