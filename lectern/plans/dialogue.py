"""Dialogue operators over conversations and verdict stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..operators import dialogue as D
from ..operators.wiki import course_wiki
from ..registry import query
from .retrieval import KEYWORD, keyword, questions


@query("w2_history", """
    SELECT session_id, string_agg(concat(upper(role), ': ', content), chr(10) ORDER BY age) AS history, CAST(count(*) AS INT) AS n_turns
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role) AS age FROM chat_messages) x WHERE age <= 6 GROUP BY session_id""")
def w2(v: Views) -> DataFrame:
    return D.history(v.chat_messages)


@query("w2_recent_ascending", "SELECT session_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role) AS age FROM chat_messages) x WHERE age <= 10")
def w2_recent(v: Views) -> DataFrame:
    return D.recent_ascending(v.chat_messages).select("session_id", "turn")


FIELD = "coalesce(TRY_CAST(json_extract_string(j, '$.{0}') AS DOUBLE), 1.0)"
PARSED = "SELECT answer_id, raw, CASE WHEN raw = 'not json' THEN NULL ELSE raw END AS j FROM verdicts"


@query("x10_verdicts", f"SELECT answer_id, true AS passed, CASE WHEN j IS NULL THEN 0.8 ELSE {FIELD.format('score')} END AS score, {FIELD.format('groundedness')} AS groundedness, CASE WHEN j IS NULL THEN 'verifier_json_error' ELSE '' END AS flags FROM ({PARSED}) x")
def x10(v: Views) -> DataFrame:
    parsed = v.verdicts.select("answer_id", D.parse_verdict(F.col("raw")).alias("p"))
    return parsed.select("answer_id", "p.passed", "p.score", "p.groundedness", F.array_join("p.flags", ",").alias("flags"))


@query("x12_gate", f"""
    SELECT answer_id, concat_ws(',', {', '.join(f"CASE WHEN {FIELD.format(n)} < {t} THEN '{n}' END" for n, t in D.GATE.items())}, CASE WHEN answer_id % 13 = 0 THEN 'blank_response' END) AS failures FROM ({PARSED}) x""")
def x12(v: Views) -> DataFrame:
    parsed = v.verdicts.select("answer_id", D.parse_verdict(F.col("raw")).alias("p"), F.when(F.col("answer_id") % 13 == 0, " ").otherwise("why?").alias("response"))
    return parsed.select("answer_id", F.array_join(D.gate_failures(F.col("p"), F.col("response")), ",").alias("failures"))


ANSWERS = """
    SELECT id, raw FROM (VALUES (-1, 'plain text'), (-2, '{"answer": " ", "bloom_level": "apply"}'), (-3, '{"answer": "a", "bloom_level": "fly"}'),
        (-4, '{"answer": " b ", "sources": [{"file_name": "f", "page_number": 2, "excerpt": "e", "confidence": 1.7}, {"file_name": "g", "page_number": 2, "excerpt": "e"}]}'), (-5, '{"answer": "c", "follow_up_questions": ["1", " ", "2", "3", "4"]}')) AS t(id, raw)
    UNION ALL SELECT event_id, concat('{"answer": "', event_type, '", "bloom_level": "', CASE WHEN event_id % 2 = 0 THEN 'apply' ELSE 'none' END, '", "follow_up_questions": ["a", "b"], "sources": []}') FROM events"""


@query("x11_answers", f"""
    WITH a AS (SELECT id, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM ({ANSWERS}) z), b AS (SELECT *, trim(coalesce(json_extract_string(j, '$.answer'), '')) AS ans FROM a)
    SELECT id, CASE WHEN ans <> '' THEN ans ELSE raw END AS answer, CASE WHEN ans <> '' AND json_extract_string(j, '$.bloom_level') IN ('remember', 'understand', 'apply', 'analyze', 'evaluate', 'create') THEN json_extract_string(j, '$.bloom_level') ELSE 'understand' END AS bloom_level,
           CASE WHEN ans <> '' THEN CAST(least(3, len(list_filter(coalesce(json_extract_string(j, '$.follow_up_questions[*]'), []), lambda q: trim(q) <> ''))) AS INT) ELSE 0 END AS n_follow_up,
           CASE WHEN ans <> '' THEN CAST(len(list_filter(coalesce(json_extract(j, '$.sources[*]'), []), lambda s: json_extract(s, '$.confidence') IS NOT NULL)) AS INT) ELSE 0 END AS n_sources FROM b""")
def x11(v: Views) -> DataFrame:
    parsed = v.sql(ANSWERS).select("id", D.parse_answer(F.col("raw")).alias("p"))
    return parsed.select(F.col("id").cast("long").alias("id"), "p.answer", "p.bloom_level", F.size("p.follow_up_questions").alias("n_follow_up"), F.size("p.sources").alias("n_sources"))


GUIDES = " ".join(f"WHEN {k} THEN '{t}'" for k, t in D.GUIDANCE.items())


@query("x16_profiles", f"""
    SELECT user_id, concat_ws(chr(10), concat('Student: ', email), 'Course: c', concat('Sessions completed: ', CAST(user_id % 9 AS VARCHAR)), concat('Level: ', role, ', Bloom ', CAST(user_id % 7 AS VARCHAR)), concat('Guidance: ', CASE user_id % 7 {GUIDES} ELSE '' END),
           concat('Mastered: ', CASE WHEN user_id % 3 = 0 THEN 'none identified yet' ELSE 'a, b' END), 'Needs work: none identified yet', CASE WHEN user_id % 2 = 0 THEN 'Respond in English.' ELSE 'Respond in FR.' END) AS profile FROM principals""")
def x16(v: Views) -> DataFrame:
    none = F.array().cast("array<string>")
    block = D.profile_block(
        F.col("email"), F.lit("c"), F.col("user_id") % 9, F.col("role"), (F.col("user_id") % 7).cast("int"), F.when(F.col("user_id") % 3 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"))), none, F.when(F.col("user_id") % 2 == 0, "en").otherwise("fr"))
    return v.principals.select("user_id", block.alias("profile"))


@query("x24_prompts", """
    WITH h AS (SELECT session_id, string_agg(concat(upper(role), ': ', content), chr(10) ORDER BY age) AS history FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, role) AS age FROM chat_messages) x WHERE age <= 6 GROUP BY session_id)
    SELECT session_id, concat('CONTEXT:', chr(10), 'nothing found in this course', CASE WHEN trim(history) <> '' THEN concat(chr(10), chr(10), 'HISTORY:', chr(10), history) ELSE '' END, chr(10), chr(10), 'QUESTION:', chr(10), 'why?') AS prompt FROM h""")
def x24(v: Views) -> DataFrame:
    none = F.lit(None).cast("string")
    return D.history(v.chat_messages).select("session_id", D.prompt(none, none, F.lit(""), F.col("history"), F.lit("why?")).alias("prompt"))


@query("x19_course_wiki", """
    WITH l AS (SELECT course_id, doc_id, page_number, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM corpus_pages),
    o AS (SELECT course_id, lower(line) AS norm, min(struct_pack(d := doc_id, p := page_number, i := i, line := line)) AS f FROM l WHERE line <> '' GROUP BY 1, 2),
    r AS (SELECT course_id, f.line AS line, f.d AS d, f.p AS p, f.i AS i, sum(length(f.line) + 1) OVER (PARTITION BY course_id ORDER BY f.d, f.p, f.i ROWS UNBOUNDED PRECEDING) - length(f.line) - 1 AS before FROM o)
    SELECT course_id, substring(string_agg(line, chr(10) ORDER BY d, p, i), 1, 150000) AS wiki, CAST(count(*) AS BIGINT) AS n_lines FROM r WHERE before < 150000 GROUP BY course_id""")
def x19(v: Views) -> DataFrame:
    return course_wiki(v.corpus_pages.select("course_id", "doc_id", "page_number", "text"))


def answered(v: Views) -> DataFrame:
    """(key, question, answer, contexts): first user turn, the assistant turn after it, keyword contexts in rank order."""
    answers = v.sql("SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant'").where("r = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer"))
    found = keyword(v).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "chunk_id"))).alias("ranked"))
    rows = questions(v).join(answers, "query_id").join(found, "query_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select(F.col("query_id").alias("key"), "question", "answer", F.lit(None).cast("string").alias("reference"), F.coalesce(F.transform("ranked", lambda x: x["content"]), empty).alias("contexts"), F.coalesce(F.transform("ranked", lambda x: x["chunk_id"].cast("string")), empty).alias("retrieved"))


@query("v11_rag_scores")
def v11(v: Views) -> DataFrame:
    scored = D.rag_scores(answered(v).drop("retrieved"))
    return scored.select("key", *[F.round(c, 6).alias(c) for c in scored.columns[1:]])


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query("v12_response_audit", f"""
    WITH {KEYWORD.strip()}, a AS (SELECT conv_id, text AS answer FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') x WHERE r = 1),
    x AS (SELECT query_id, list_distinct(flatten(list({TOKENS.format('content')}))) AS held FROM k GROUP BY query_id),
    t AS (SELECT q.query_id, a.answer, {TOKENS.format('q.question')} AS qt, {TOKENS.format('a.answer')} AS aw, coalesce(x.held, []) AS held FROM q JOIN a ON q.query_id = a.conv_id LEFT JOIN x ON q.query_id = x.query_id)
    SELECT query_id AS key, CASE WHEN len(aw) > 0 THEN round(len(list_intersect(aw, held)) / len(aw), 6) ELSE 0.0 END AS groundedness, CASE WHEN contains(answer, '?') THEN 1.0 ELSE 0.0 END AS socratic_compliance,
           CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, aw)) / len(qt), 6) ELSE 0.0 END AS topic_relevance FROM t""")
def v12(v: Views) -> DataFrame:
    audited = D.response_audit(answered(v).withColumn("cited", F.slice("retrieved", 1, 1)))
    return audited.select("key", F.round("groundedness", 6).alias("groundedness"), "socratic_compliance", F.round("topic_relevance", 6).alias("topic_relevance"))
