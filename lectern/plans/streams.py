"""Streams over the tables' files, run to their end; final states equal the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..registry import query
from ..storage import stored
from ..streaming import ingest as I
from ..streaming import streams as T
from .analytics import STRUGGLE
from .dialogue import answered


def stream(v: Views, table: str) -> DataFrame:
    return T.table_stream(v.spark, f"{v.sf_dir}/{table}.parquet")


@query("t1_incremental_struggle", STRUGGLE + " GROUP BY 1, 2")
def t1(v: Views) -> DataFrame:
    messages = stream(v, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"))
    return T.incremental_struggle(messages, v.chat_sessions)


FEED = "SELECT material_id, course_id, 'material_ready' AS type, 'Material ready' AS title, concat(file_name, ' is ready to study.') AS body, concat('{\"material_id\":\"', CAST(material_id AS VARCHAR), '\",\"course_id\":\"', course_id, '\"}') AS data FROM materials WHERE status = 'ready'"


def _materials(docs: DataFrame) -> DataFrame:
    status = F.when(F.col("doc_id") % 5 == 0, "processing").when(F.col("doc_id") % 5 == 1, "failed").otherwise("ready")
    return docs.select(F.col("doc_id").alias("material_id"), F.col("source").alias("course_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), status.alias("status"))


@query("t2_notification_feed", FEED)
def t2(v: Views) -> DataFrame:
    return T.notification_feed(_materials(stream(v, "documents")))


@query("x20_notifications", FEED)
def x20(v: Views) -> DataFrame:
    return T.notifications_of(v.materials)


@query("t3_unread_counts", "SELECT user_id, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unread FROM events GROUP BY user_id")
def t3(v: Views) -> DataFrame:
    """Every notification counts one when it comes; those that were read count one back."""
    came = stream(v, "events").select("user_id", F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))).alias("delta"))
    return T.unread_counts(came)


@query("t3_unread_with_mark_all", """
    WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS delta, event_id % 40 = 0 AS reset FROM events),
    r AS (SELECT user_id, max(s) AS last FROM e WHERE reset GROUP BY user_id)
    SELECT e.user_id, CAST(sum(CASE WHEN e.reset OR e.s <= r.last THEN 0 ELSE delta END) AS BIGINT) AS n_unread FROM e LEFT JOIN r ON e.user_id = r.user_id GROUP BY e.user_id""")
def t3_reset(v: Views) -> DataFrame:
    """One event in forty marks all as read; errors stand for single ones that were read."""
    e = stream(v, "events")
    return T.unread_counts(e.select("user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), (F.col("event_id") % 40 == 0).alias("reset")))


@query("t2_lecturer_feed", """
    SELECT CAST(doc_id % 50 AS VARCHAR) AS user_id, 'material_ready' AS type, 'Material ready' AS title, concat('doc_', CAST(doc_id AS VARCHAR), '.pdf is ready to study.') AS body,
           concat('{"material_id":"', CAST(doc_id AS VARCHAR), '","course_id":"', source, '"}') AS data FROM documents WHERE doc_id % 5 > 1
    UNION ALL SELECT CAST(user_id % 50 AS VARCHAR), 'new_enrollment', 'New Enrollment', concat('u', CAST(user_id AS VARCHAR), '@u.edu has enrolled in Course ', CAST(event_id % 30 AS VARCHAR), '.'),
           concat('{"course_id":"', CAST(event_id % 30 AS VARCHAR), '","student_id":"', CAST(user_id AS VARCHAR), '"}') FROM events WHERE event_type = 'signup'""")
def t2_lecturer(v: Views) -> DataFrame:
    """Materials that became ready and signups that stand for enrolments; each event comes twice and counts once."""
    twice = lambda rows: rows.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    materials = _materials(stream(v, "documents")).withColumns({"event_id": F.concat(F.lit("m"), "material_id"), "lecturer_id": F.col("material_id") % 50})
    e = stream(v, "events").where("event_type = 'signup'")
    course = (F.col("event_id") % 30).cast("string")
    enrolments = e.select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.col("user_id").alias("student_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@u.edu")).alias("email"), course.alias("course_id"), F.concat(F.lit("Course "), course).alias("course_title"), (F.col("user_id") % 50).alias("lecturer_id"))
    return T.lecturer_feed(twice(materials), twice(enrolments))


@query("t4_material_status", f"""
    SELECT doc_id AS material_id, CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'failed' ELSE 'ready' END AS status,
           CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN {I.RETRIES + 1} ELSE 1 END AS attempts,
           CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE 1 + length(text) - length(replace(text, chr(12), '')) END AS page_count
    FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents) d""")
def t4_status(v: Views) -> DataFrame:
    """Documents as materials, of which one in nine holds nothing and fails for good."""
    held = stream(v, "documents").select(F.col("doc_id").alias("material_id"), F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text")).alias("content"))
    return I.ingest(held).materials().select("material_id", "status", "attempts", "page_count")


@query("t5_score_answers")
def t5_answers(v: Views) -> DataFrame:
    """The answers of conversations as a stream in which each comes twice, scored once."""
    rows = stored(answered(v).drop("retrieved"), "answers")
    stream_of = v.spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    scored = T.score_answers(stream_of.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again"))
    return scored.select("key", *[F.round(c, 6).alias(c) for c in scored.columns if c != "key"])


@query("t6_registry_evictions", """
    WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
    g AS (SELECT event_id, user_id AS cache_key, s, concat('n', CAST(user_id AS VARCHAR), '.', CAST(event_id % 2 AS VARCHAR)) AS name FROM e WHERE event_type = 'signup'),
    x AS (SELECT event_id, s, concat('n', CAST(user_id AS VARCHAR), '.', CAST(event_id % 2 AS VARCHAR)) AS name FROM e WHERE event_type = 'error'),
    q AS (SELECT event_id, user_id AS cache_key, s FROM e WHERE event_type = 'view'),
    l AS (SELECT q.event_id, q.cache_key, q.s, max(g.s * 1000000000 + g.event_id) AS at FROM q LEFT JOIN g ON g.cache_key = q.cache_key AND (g.s < q.s OR (g.s = q.s AND g.event_id < q.event_id)) GROUP BY 1, 2, 3),
    h AS (SELECT l.*, g.s AS reg_s, g.event_id AS reg_id, g.name FROM l LEFT JOIN g ON g.cache_key = l.cache_key AND g.s * 1000000000 + g.event_id = l.at)
    SELECT event_id, cache_key, CASE WHEN reg_s IS NULL THEN 'miss'
           WHEN EXISTS (SELECT 1 FROM x WHERE x.name = h.name AND (x.s > h.reg_s OR (x.s = h.reg_s AND x.event_id > h.reg_id)) AND (x.s < h.s OR (x.s = h.s AND x.event_id < h.event_id))) THEN 'miss'
           WHEN s < reg_s + 86400 - 300 THEN 'hit' ELSE 'expired' END AS outcome FROM h""")
def t6_evictions(v: Views) -> DataFrame:
    """Signups register under a name, errors evict by name, views ask."""
    e = stream(v, "events").where("event_type in ('signup', 'view', 'error')")
    kind = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "evict").otherwise("request")
    name = F.when(F.col("event_type") != "view", F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 2).cast("string")))
    return T.ttl_registry(e.select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("cache_key"), "ts", kind.alias("kind"), name.alias("name")))


@query("t4_streaming_ingest", "SELECT doc_id, course_id, CAST(s / 700 AS INT) AS chunk_index, substring(text, s + 1, 800) AS content FROM (SELECT doc_id, course_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 700)) AS s FROM corpus_pages WHERE length(text) > 0) x")
def t4(v: Views) -> DataFrame:
    return T.streaming_ingest(stream(v, "documents").select("doc_id", F.col("source").alias("course_id"), "text"))


@query("t5_score_and_log", "SELECT id, course_id, round(TRY_CAST(json_extract_string(ragas_json, '$.faithfulness') AS DOUBLE), 4) AS faithfulness FROM interactions")
def t5(v: Views) -> DataFrame:
    e = stream(v, "events")
    scored = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, '{"faithfulness": null}').otherwise(F.concat(F.lit('{"faithfulness": '), ((F.col("event_id") % 101).cast("double") / 100).cast("string"), F.lit("}")))
    return T.score_and_log(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("course_id"), scored.alias("ragas_json")))


@query("t6_ttl_registry", """
    WITH e AS (SELECT event_id, cache_key, kind, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM cache_events),
    r AS (SELECT *, max(CASE WHEN kind = 'register' THEN s END) OVER (PARTITION BY cache_key ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS reg FROM e)
    SELECT event_id, cache_key, CASE WHEN reg IS NULL THEN 'miss' WHEN s < reg + 86400 - 300 THEN 'hit' ELSE 'expired' END AS outcome FROM r WHERE kind = 'request'""")
def t6(v: Views) -> DataFrame:
    e = stream(v, "events").where("event_type in ('signup', 'view')")
    return T.ttl_registry(e.select("event_id", F.col("user_id").alias("cache_key"), "ts", F.when(F.col("event_type") == "signup", "register").otherwise("request").alias("kind")))
