"""Stand-in views over the test tables: SQL that runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "corpus_pages": """
        SELECT doc_id, source AS course_id, concat('doc_', CAST(doc_id AS STRING), '.pdf') AS filename, CAST(1 AS INT) AS page_number, text, lang,
               (doc_id % 7 = 0) AS is_ocr, CASE WHEN doc_id % 7 = 0 THEN substring(text, 1, 20) ELSE text END AS native_text, text AS ocr_text
        FROM documents""",
    "materials": """
        SELECT doc_id AS material_id, source AS course_id, concat('doc_', CAST(doc_id AS STRING), '.pdf') AS file_name,
               CASE doc_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'ready' END AS status, n_chars AS file_size
        FROM documents""",
    "chat_sessions": """
        SELECT conv_id AS session_id, conv_id % 40 AS user_id, concat('src', CAST(conv_id % 20 AS STRING)) AS course_id,
               concat(CASE WHEN conv_id % 2 = 0 THEN 'Topic ' ELSE 'topic ' END, CAST(conv_id % 12 AS STRING)) AS title,
               CAST((conv_id * 37) % 100 AS DOUBLE) / 100 AS confidence_score
        FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "chat_messages": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')",
    "interactions": """
        SELECT event_id AS id, user_id AS session_id, event_type AS course_id, ts,
               CASE event_id % 6 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'apply' WHEN 3 THEN 'analyze' WHEN 4 THEN 'evaluate' ELSE 'create' END AS bloom_level,
               CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '{"faithfulness": null}'
                    ELSE concat('{"context_precision": ', CAST(CAST(event_id % 11 AS DOUBLE) / 10 AS STRING), ', "context_recall": ', CAST(CAST(event_id % 13 AS DOUBLE) / 16 AS STRING),
                                ', "faithfulness": ', CAST(CAST(event_id % 101 AS DOUBLE) / 100 AS STRING), ', "answer_relevancy": ', CAST(CAST(event_id % 9 AS DOUBLE) / 8 AS STRING), '}') END AS ragas_json
        FROM events""",
    "verdicts": """
        SELECT event_id AS answer_id, CASE WHEN event_id % 10 = 0 THEN 'not json'
               ELSE concat('{"passed": true, "score": 0.9, "groundedness": ', CAST(CAST(event_id % 11 AS DOUBLE) / 10 AS STRING), ', "socratic_compliance": ', CAST(CAST(event_id % 7 AS DOUBLE) / 8 AS STRING),
                           ', "topic_relevance": ', CAST(CAST(event_id % 5 AS DOUBLE) / 4 AS STRING), '}') END AS raw
        FROM events""",
    "hierarchy": """
        SELECT s.s_suppkey AS department_id, s.s_name AS department_name, n.n_nationkey AS faculty_id, n.n_name AS faculty_name, r.r_regionkey AS university_id, r.r_name AS university_name
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "departments": "SELECT s_suppkey AS department_id, s_name AS department_name, s_nationkey AS faculty_id FROM supplier",
    "faculties": "SELECT n_nationkey AS faculty_id, n_name AS faculty_name, n_regionkey AS university_id FROM nation",
    "universities": "SELECT r_regionkey AS university_id, r_name AS university_name FROM region",
    "courses": """
        SELECT p.p_partkey AS course_id, p.p_name AS title, p.p_brand AS code, p.p_type AS description, CAST(p.p_size AS STRING) AS level, d.department_id, p.p_partkey % 50 * 10 + 1 AS lecturer_id
        FROM part p LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS department_id FROM lineitem GROUP BY l_partkey) d ON p.p_partkey = d.l_partkey""",
    "principals": """
        SELECT c_custkey AS user_id, lower(concat(replace(c_name, '#', '.'), '@u', CAST(c_nationkey AS STRING), '.edu')) AS email,
               CASE c_custkey % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'lecturer' ELSE 'student' END AS role, c_nationkey AS faculty_id,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS display_name,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS own_faculty_id
        FROM customer""",
    "enrollments": "SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey AS course_id FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "notifications": "SELECT event_id AS id, user_id, event_type AS notification_type, (event_id % 4 <> 0) AS is_read, ts AS created_at, props AS data FROM events",
    "codes": "SELECT event_id AS code_id, user_id, ts AS created_at, (event_id % 3 = 0) AS used FROM events",
    "cache_events": "SELECT event_id, user_id AS cache_key, ts, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'request' END AS kind FROM events WHERE event_type IN ('signup', 'view')",
    "vectors": "SELECT concat('v::', CAST(vec_id AS STRING)) AS chunk_id, vec_id, concat('ns', CAST(label % 4 AS STRING)) AS namespace, CAST(vec_id % 3 AS INT) AS raptor_level, embedding FROM embeddings",
}


def used_views(sql: str) -> list[str]:
    """The stand-in views that a statement names, in the order of their definition."""
    return [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def with_views(sql: str) -> str:
    """The statement with the views it names as leading common table expressions."""
    sql = sql.strip()
    heads = [f"{name} AS ({VIEWS[name].strip()})" for name in used_views(sql)]
    if not heads:
        return sql
    return f"WITH {', '.join(heads)}" + (", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql)


#: Rows of lineitem that one task joins and tells apart: memory of a task does not grow with the tables.
ROWS_A_TASK = 1_000_000


class Views:
    """Tables and stand-in views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    @property
    def parts(self) -> int:
        """Tasks that enrollments are dealt to, by the rows that lineitem's files name."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // ROWS_A_TASK))

    @property
    def enrollments(self) -> DataFrame:
        """The view of this name, dealt over so many tasks as its rows ask for."""
        n = self.parts
        orders = self.orders.select(F.col("o_orderkey"), F.col("o_custkey").alias("user_id")).repartition(n, "o_orderkey")
        lines = self.lineitem.select(F.col("l_orderkey"), F.col("l_partkey").alias("course_id")).repartition(n, "l_orderkey")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", "course_id").repartition(n, "user_id", "course_id").distinct()

    def sql(self, statement: str) -> DataFrame:
        """Runs a statement over the tables and views."""
        statement = with_views(statement)
        for table in TABLES:
            statement, n = re.subn(rf"\b(FROM|JOIN)(\s+){table}\b", rf"\1\2lectern_{table}", statement)
            if n:
                getattr(self, table).createOrReplaceTempView(f"lectern_{table}")
        return self.spark.sql(statement)
