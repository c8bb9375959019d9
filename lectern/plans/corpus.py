"""Corpus preparation over the page stand-ins and small synthetic layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Views
from ..functions import chunking as C
from ..registry import query
from ..sources import corpus as S
from ..storage import shared_folder

WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@query("s1_table_scan", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def s1(v: Views) -> DataFrame:
    return v.documents.where("lang = 'fr'").select("doc_id", "lang", "source")


@query("s2_page_counts", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, CAST({WORDS.format('text')} AS BIGINT) AS word_count FROM corpus_pages")
def s2(v: Views) -> DataFrame:
    return S.page_counts(v.corpus_pages).select("doc_id", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"))


@query("s3_page_text", """
    WITH p AS (SELECT doc_id, length(native_text) < 50 AND length(ocr_text) > length(native_text) AS use_ocr, native_text, ocr_text FROM corpus_pages)
    SELECT doc_id, use_ocr AS is_ocr, CAST(length(CASE WHEN use_ocr THEN ocr_text ELSE native_text END) AS BIGINT) AS n FROM p WHERE length(CASE WHEN use_ocr THEN ocr_text ELSE native_text END) >= 10""")
def s3(v: Views) -> DataFrame:
    return S.select_page_text(v.corpus_pages.drop("text")).select("doc_id", "is_ocr", F.length("text").cast("long").alias("n"))


NEW_VECTORS = "SELECT chunk_id, namespace, 2 AS version, 'new' AS payload FROM vectors WHERE vec_id % 3 = 0 UNION ALL SELECT concat('w::', CAST(vec_id AS STRING)), namespace, 1, 'added' FROM vectors WHERE vec_id % 5 = 0 UNION ALL SELECT chunk_id, namespace, 0, 'stale' FROM vectors WHERE vec_id % 7 = 0"


@query("s4_vector_upsert", f"""
    WITH u AS (SELECT chunk_id, namespace, 1 AS version, 'old' AS payload, 0 AS is_new FROM vectors UNION ALL SELECT n.*, 1 FROM ({NEW_VECTORS}) n)
    SELECT namespace, chunk_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY namespace, chunk_id ORDER BY version DESC, is_new DESC) AS r FROM u) x WHERE r = 1""")
def s4(v: Views) -> DataFrame:
    old = v.vectors.select("chunk_id", "namespace", F.lit(1).alias("version"), F.lit("old").alias("payload"))
    return S.upsert(old, v.sql(NEW_VECTORS), ["namespace", "chunk_id"], "version").select("namespace", "chunk_id", "payload")


@query("s4_bucketed_upsert", f"""
    WITH u AS (SELECT chunk_id, namespace, 1 AS version, 'old' AS payload FROM vectors UNION ALL SELECT n.chunk_id, n.namespace, 2, n.payload FROM ({NEW_VECTORS}) n WHERE n.version > 0)
    SELECT namespace, chunk_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY namespace, chunk_id ORDER BY version DESC, payload DESC) AS r FROM u) x WHERE r = 1""")
def s4_buckets(v: Views) -> DataFrame:
    """The upsert as a change to a table of buckets; the second write of the new rows is a replay."""
    folder, keys, fields = shared_folder(v.spark, "vectors"), ["namespace", "chunk_id"], "namespace string, chunk_id string, payload string"
    S.upsert_store(v.spark, folder, keys, fields, v.vectors.withColumn("payload", F.lit("old")), 1)
    for _ in range(2):
        store = S.upsert_store(v.spark, folder, keys, fields, v.sql(NEW_VECTORS).where("version > 0"), 2)
    return store.read()


@query("s5_replace_material", """
    SELECT material_id, course_id, CAST(length(file_name) AS BIGINT) AS n FROM materials WHERE material_id % 4 <> 0
    UNION ALL SELECT material_id, course_id, CAST(2000 AS BIGINT) AS n FROM materials WHERE material_id % 4 = 0""")
def s5(v: Views) -> DataFrame:
    old = v.materials.select("material_id", "course_id", F.length("file_name").cast("long").alias("n"))
    fresh = v.materials.where("material_id % 4 = 0").select("material_id", "course_id", F.length(F.substring(F.rpad(F.lit("x"), 2500, "x"), 1, 2000)).cast("long").alias("n"))
    return S.replace_scope(old, fresh, ["material_id"])


@query("s6_interaction_rows", """
    SELECT id, course_id, CASE WHEN ragas_json IS NULL THEN NULL ELSE json_extract_string(ragas_json, '$.faithfulness') IS NOT NULL END AS has_faithfulness, ragas_json IS NOT NULL AND coalesce(json_extract_string(ragas_json, '$.faithfulness'), json_extract_string(ragas_json, '$.context_precision')) IS NOT NULL AS scored FROM interactions""")
def s6(v: Views) -> DataFrame:
    flat = v.interactions.select("id", "course_id", F.col("ragas_json").isNotNull().alias("was"), *[F.get_json_object("ragas_json", f"$.{s}").cast("double").alias(s) for s in ("faithfulness", "context_precision")])
    rows = S.interaction_rows(flat, ["faithfulness", "context_precision"])
    return rows.select("id", "course_id", F.when(F.col("was"), F.get_json_object("ragas_json", "$.faithfulness").isNotNull()).alias("has_faithfulness"), F.col("ragas_json").isNotNull().alias("scored"))


@query("s7_latest_document", "SELECT course_id, material_id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY material_id DESC) AS r FROM materials) x WHERE r = 1")
def s7(v: Views) -> DataFrame:
    return S.latest_document(v.materials.select("course_id", "material_id", "file_name"), "course_id", "material_id")


BATCHED = "SELECT namespace, CAST(floor((row_number() OVER (PARTITION BY namespace ORDER BY vec_id) - 1) / 100) AS BIGINT) AS batch, vec_id % 83 <> 1 AS ok FROM vectors"


@query("s8_batch_outcomes", f"""
    WITH b AS (SELECT namespace, batch, count(*) AS n, min(CAST(ok AS INT)) AS good FROM ({BATCHED}) x GROUP BY 1, 2)
    SELECT namespace, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN good = 1 THEN n ELSE 0 END) AS BIGINT) AS upserted, CAST(sum(1 - good) AS BIGINT) AS failed_batches FROM b GROUP BY namespace""")
def s8(v: Views) -> DataFrame:
    rows = S.batches(v.vectors.select("namespace", "vec_id", (F.col("vec_id") % 83 != 1).alias("ok")), "namespace", "vec_id")
    return S.batch_outcomes(rows, "namespace", "ok")


@query("s9_ingest_status", f"""
    WITH b AS (SELECT namespace, batch, count(*) AS n, min(CAST(ok AS INT)) AS good FROM ({BATCHED}) x GROUP BY 1, 2)
    SELECT namespace, CASE WHEN sum(1 - good) = 0 THEN 'completed' WHEN sum(CASE WHEN good = 1 THEN n ELSE 0 END) > 0 THEN 'partial' ELSE 'failed' END AS status FROM b GROUP BY namespace""")
def s9(v: Views) -> DataFrame:
    done = s8(v)
    return done.select("namespace", S.ingest_status(F.col("total"), F.col("upserted"), F.col("failed_batches")).alias("status"))


@query("s10_namespace", "SELECT course_id, replace(lower(title), ' ', '-') AS namespace FROM courses")
def s10(v: Views) -> DataFrame:
    return v.courses.select("course_id", S.namespace(F.col("title")).alias("namespace"))


@query("s11_level_scan", "SELECT chunk_id, namespace FROM vectors WHERE raptor_level = 1 AND namespace = 'ns2'")
def s11(v: Views) -> DataFrame:
    return v.vectors.where("namespace = 'ns2' and raptor_level = 1").select("chunk_id", "namespace")


FILES = "SELECT path, length FROM (VALUES ('a/b.pdf', 10), ('c.DOCX', 104857600), ('d.pptx', 104857601), ('e.txt', 5), ('noext', 7)) AS t(path, length) UNION ALL SELECT concat(file_name, CASE WHEN material_id % 3 = 0 THEN '.txt' ELSE '' END), file_size FROM materials"


@query("s12_file_intake", f"""
    WITH f AS (SELECT path, length, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM ({FILES}) x)
    SELECT path, CASE WHEN ext = '' THEN 'pdf' ELSE ext END AS file_type FROM f WHERE (ext = '' OR ext IN ('pdf', 'docx', 'pptx')) AND length <= 104857600""")
def s12(v: Views) -> DataFrame:
    return S.files_in(v.sql(FILES)).select("path", "file_type")


@query("s13_mark_read", "SELECT CAST(sum(CASE WHEN user_id = 3 AND NOT is_read THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM notifications")
def s13(v: Views) -> DataFrame:
    return S.mark_read(v.notifications, 3)[1]


@query("w7_latest_wins", "SELECT user_id, code_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, code_id DESC) AS r FROM codes) x WHERE r = 1")
def w7(v: Views) -> DataFrame:
    return S.latest_document(v.codes.select("user_id", F.struct("created_at", "code_id").alias("version"), "code_id"), "user_id", "version").select("user_id", "code_id")


@query("o3_replace_set", "SELECT course_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT course_id FROM materials WHERE course_id <> 'src1' UNION ALL SELECT course_id FROM materials WHERE course_id = 'src1' AND material_id % 2 = 0) x GROUP BY course_id")
def o3(v: Views) -> DataFrame:
    rows = v.materials.select("course_id", "material_id")
    return S.replace_scope(rows, rows.where("course_id = 'src1' and material_id % 2 = 0"), ["course_id"], rows.where("course_id = 'src1'")).groupBy("course_id").agg(F.count("*").alias("n"))


@query("o4_referential_cleanup", """
    SELECT e.user_id, e.course_id, CASE WHEN c.department_id % 3 = 0 THEN NULL ELSE c.department_id END AS department_id
    FROM enrollments e JOIN courses c ON e.course_id = c.course_id WHERE e.user_id % 4 <> 0""")
def o4(v: Views) -> DataFrame:
    left = S.cascade(v.enrollments, "user_id", v.principals.where("user_id % 4 = 0"))
    courses = S.set_null(v.courses.select("course_id", "department_id"), "department_id", v.departments.where("department_id % 3 = 0"))
    return left.join(courses, "course_id").select("user_id", "course_id", "department_id")


@query("x1_recursive_chunks")
def x1(v: Views) -> DataFrame:
    return C.recursive_chunks(v.corpus_pages, ["filename", "page_number"])


SLIDES = "SELECT doc_id, filename, unnest(range(0, CAST(length(text) AS BIGINT), 700)) AS s, text FROM corpus_pages WHERE length(text) > 0"


@query("x2_sliding_chunks", f"SELECT doc_id, CAST(s / 700 AS INT) AS chunk_index, substring(text, s + 1, 800) AS content FROM ({SLIDES}) x")
def x2(v: Views) -> DataFrame:
    return C.sliding_chunks(v.corpus_pages.select("doc_id", "text")).select("doc_id", "chunk_index", "content")


@query("x3_chunk_ids", f"SELECT concat_ws('::', filename, '1', CAST(CAST(s / 700 AS INT) AS VARCHAR)) AS chunk_id FROM ({SLIDES}) x")
def x3(v: Views) -> DataFrame:
    chunks = C.sliding_chunks(v.corpus_pages.select("filename", "page_number", "text"))
    return chunks.select(C.chunk_id(F.col("filename"), F.col("page_number"), F.col("chunk_index")).alias("chunk_id"))


@query("x4_excerpts", f"SELECT doc_id, substring(text, 1, 500) AS excerpt, CAST({WORDS.format('text')} AS INT) AS word_count FROM corpus_pages")
def x4(v: Views) -> DataFrame:
    return v.corpus_pages.select("doc_id", C.excerpt(F.col("text")).alias("excerpt"), S.word_count(F.col("text")).alias("word_count"))


@query("w4_chunk_index", "SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM corpus_pages WHERE text IS NOT NULL) x WHERE trim(line) <> ''")
def w4(v: Views) -> DataFrame:
    """Lines as splits: blank ones go and leave gaps."""
    return v.corpus_pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).where("trim(line) <> ''").select("doc_id", "chunk_index")


@query("o1_chunk_kinds", "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(width_px) AS BIGINT) AS n_images FROM (SELECT 'text' AS kind, NULL AS width_px FROM corpus_pages UNION ALL SELECT 'multimodal', 64 FROM corpus_pages WHERE doc_id % 9 = 0) x GROUP BY kind")
def o1(v: Views) -> DataFrame:
    text = v.corpus_pages.select(F.lit("text").alias("kind"), "doc_id")
    images = v.corpus_pages.where("doc_id % 9 = 0").select(F.lit("multimodal").alias("kind"), "doc_id", F.lit(64).alias("width_px"))
    return text.unionByName(images, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("width_px").alias("n_images"))


@query("o2_overlap_drop")
def o2(v: Views) -> DataFrame:
    groups = v.corpus_pages.select((F.col("doc_id") / 10).cast("int").alias("group_id"), F.col("doc_id").alias("ord"), "text")
    return C.drop_overlapping(groups, "group_id", "ord", "text")


def layout_blocks(v: Views) -> DataFrame:
    """A layout derived from the documents: each sliding chunk of the whole text is a block, one under the other."""
    cut = C.sliding_chunks(v.corpus_pages.select("doc_id", F.col("filename").alias("file"), F.col("page_number").alias("page"), "text"))
    top = F.col("chunk_index") * 30.0 - F.col("doc_id") % 90
    return cut.select("file", "page", F.col("content").alias("text"), top.alias("y0"), (top + 28.0).alias("y1"))


IMAGES = """
    SELECT filename AS file, page_number AS page, CAST(doc_id AS INT) AS xref, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' ELSE '' END AS ext, CAST(40 + doc_id % 30 AS INT) AS width_px, CAST(60 AS INT) AS height_px,
           n_chars * 3000 AS length, 100.0D AS y0, 200.0D AS y1, unhex(CASE WHEN doc_id % 4 = 2 THEN '89504E47' WHEN doc_id % 8 = 3 THEN 'FFD8FF00' ELSE '00' END) AS content
    FROM (SELECT p.*, length(p.text) AS n_chars FROM corpus_pages p) q"""


@query("j8_image_context")
def j8(v: Views) -> DataFrame:
    return C.image_context(v.sql(IMAGES).select("file", "page", "xref", "y0", "y1"), layout_blocks(v))


@query("j10_page_images", "SELECT filename AS file, CAST(doc_id AS INT) AS xref FROM corpus_pages WHERE length(text) >= 10")
def j10(v: Views) -> DataFrame:
    pages = S.select_page_text(v.corpus_pages).select(F.col("filename").alias("file"), F.col("page_number").alias("page"))
    return S.images_of_pages(v.sql(IMAGES), pages).select("file", "xref")


@query("x21_image_screen", """
    SELECT CAST(doc_id AS INT) AS xref, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 2 THEN 'png' WHEN doc_id % 4 = 1 OR doc_id % 8 = 3 THEN 'jpeg' END AS format, length(text) * 3000 > 10485760 AS oversized
    FROM corpus_pages WHERE 40 + doc_id % 30 >= 50""")
def x21(v: Views) -> DataFrame:
    return S.screen_images(v.sql(IMAGES)).select("xref", "format", "oversized")


@query("x22_multimodal_chunks")
def x22(v: Views) -> DataFrame:
    kept = S.screen_images(v.sql(IMAGES))
    context = C.image_context(kept.select("file", "page", "xref", "y0", "y1"), layout_blocks(v))
    return C.multimodal_chunks(kept.join(context, ["file", "page", "xref"]))
