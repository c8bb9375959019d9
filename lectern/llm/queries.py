"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fertility, html_main, language, licenses, near_duplicates, packing, pivot_search, quality, suffix_tree_lm, toxicity, vertical_negatives, whitening
from .shared import table


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_matches"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_units", F.round("best_dice", 6).alias("best_dice"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", F.col("good").alias("kept"), "evidence", "host_rate", "path_rate")


def op8_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.judge(table(spark, sf_dir, "documents"), group_col="lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "fallback_share", "entropy_ratio", F.array_join("reasons", ",").alias("reasons"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "x"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error")


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vertical_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_grammar": op1_toxicity_grammar,
        "op2_weighted_minhash": op2_weighted_minhash,
        "op3_language_cnn": op3_language_cnn,
        "op4_license_scan": op4_license_scan,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_suffix_tree_lm": op6_suffix_tree_lm,
        "op7_quality_bayes": op7_quality_bayes,
        "op8_html_consensus": op8_html_consensus,
        "op9_decontaminate": op9_decontaminate,
        "op10_tokeniser_fertility": op10_tokeniser_fertility,
        "op11_whiten": op11_whiten,
        "op12_pivot_search": op12_pivot_search,
        "op13_hard_negatives": op13_hard_negatives,
    }


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, l, i, array_to_string(ws[i + 1 : i + l], ' ') AS win
       FROM (SELECT rid, ws, l, unnest(range(0, greatest(len(ws) - l + 1, 0))) AS i FROM d, (SELECT DISTINCT l FROM bw))),
h AS (SELECT rid, dw.l, i, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""


def _op4_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, grams in licenses.patterns(licenses.TEMPLATES))
    paragraph, sentence = licenses.PARAGRAPH_END, licenses.SENTENCE_END
    low, high = licenses.THRESHOLD / (2 - licenses.THRESHOLD), (2 - licenses.THRESHOLD) / licenses.THRESHOLD
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(name, g)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT rid, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
      UNION ALL SELECT rid, 'sentence', unnest(regexp_split_to_array(text, '{sentence}')), generate_subscripts(regexp_split_to_array(text, '{sentence}'), 1) FROM d
      UNION ALL SELECT rid, 'paragraph', p, i FROM (SELECT rid, unnest(regexp_split_to_array(text, '{paragraph}')) AS p, generate_subscripts(regexp_split_to_array(text, '{paragraph}'), 1) AS i FROM d) WHERE contains(trim(p), chr(10))
      UNION ALL SELECT rid, 'text', text, 1 FROM d WHERE regexp_matches(text, '{paragraph}')),
g AS (SELECT rid, kind, i, list_distinct([ws[k] || ' ' || ws[k + 1] for k in range(1, len(ws))]) AS g
      FROM (SELECT rid, kind, i, list_filter(regexp_split_to_array(lower(unit), '{licenses.NOT_WORD}'), lambda w: w <> '') AS ws FROM u)),
s AS (SELECT rid, kind, i, name, 2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) > 0 AND len(g.g) >= len(t.g) * {low} - 1e-6 AND len(g.g) <= len(t.g) * {high} + 1e-6),
b AS (SELECT *, max(dice) OVER (PARTITION BY rid, kind, i) AS top FROM s WHERE dice >= {licenses.THRESHOLD}),
m AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT kind || '/' || i) AS n_units, max(dice) AS best FROM b WHERE dice = top GROUP BY rid)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, round(best, 6) AS best_dice FROM d LEFT JOIN m USING (rid)
"""


_WHOLE = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL"

OP12_SQL = f"""
WITH v AS (SELECT vec_id, {_WHOLE} AS x FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 5
"""

OP13_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS x FROM embeddings WHERE {_USABLE} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) t WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_decontaminate": OP9_SQL, "op4_license_scan": _op4_sql(), "op12_pivot_search": OP12_SQL, "op13_hard_negatives": OP13_SQL}
