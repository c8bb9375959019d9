"""Retrieval: vector and keyword top-k per query, reranking, context packing, citations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chunking import tokens
from ..storage import shared_folder, stored
from .hooks import hooked
from .shards import beside, dealt, give_back, sharded
from .vector_hits import best_products, nearest_sketches
from .word_hits import best_rows

TOP_VECTORS, TOP_RERANKED, TOP_KEYWORD = 100, 10, 5
MAX_CONTEXT = 20_000
SNIPPET, EXCERPT = 240, 300


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays, in double; null when one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit(vector: Column) -> Column:
    """The vector at length 1, in double; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def vector_scores(queries: DataFrame, vectors: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of each query with each vector of its namespace.

    The stated query set is joined on the namespace; Spark broadcasts it while it is small, else both are shuffled.
    Vectors are normalised once before the join, so a pair costs one dot product.
    """
    v = vectors.where(F.col("raptor_level").isin(*levels)) if levels else vectors
    v = v.select("namespace", "chunk_id", unit(F.col("embedding")).alias("v"))
    q = queries.select("namespace", "query_id", unit(F.col("embedding")).alias("q"))
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    return v.join(q, "namespace").select("query_id", "chunk_id", dot.alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """The k best rows of each query with their 1-based rank; the rank limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Vectors of a namespace that are scored at once, and queries that they meet at once.
VECTOR_SHARD, QUERY_SHARD = 10_000, 10_000


def _met(queries: DataFrame, vectors: DataFrame, vector_rows: int, query_rows: int) -> tuple:
    """Groups of queries and of vectors for a cogroup: shards of a namespace's vectors, by hash, each meet all blocks of its queries. Columns are in row, and shards there says how many a namespace has."""
    key = ["namespace", "shard", "block"]
    blocks = queries.groupBy("namespace").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    sizes = vectors.groupBy("namespace").agg(F.ceil(F.count("*") / vector_rows).cast("int").alias("shards"))
    parts = stored(sizes.join(blocks, "namespace"), "vector-shards")
    v = vectors.join(F.broadcast(parts), "namespace").withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int"))
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    q = queries.join(F.broadcast(parts), "namespace").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("blocks")
    q, v = (x.select(F.struct(*[c for c in x.columns if c not in key]).alias("row"), *[F.col(c).alias(f"{side}_{c}") for c in key]) for side, x in (("q", q), ("v", v)))  # own names: both sides may come of one table
    return tuple(dealt(x, *on).groupBy(*on) for x, on in ((q, [f"q_{c}" for c in key]), (v, [f"v_{c}" for c in key])))


def _rows(table: pa.Table) -> pa.Table:
    return pa.Table.from_struct_array(table["row"])


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9, vector_rows: int = VECTOR_SHARD, query_rows: int = QUERY_SHARD) -> DataFrame:
    """(query_id, chunk_id, score, rank): of all vectors of a query's namespace the k of the largest rounded cosine, ties by chunk_id.

    A shard of vectors gives only its k best rows of each query; what is shuffled is the vectors once for each block of
    queries, the queries once a shard, and those rows.
    """
    q = queries.where("namespace is not null").select("namespace", "query_id", unit(F.col("embedding")).alias("q"))
    v = vectors.where("namespace is not null").select("namespace", "chunk_id", unit(F.col("embedding")).alias("v"))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = _rows(asked), _rows(held).sort_by("chunk_id")
        of, at, product = best_products(asked["q"], held["v"], k, digits)
        return pa.table({"query_id": asked["query_id"].take(pa.array(of)), "chunk_id": held["chunk_id"].take(pa.array(at)), "score": product})

    types = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()]
    asked, held = _met(q, v, vector_rows, query_rows)
    return top_k(asked.cogroup(held).applyInArrow(score, f"query_id {types[0]}, chunk_id {types[1]}, score double"), k)


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has."""
    q = tokens(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def rerank(candidates: DataFrame, n: int = TOP_RERANKED, scorer=None, text_col: str = "content", hook=None) -> DataFrame:
    """Second stage over (query_id, question, chunk_id, content, score): new score by scorer(question, content), top n, flag reranked.

    Without a scorer the built-in overlap counts; scorer may be a pandas UDF. With hook(questions, contents), a function
    of Series, rows whose batch it fails on keep the order of the first stage: their flag is false, they come after
    the reranked ones, and score is their first score.
    """
    if hook is not None:
        spoken = hooked(candidates.withColumnRenamed("score", "first_score"), "score", "double", F.col("first_score").cast("double"), lambda q, t: [None if v is None else float(v) for v in hook(q, t)], ["question", text_col])
        flagged = spoken.withColumn("reranked", F.col("score_by") == "hook").drop("score_by")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranked"), F.desc("score"), F.desc("first_score"), "chunk_id"))
        return flagged.withColumn("rank", rank).where(F.col("rank") <= n)
    second = (scorer or overlap_score)(F.col("question"), F.col(text_col))
    rescored = candidates.withColumnRenamed("score", "first_score").withColumn("score", second)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("first_score"), "chunk_id"))
    return rescored.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("reranked", F.lit(True))


def attach_by_index(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Reranker results (query_id, index, score) back on the candidate with that 0-based index."""
    return candidates.join(scores.select("query_id", F.col("index").alias("candidate_index"), F.col("score").alias("second_score")), ["query_id", "candidate_index"])


def question_words(question: Column) -> Column:
    """Lower-cased words of more than two characters; repeats count."""
    return F.filter(F.split(F.lower(question), r"\s+"), lambda w: F.length(w) > 2)


#: Chunks of a course that are scored at once, and questions that they meet at once.
CHUNK_SHARD, QUESTION_SHARD = 20_000, 20_000


def keyword_top_k(questions: DataFrame, chunks: DataFrame, k: int = TOP_KEYWORD, chunk_rows: int = CHUNK_SHARD, question_rows: int = QUESTION_SHARD) -> DataFrame:
    """questions (query_id, course_id, question) against chunks (course_id, chunk_id, content, order columns).

    Score: how many question words the content holds; only positive scores; ties by chunk order. A question
    without words gets the first k chunks of its course. Chunks that repeat id and content count once.

    Shards of a course's chunks meet its questions, and a shard gives only its k best rows of each question (word_hits);
    so what is shuffled is the chunks once and few rows a question and shard. The best rows fetch their contents last.
    """
    q = questions.where("course_id is not null").select("query_id", "course_id", question_words(F.col("question")).alias("words"))
    part = F.xxhash64("content").alias("part")
    held = chunks.where("course_id is not null").select("course_id", "chunk_id", part, F.lower("content").alias("low"))
    asked = q.where("size(words) > 0")
    blocks = asked.groupBy("course_id").agg(F.ceil(F.count("*") / question_rows).cast("int").alias("blocks"))
    sizes = stored(held.groupBy("course_id").agg(F.count("*").alias("n")).join(blocks, "course_id"), "keyword-sizes")
    parts = sizes.select("course_id", "blocks", F.ceil(F.col("n") / chunk_rows).cast("int").alias("shards"))
    shards = held.where("low is not null").join(F.broadcast(parts), "course_id").withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int"))
    shards = shards.select("course_id", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk_id", "part", "low")
    sent = asked.join(F.broadcast(parts), "course_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    sent = sent.select("course_id", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "query_id", "words")
    types = {f.name: f.dataType.simpleString() for f in (*questions.schema.fields, *chunks.schema.fields)}

    def score(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["chunk_id", "part"]).sort_values(["chunk_id", "part"])
        number, ids = pd.factorize(wanted["query_id"])
        words: list[list[bytes]] = [[] for _ in ids]
        for i, said in zip(number, wanted["words"]):
            words[i].extend(w.encode() for w in said)
        of, at, scores = best_rows([t.encode() for t in rows["low"]], words, k)
        found = rows[["course_id", "chunk_id", "part"]].iloc[at].reset_index(drop=True)
        return found.assign(query_id=ids[of], score=scores.astype(np.int32))[["query_id", "course_id", "chunk_id", "part", "score"]]

    key = ["course_id", "shard", "block"]
    schema = ", ".join(f"{c} {types[c]}" for c in ("query_id", "course_id", "chunk_id")) + ", part long, score int"
    scored = shards.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(score, schema)
    wordless = q.where("size(words) = 0").select("query_id", "course_id")
    early = F.row_number().over(Window.partitionBy("course_id").orderBy("chunk_id", "part"))
    named = held.join(wordless.select("course_id").distinct(), "course_id", "left_semi").select("course_id", "chunk_id", "part").distinct()
    first = named.withColumn("place", early).where(F.col("place") <= k).join(wordless, "course_id").select("query_id", "course_id", "chunk_id", "part", F.lit(0).alias("score"))
    best = stored(top_k(scored.unionByName(first), k), "keyword-best")
    same = ["course_id", "chunk_id", "part"]
    texts = chunks.withColumn("part", part).join(best.select(*same).distinct(), same, "left_semi").dropDuplicates(same)
    return best.join(texts, same).join(questions.select("query_id", "question"), "query_id").drop("part")


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


#: Characters of a citation's stem that are looked up among the parts of file names.
GRAM = 12


def _parts(name: str, size: str) -> Column:
    """The distinct parts of a name that are so long."""
    return F.expr(f"if(length({name}) < {size}, array(), array_distinct(transform(sequence(1, length({name}) - {size} + 1), i -> substring({name}, i, {size}))))")


def match_citations(citations: DataFrame, materials: DataFrame) -> DataFrame:
    """Citations (citation_id, course_id, file_name, page, excerpt) with the newest ready material whose name holds the stem.

    Of the parts of a stem, the one that the fewest names of the course hold is looked up, with containment of the whole
    stem as a residual: what many names share, a common start, is no key while a stem has anything else. Unmatched
    citations keep a null material.
    """
    named = citations.withColumn("wanted", F.lower(stem(F.col("file_name")))).where("wanted <> ''").select("citation_id", "course_id", "wanted", F.least(F.length("wanted"), F.lit(GRAM)).alias("size"))
    sizes = sorted(r[0] for r in named.select("size").distinct().collect())  # at most GRAM of them
    ready = materials.where("status = 'ready'").select("course_id", "material_id", F.lower("file_name").alias("held_name"))
    parts = ready.select("course_id", "material_id", "held_name", F.explode(F.flatten(F.array(F.array().cast("array<string>"), *[_parts("held_name", str(n)) for n in sizes]))).alias("gram"))
    often = parts.groupBy("course_id", "gram").agg(F.count("*").alias("names"))
    asked = named.select("citation_id", "course_id", "wanted", F.explode(_parts("wanted", "size")).alias("gram")).join(often, ["course_id", "gram"])
    chosen = asked.groupBy("citation_id", "course_id", "wanted").agg(F.min(F.struct("names", "gram"))["gram"].alias("gram"))
    hit = chosen.join(parts, ["course_id", "gram"]).where(F.contains("held_name", "wanted")).groupBy("citation_id").agg(F.max("material_id").alias("material_id"))
    return citations.join(hit, "citation_id", "left").select("citation_id", "material_id", F.coalesce("page", F.lit(0)).alias("page"), F.substring("excerpt", 1, SNIPPET).alias("snippet"))


def source_tag(rank: Column, filename: Column, page: Column, level: Column) -> Column:
    """[Source i: file, p.N], with the summary level where there is one."""
    label = F.when(F.coalesce(level, F.lit(0)) > 0, F.concat(F.lit(" [Summary L"), level.cast("string"), F.lit("]"))).otherwise("")
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit(": "), F.coalesce(filename, F.lit("Unknown source")), F.lit(", p."), F.coalesce(page.cast("string"), F.lit("?")), label, F.lit("]"))


def pack_context(ranked: DataFrame, budget: int = MAX_CONTEXT) -> DataFrame:
    """Per query: chunks in rank order while their running length fits; the text, how many fit and how many not.

    ranked: (query_id, rank, filename, page, raptor_level, content).
    """
    block = F.concat(source_tag(F.col("rank"), F.col("filename"), F.col("page"), F.col("raptor_level")), F.lit("\n"), F.col("content"))
    so_far = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fitted = ranked.withColumn("block", block).withColumn("fits", so_far <= budget)
    parts = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "block"))))
    return fitted.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"), F.count_if("fits").alias("n_used"), F.count_if(~F.col("fits")).alias("n_truncated"))


def citations_of(retrieved: DataFrame) -> DataFrame:
    """Citations of retrieved chunks: no summary nodes, excerpt up to 300."""
    kept = retrieved.where(F.coalesce("chunk_type", F.lit("text")) != "raptor_summary")
    return kept.select("query_id", "rank", "filename", "page", F.substring("content", 1, EXCERPT).alias("excerpt"), "score")


def citation_list(retrieved: DataFrame) -> DataFrame:
    """Per query its citations in rank order: 'file p.N; file p.N'."""
    one = F.concat("filename", F.lit(" p."), F.col("page").cast("string"))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("c")))), lambda x: x["c"]), "; ").alias("citations"))


NO_MATCH = "I found nothing on this in the course material; please try other words."


def fallback_answers(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One answer per question: its two best chunks quoted with citations, or a notice that nothing was found."""
    best = retrieved.where("rank <= 2")
    cite = F.concat("filename", F.lit(" (Page "), F.col("page").cast("string"), F.lit(")"))
    packed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cite.alias("cite"), F.trim("content").alias("quote")))).alias("b"))
    quotes = F.array_join(F.transform("b", lambda x: F.concat(F.lit("> "), x["quote"])), "\n\n")
    text = F.concat(F.lit("From "), F.array_join(F.transform("b", lambda x: x["cite"]), ", "), F.lit(":\n\n"), quotes)
    return questions.join(packed, "query_id", "left").select("query_id", "question", F.when(F.col("b").isNull(), NO_MATCH).otherwise(text).alias("answer"))


def embed(rows: DataFrame, text_col: str = "text", features: int = 1 << 12, hook=None) -> DataFrame:
    """Adds embedding: hashed TF-IDF at unit length, so equal texts have equal vectors.

    hook: a function from a Series of texts to vectors of the same length (features) as the default's; where it fails, the
    default stands, and embedding_by says which it is (see hooks.hooked).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = rows.withColumn("words", F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""))
    stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="unit")]
    made = Pipeline(stages=stages).fit(words).transform(words)
    if hook is None:
        return made.withColumn("embedding", vector_to_array("unit", "float32")).drop("words", "tf", "tfidf", "unit")
    fitting = lambda texts: [v if v is not None and len(v) == features else None for v in hook(texts)]
    return hooked(made, "embedding", "array<float>", vector_to_array("unit", "float32"), fitting, [text_col]).drop("words", "tf", "tfidf", "unit")


#: Bits of a vector's sketch, and candidates for each wanted row that are compared exactly.
SKETCH_BITS, CANDIDATES = 256, 10


def sketches(vectors: DataFrame, seed: int = 11, bits: int = SKETCH_BITS) -> DataFrame:
    """Adds sketch: on which side of each of so many random planes the vector lies, 64 to a number."""
    @F.pandas_udf("array<long>")
    def sides(embedding: pd.Series) -> pd.Series:
        rows = embedding.tolist()
        out = np.zeros((len(rows), bits // 64), np.int64)
        for size in {len(x) for x in rows if x is not None}:
            at = [i for i, x in enumerate(rows) if x is not None and len(x) == size]
            planes = np.random.default_rng(seed).standard_normal((size, bits))
            over = np.nan_to_num(np.stack([np.asarray(rows[i], float) for i in at])) @ planes > 0
            out[at] = np.packbits(over, axis=1).view(">i8")
        return pd.Series(list(out))

    return vectors.withColumn("sketch", sides("embedding"))


#: Rows of a namespace that cells are fitted on, the most cells, and rounds of fitting. Every vector is put into a cell.
CELL_SAMPLE, MAX_CELLS, CELL_ROUNDS = 10_000, 4096, 12
#: Share of the neighbours of sampled rows that the cells a query reads have to hold, and how many rows and neighbours that is measured on.
CELL_RECALL, PROBE_ROWS, PROBE_NEIGHBOURS = 0.97, 200, 10


def fit_cells(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centres of cells by spherical k-means: first centres are rows far from each other, rows go to the centre of the largest product."""
    r = np.random.default_rng(seed)
    centres = [x[r.integers(len(x))]]
    near = 1 - x @ centres[0]
    while len(centres) < min(cells, len(x)):
        chance = np.maximum(near, 0)
        if chance.sum() <= 1e-9:
            break
        centres.append(x[r.choice(len(x), p=chance / chance.sum())])
        near = np.minimum(near, 1 - x @ centres[-1])
    centres = np.stack(centres)
    for _ in range(CELL_ROUNDS):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray) -> int:
    """Least number of nearest cells that holds CELL_RECALL of the nearest rows of sampled rows, so how much a query reads follows from the data."""
    rows = x[:: max(1, len(x) // PROBE_ROWS)]
    products = rows @ x.T
    k = min(PROBE_NEIGHBOURS + 1, len(x))
    nearest = np.argpartition(-products, k - 1, axis=1)[:, :k]
    cell = (x @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(rows @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, cell[nearest], axis=1).ravel()
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(CELL_RECALL * len(ranks))))]) + 1


@dataclass
class VectorIndex:
    """cells (namespace, n, probes, centres) and vectors (namespace, cell, chunk_id, embedding, sketch), both in the shared folder, vectors by cell."""

    cells: DataFrame
    vectors: DataFrame


def _unit_rows(values: pd.Series) -> np.ndarray:
    x = np.nan_to_num(np.stack(values.to_numpy()).astype(float))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


#: Products of rows and centres that are in memory at once: a task's memory does not grow with the number of cells.
CELL_PAIRS = 1_000_000


def _parts_of(x: np.ndarray, cells: int) -> list[np.ndarray]:
    """Rows so many at a time that they have CELL_PAIRS products with the cells."""
    step = max(1, CELL_PAIRS // cells)
    return [x[i : i + step] for i in range(0, len(x), step)]


def build_index(vectors: DataFrame) -> VectorIndex:
    """Coarse cells of each namespace, about the root of its size, and every vector with its sketch in its nearest cell.

    Cells, and how many of them a query has to read, are fitted on a bounded sample by hash (CELL_SAMPLE rows a
    namespace); the sample decides neither which vectors are held nor what they score. Vectors of a namespace have one length.
    """
    held = vectors.where("embedding is not null").select("namespace", "chunk_id", "embedding")
    sizes = stored(held.groupBy("namespace").agg(F.count("*").alias("n")), "index-sizes")
    rank = F.row_number().over(Window.partitionBy("namespace").orderBy(F.xxhash64("chunk_id"), "chunk_id"))
    sample = held.withColumn("place", rank).where(F.col("place") <= CELL_SAMPLE).join(sizes.withColumnRenamed("namespace", "of"), F.col("namespace").eqNullSafe(F.col("of"))).drop("of")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x, n = _unit_rows(rows["embedding"]), int(rows["n"].iloc[0])
        centres = fit_cells(x, min(MAX_CELLS, max(1, round(n**0.5))))
        return pd.DataFrame({"namespace": [rows["namespace"].iloc[0]], "n": [n], "probes": [probes_needed(x, centres)], "centres": [centres.ravel().tolist()]})

    cells = stored(sample.groupBy("namespace").applyInPandas(fit, "namespace string, n long, probes int, centres array<double>"), "index-cells")
    shards = sharded(held, "namespace", "chunk_id", sizes)

    def put(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        x = _unit_rows(rows["embedding"])
        centres = np.asarray(model["centres"].iloc[0]).reshape(-1, x.shape[1])
        return rows[["namespace", "chunk_id", "embedding"]].assign(cell=np.concatenate([(part @ centres.T).argmax(1) for part in _parts_of(x, len(centres))]).astype(np.int32))

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = sketches(beside(shards, cells.select("namespace", "centres"), "namespace", put, f"namespace string, chunk_id string, embedding {kind}, cell int"))
    path = shared_folder(vectors.sparkSession, "index")
    placed.hint("rebalance", "namespace", "cell").sortWithinPartitions("namespace", "cell").write.parquet(path)
    return VectorIndex(cells, vectors.sparkSession.read.schema(placed.schema).parquet(path))


#: Rows of a namespace whose sketches a task holds (under 1 KB each), queries that it answers, and rows that it gives at a time.
SKETCH_SHARD, SKETCH_QUERIES, ROWS_OUT = 400_000, 20_000, 100_000


def _near_cells(index: VectorIndex, queries: DataFrame, kind: str) -> DataFrame:
    """(namespace, query_id, embedding, cells): the cells that each query reads, nearest first as many as its namespace needs; as numbers (array<int>) or a bit each (binary)."""
    name, vector = queries.schema["query_id"].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()
    asked = queries.where("embedding is not null").select("namespace", "query_id", "embedding")
    shards = sharded(asked, "namespace", "query_id", asked.groupBy("namespace").agg(F.count("*").alias("n")))

    def look(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(model):  # a namespace without vectors
            return pd.DataFrame({c: pd.Series([], dtype="object") for c in ("namespace", "query_id", "embedding", "cells")})
        x = _unit_rows(rows["embedding"])
        centres = np.asarray(model["centres"].iloc[0]).reshape(-1, x.shape[1])
        cells = []
        for part in _parts_of(x, len(centres)):
            near = np.argsort(-(part @ centres.T), axis=1, kind="stable")[:, : int(model["probes"].iloc[0])]
            if kind == "binary":
                read = np.zeros((len(part), len(centres)), bool)
                np.put_along_axis(read, near, True, 1)
                cells.extend(r.tobytes() for r in np.packbits(read, axis=1))
            else:
                cells.extend(near.astype(np.int32).tolist())
        return rows[["namespace", "query_id", "embedding"]].assign(cells=cells)

    return beside(shards, index.cells.select("namespace", "probes", "centres"), "namespace", look, f"namespace string, query_id {name}, embedding {vector}, cells {kind}")


def probed_cells(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(namespace, query_id, cell): the cells that each query reads."""
    return _near_cells(index, queries, "array<int>").select("namespace", "query_id", F.explode("cells").alias("cell"))


def approximate_candidates(queries: DataFrame, index: VectorIndex, n: int, k: int | None = None, row_shard: int = SKETCH_SHARD, query_rows: int = SKETCH_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score): of the vectors in the cells that a query reads, the n whose sketches differ least from its own, ties by chunk_id.

    A task compares the sketches of a shard of rows with those of a block of queries in memory and gives n rows of each
    query; with k, and where a namespace has one shard, only the k best of them.
    """
    q = sketches(_near_cells(index, queries, "binary")).where("namespace is not null").select("namespace", "query_id", "embedding", "sketch", "cells")
    v = index.vectors.where("namespace is not null").select("namespace", "cell", "chunk_id", "embedding", "sketch")

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = _rows(asked), _rows(held)
        whole = k is not None and held.num_rows > 0 and held["shards"][0].as_py() == 1
        of, at, differ, score = nearest_sketches(asked, held, n, k if whole else None)
        found = pa.table({"query_id": asked["query_id"].take(pa.array(of)), "chunk_id": held["chunk_id"].take(pa.array(at)), "differ": pa.array(differ, pa.int32()), "score": pa.array(score, pa.float64())})
        give_back()
        return pa.concat_tables([found.slice(i, ROWS_OUT) for i in range(0, max(1, found.num_rows), ROWS_OUT)])

    types = [queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["chunk_id"].dataType.simpleString()]
    asked, held = _met(q, v, row_shard, query_rows)
    met = asked.cogroup(held).applyInArrow(near, f"query_id {types[0]}, chunk_id {types[1]}, differ int, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("differ", "chunk_id"))
    return met.withColumn("place", place).where(F.col("place") <= n).select("query_id", "chunk_id", "score")


def approximate_top_k(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, score, rank) from an index, or from vectors that one is built of first.

    A query reads the cells nearest to it, compares sketches there, and exactly only the k * candidates nearest by
    sketch. How many cells is fitted so that they hold 97 % of the neighbours of sampled rows: few where vectors lie in
    clusters, many where they are random and no cells can part them. chunk_id is unique in a namespace; queries in a
    namespace without vectors find nothing.
    """
    index = vectors if isinstance(vectors, VectorIndex) else build_index(vectors)
    return top_k(approximate_candidates(queries, index, k * candidates, k), k)


def read_share(index: VectorIndex, queries: DataFrame) -> float:
    """Share of the pairs of query and vector of a namespace whose sketches are compared."""
    probes = probed_cells(index, queries)
    sizes = index.vectors.groupBy("namespace", "cell").agg(F.count("*").alias("n"))
    read = probes.join(sizes, ["namespace", "cell"]).agg(F.sum("n")).first()[0]
    whole = queries.join(index.cells.select("namespace", "n"), "namespace").agg(F.sum("n")).first()[0]
    return (read or 0) / whole
