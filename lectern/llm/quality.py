"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier on form features gives each document evidence. Host and path posteriors come from grouped
aggregation of that evidence over all documents: a host's rate is shrunk towards the global rate and a path's
towards its host's, by prior strengths estimated from the spread between hosts and between paths. The result is
the document's own log odds moved by what its site says beyond the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, mapped, stored, with_fields, without
from .textarrays import SPACED, chunks, span_hashes, string_buffers, word_spans
from .toxicity import labelled_sample, logistic

#: The labelled sample: about so many texts of each label.
SAMPLE = 4000
#: Bounds of the estimated prior strengths, in documents.
STRENGTH = (5.0, 1e6)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
NAMES = ["upper", "symbols", "bangs", "repeats", "variety", "word_length", "digits", "log_words", "few_words", "long_words", "pipes", "no_stops"]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def features(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """rows x (1, NAMES), each bounded."""
    rows = len(o) - 1
    starts, ends, row = word_spans(b, o, SPACED)
    n = np.bincount(row, minlength=rows).astype(float)
    some, chars = np.maximum(n, 1), np.maximum(np.diff(o), 1)
    h = span_hashes(b, starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[pair][1:] != h[pair][:-1]) | (row[pair][1:] != row[pair][:-1])
    kinds = np.bincount(row[pair][new], minlength=rows)
    upper = _per_row((b >= 65) & (b <= 90), o)
    letters = np.maximum(_per_row(((b | 32) >= 97) & ((b | 32) <= 122), o), 1)
    bang = np.concatenate([(b[1:] == 33) & (b[:-1] == 33), [False]]) if len(b) else np.zeros(0, bool)
    x = [
        np.ones(rows), upper / letters, np.minimum(_per_row(_SYMBOLS[b], o) / some, 3), np.minimum(_per_row(bang, o) / some, 1),
        np.bincount(row, again, rows) / some, np.log(np.maximum(kinds, 1)) / np.log(some + 1), np.minimum(np.bincount(row, ends - starts, rows) / some, 20) / 10,
        np.minimum(_per_row((b >= 48) & (b <= 57), o) / chars, 1), np.log1p(n) / 10, (n < 5).astype(float), np.minimum(np.bincount(row, ends - starts > 25, rows) / some, 1),
        np.minimum(_per_row(b == 124, o) / some, 1), np.minimum(_per_row(_PUNCTUATION[b], o) / some, 1),
    ]
    return np.stack(x, 1)


def fit(sample: DataFrame) -> np.ndarray:
    """Coefficients from (text, y); without both labels every document has even odds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = string_buffers(batch.column(0))
            for i, j, b, o in chunks(buf, off):
                x = features(b, o)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], ["x", "y"])

    rows = mapped(sample, run, "x array<double>, y int").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(rows) or y.min() == y.max():
        return np.zeros(len(NAMES) + 1)
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort(np.column_stack([x, y]).T)
    return logistic(x[order], y[order], ridge=0.3)


def evidence(documents: DataFrame, coefficients: np.ndarray, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns and evidence, the classifier's log odds that a text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = string_buffers(batch.column(batch.num_columns - 1))
            for i, j, b, o in chunks(buf, off):
                own = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.round(np.clip(features(b, o) @ coefficients, -12, 12), 9))], [*columns, "evidence"])

    return mapped(documents.select(*columns, text_col), run, with_fields(documents, columns, "evidence double"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Method of moments: how many documents the prior is worth, from groups (n, rate) and the mean they vary about."""
    spread = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("rate") - mean) ** 2).alias("between"), F.sum("within").alias("within"), F.sum(F.col("n") ** 2).alias("n2"), F.sum(F.col("n") * mean * (1 - mean)).alias("binomial")).first()
    if not spread["n"] or spread["k"] < 2:
        return STRENGTH[1]
    scale = spread["n"] - spread["n2"] / spread["n"]
    noise = spread["within"] / spread["n"] * (spread["k"] - 1)
    tau2 = (spread["between"] - noise) / scale if scale > 0 else 0
    total = spread["binomial"] / spread["n"]
    return float(np.clip(total / tau2 - 1, *STRENGTH)) if tau2 > 0 else STRENGTH[1]


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", per_label: int = SAMPLE, folds: int = 5, held_out_fold: int | None = 0) -> DataFrame:
    """One row per document: id, src (hash of id and text), held_out, evidence, host_rate, path_rate, score, good.

    The classifier learns from labels outside the held-out fold (from all if that is None). Host and path are any two
    nested columns: of a web page the host and first part of the path of its URL, where there is none the source and
    the language. Null and empty texts are judged by their features (no words); null hosts and paths are groups of their own;
    without labels evidence is even; texts of any length are read whole; rows are answered one by one, repeats alike; an empty table gives an empty
    result; other columns are ignored.
    """
    held_out = F.lit(False) if held_out_fold is None else fold(F.col(id_col), folds) == held_out_fold
    sample = stored(labelled_sample(documents.where(~held_out), labels.where(~held_out), label_col, id_col, text_col, per_label), "quality-sample")
    flat = documents.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("src"), held_out.alias("held_out"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = stored(evidence(flat, fit(sample), ["doc", "src", "held_out", "host", "path"]).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "quality-evidence")
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") ** 2).alias("squares")), "quality-paths")
    within = (F.col("squares") - F.col("good") ** 2 / F.col("n")).alias("within")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = float(whole["good"] / whole["n"]) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    hosts = hosts.select("host", "n", "good", (F.col("good") / F.col("n")).alias("rate"), within)
    a = _strength(hosts, F.lit(mean))
    host_rates = hosts.select(F.col("host").alias("host_key"), ((F.col("good") + a * mean) / (F.col("n") + a)).alias("host_rate"))
    nested = paths.select("host", "path", "n", "good", (F.col("good") / F.col("n")).alias("rate"), within).join(host_rates, F.col("host").eqNullSafe(F.col("host_key")))
    b = _strength(nested, F.col("host_rate"))
    rates = nested.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))
    both = scored.join(stored(rates, "quality-rates"), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    odds = F.col("evidence") + _logit(F.col("path_rate")) - _logit(F.lit(mean))
    done = both.select(F.col("doc").alias(id_col), "src", "held_out", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("score"))
    return done.withColumn("good", F.col("score") >= 0.5)


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The documents that are classified good, with all their columns."""
    verdict = classify(documents, labels, id_col, text_col, host_col, path_col, label_col, held_out_fold=None)
    bad = stored(verdict.where(~F.col("good")).select(F.col("src").alias("gone_src")).distinct(), "rejected")
    return without(documents, bad, id_col, text_col)
