"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy.

The measures come from a public vocabulary with byte fallback. For each language (or script, where no language
column is named) and length (half an octave of tokens) the bands lie about the median of all documents that pass
the base rule, WIDTH robust deviations to each side. Where too few documents have that length, those of similar
lengths count as well, after the trend of each measure with the logarithm of the length is taken off.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import vocabulary_path
from .shared import mapped, stored, with_fields
from .textarrays import SPACED, chunks, mix, span_hashes, string_buffers, word_spans
from .wordcache import WordCache

VOCABULARY = "piece_bpe_32k.model"
REPEAT_WINDOW = 8
MIN_WORDS = 20
#: Bins of an octave of tokens; bands are taken of the narrowest span of bins to each side, then the group, that has MIN_TEXTS
#: texts, else of all texts, however few they are.
BINS, SPANS, MIN_TEXTS = 2, (0, 1, 3), 50
WIDTH = 4.0
#: Least robust deviation of each measure, so that a very even group rejects nothing for a trifle.
FLOORS = {"chars_per_token": 0.02, "fallback_share": 0.01, "entropy_ratio": 0.012}
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_PARTS = re.compile(rb" +[^ \n]*|\n[^ \n]*")
_caches: dict[str, tuple[WordCache, np.ndarray]] = {}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy_ratio double, script string"


def split_pieces(text: bytes) -> list[bytes]:
    """Parts of a text that no token joins: words with the spaces before them (less the one that the model adds), and
    line ends with what follows them.

    In the vocabulary a space stands at the start of a piece or in a run of spaces, and a line end is a byte token,
    so that the word after it has no space. This is checked when the vocabulary is loaded.
    """
    if not text:
        return []
    if b"\xe2\x96\x81" in text:  # the sign that stands for a space
        text = text.replace(b"\xe2\x96\x81", b" ")
    if b"  " in text or text[:1] == b" ":
        return [x if x[:1] == b"\n" else x[1:] for x in _PARTS.findall(b" " + text)]
    return text.replace(b"\n", b" \n").split(b" ")


def _cache(path: str) -> tuple[WordCache, np.ndarray]:
    if path not in _caches:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        pieces = [model.id_to_piece(i) for i in np.flatnonzero(~is_byte).tolist()]
        if any("\n" in p or "\u2581" in p.lstrip("\u2581") or (p.startswith("\u2581\u2581") and p.strip("\u2581")) for p in pieces):
            raise ValueError(f"{path}: its tokens join words")
        space = model.piece_to_id("\u2581")

        def encode(words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
            found = model.encode([w.decode() for w in words], num_threads=1)
            # The model puts a space before each; a line end has none.
            found = [[space] if not w else ids[1:] if w[:1] == b"\n" else ids for w, ids in zip(words, found)]
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

        _caches[path] = WordCache(encode), is_byte
    return _caches[path]


def repeated_words(hashes: np.ndarray, row: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each word: whether it lies in a window of words that its row holds twice or more."""
    n = len(hashes) - window + 1
    marked = np.zeros(len(hashes) + 1, np.int64)
    if n <= 0:
        return marked[:-1] > 0
    key = sum(hashes[j : j + n] * _MIX[j % 8] * np.uint64(2 * (j // 8) + 1) for j in range(window))
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    key = mix(key[inside] + row[inside].astype(np.uint64) * _MIX[0])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
    np.add.at(marked, twice, 1)
    np.add.at(marked, twice + window, -1)
    return np.cumsum(marked)[:-1] > 0


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _scripts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The script most of a text's letters are in, by the leading bytes of their code points."""
    ascii_letters = ((b | 32) >= 97) & ((b | 32) <= 122)
    kinds = {"latin": ascii_letters | ((b >= 0xC3) & (b <= 0xC9)), "greek": (b == 0xCE) | (b == 0xCF), "cyrillic": (b >= 0xD0) & (b <= 0xD4), "semitic": (b >= 0xD6) & (b <= 0xDD), "indic": b == 0xE0, "east asian": (b >= 0xE3) & (b <= 0xED)}
    counts = np.stack([_sums(m, off) for m in kinds.values()])
    return np.where(counts.sum(0) > 0, np.array(list(kinds))[counts.argmax(0)], "none")


def measure(documents: DataFrame, columns: list[str], text_col: str = "text", path: str | None = None, window: int = REPEAT_WINDOW) -> DataFrame:
    """The named columns and MEASURES for each document; ratios are null where there is no token."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, is_byte = _cache(path)
        for batch in batches:
            buf, off = string_buffers(batch.column(batch.num_columns - 1))
            for i, j, b, o in chunks(buf, off):
                starts, ends, row = word_spans(b, o, SPACED)
                rows = j - i
                n_words = np.bincount(row, minlength=rows)
                repeat = np.bincount(row, repeated_words(span_hashes(b, starts, ends), row, window), rows).astype(np.int64)
                word_chars = _sums(SPACED[b] & ((b & 0xC0) != 0x80), o)
                raw = [b[x:y].tobytes() for x, y in zip(o[:-1], o[1:])]
                lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
                dups = np.array([len(x) - len(set(x)) for x in lines], np.int64)
                ratios = np.full((3, rows), np.nan)
                n_tokens = np.zeros(rows, np.int64)
                for r, ids in enumerate(cache.ids([split_pieces(t) for t in raw])):
                    ids = np.frombuffer(ids, "<u4")
                    n_tokens[r] = len(ids)
                    if len(ids):
                        n = np.unique(ids, return_counts=True)[1]
                        spread = -(n / len(ids) * np.log2(n / len(ids))).sum()
                        ratios[:, r] = word_chars[r] / len(ids), is_byte[ids].mean(), spread / max(1.0, np.log2(len(ids)))
                own = [batch.column(k).slice(i, rows) for k in range(batch.num_columns - 1)]
                own += [pa.array(x) for x in (n_words, word_chars, _sums(_SYMBOLS[b], o), dups, repeat, n_tokens)]
                own += [pa.array(x, from_pandas=True) for x in ratios] + [pa.array(_scripts(b, o).tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(own, [*columns, *[m.split()[0] for m in MEASURES.split(", ")]])

    return mapped(documents.select(*columns, text_col), run, with_fields(documents, columns, MEASURES))


def trends(usable: DataFrame) -> dict[str, float]:
    """Slope of each measure over log2 of the tokens, over all documents."""
    found = usable.agg(*[F.regr_slope(m, F.log2("n_tokens")).alias(m) for m in FLOORS]).first()
    return {m: found[m] or 0.0 for m in FLOORS}


def length_bin() -> Column:
    return F.floor(BINS * F.log2("n_tokens")).cast("int")


def level(m: str, slopes: dict[str, float]) -> Column:
    """The measure without its trend."""
    return F.col(m) - slopes[m] * F.log2("n_tokens")


def bands(usable: DataFrame, group: str, slopes: dict[str, float]) -> DataFrame:
    """Per group and bin of tokens: median and robust deviation of each measure's level.

    Sketched quantiles: one row of bounded size per group, bin and map task is shuffled, however large a group is.
    """
    near = [(k, d) for k, span in enumerate(SPANS) for d in range(-span, span + 1)]
    at = [F.struct(F.lit(k).alias("k"), F.lit(False).alias("every"), (length_bin() + d).alias("b")) for k, d in near]
    none = F.lit(None).cast("int")
    at += [F.struct(F.lit(len(SPANS) + every).alias("k"), F.lit(bool(every)).alias("every"), none.alias("b")) for every in (0, 1)]
    flat = usable.select(F.col(group).alias("g"), *[level(m, slopes).alias(m) for m in FLOORS], F.explode(F.array(*at)).alias("at"))
    stats = flat.groupBy(F.when(~F.col("at.every"), F.col("g")).alias("g"), "at").agg(F.count("*").alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in FLOORS])
    stats = stats.where((F.col("n") >= MIN_TEXTS) | F.col("at.every")).select("g", F.col("at.k").alias("k"), F.col("at.b").alias("b"), F.struct(F.col("at.k").alias("k"), *FLOORS).alias("held"))
    bins = usable.select(F.col(group).alias("band_group"), length_bin().alias("band_bin")).distinct()
    # What a bin may take its band from, as keys: a span of bins of its group, its group, all texts.
    group_type, last = usable.schema[group].dataType, len(SPANS)
    keys = [F.struct(F.lit(k).alias("want_k"), F.lit(None).cast(group_type).alias("want_g") if k > last else F.col("band_group").alias("want_g"), none.alias("want_b") if k >= last else F.col("band_bin").alias("want_b")) for k in range(last + 2)]
    wanted = bins.select("band_group", "band_bin", F.explode(F.array(*keys)).alias("key")).select("band_group", "band_bin", "key.*")
    same = (F.col("want_k") == F.col("k")) & F.col("want_g").eqNullSafe(F.col("g")) & F.col("want_b").eqNullSafe(F.col("b"))
    best = wanted.join(stats, same).groupBy("band_group", "band_bin").agg(F.min("held").alias("held"))
    out = [F.col("band_group"), F.col("band_bin")]
    for m, floor in FLOORS.items():
        q = F.col(f"held.{m}")
        out += [q[1].alias(f"{m}_mid"), F.greatest((q[2] - q[0]) / 1.349, F.when(q.isNotNull(), F.lit(floor))).alias(f"{m}_dev")]
    return best.select(*out)


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, path: str | None = None) -> DataFrame:
    """One row per document: id, the counts, the measures, base_failed, reasons (array), kept.

    Null and empty texts have no words and fail the base rule; where a group has under MIN_TEXTS texts that pass it,
    the bands are those of all texts; a null group is a group; texts of any length are read whole; repeated rows are answered one by one; an
    empty table gives an empty result; other columns are ignored.
    """
    columns = [id_col] + [c for c in [group_col] if c]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = stored(measure(documents, columns, text_col, path).withColumn("base_failed", failed), "fertility")
    group = group_col or "script"
    usable = measured.where(~F.col("base_failed") & (F.col("n_tokens") > 0))
    slopes = trends(usable)
    joined = measured.join(bands(usable, group, slopes), F.col(group).eqNullSafe(F.col("band_group")) & (length_bin() == F.col("band_bin")), "left")
    off = {m: (level(m, slopes) - F.col(f"{m}_mid")) / F.col(f"{m}_dev") for m in FLOORS}
    why = [F.when(off["entropy_ratio"] < -WIDTH, F.lit("low entropy")), F.when(off["fallback_share"] > WIDTH, F.lit("byte fallback"))]
    why += [F.when(off["chars_per_token"] < -WIDTH, F.lit("short tokens")), F.when(off["chars_per_token"] > WIDTH, F.lit("long tokens"))]
    reasons = F.array_compact(F.array(*why))
    return joined.select(*columns, *[m.split()[0] for m in MEASURES.split(", ")], "base_failed", reasons.alias("reasons")).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
