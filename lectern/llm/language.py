"""Language identification with a convolutional network over bytes, trained in numpy.

Texts are cut into fixed windows of WINDOW bytes (ASCII lower-cased, the last one padded); every window of every
text is classified. Embedded bytes go through filters of several widths, each is max-pooled over the window, and
a softmax layer reads the pooled features. For inference the embedding and a filter column pair are folded into
tables over byte pairs, which gives the same numbers as the convolution with one lookup a pair.
A text's language is the one with the largest sum of window log-probabilities, weighted by the windows' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, hash_sample, mapped, stored, with_fields, without
from .textarrays import LOWER, chunks, string_buffers

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: The training sample: about so many documents a language, by hash of the id, and windows a document.
TRAIN_DOCS, TRAIN_WINDOWS = 400, 4
EPOCHS, BATCH, RATE, SEED = 8, 64, 4e-3, 7
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width its lookup tables: (place, 65536 x FILTERS over byte pairs, or 256 x FILTERS over bytes)."""
        made = []
        for w, k, b in zip(WIDTHS, self.kernels, self.bias):
            taps = [self.embed @ k[j * EMBED : (j + 1) * EMBED] for j in range(w)]
            taps[0] = taps[0] + b
            mine = []
            for j in range(0, w, 2):
                t = (taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < w else taps[j]
                mine.append((j, np.ascontiguousarray(t, np.float32)))
            made.append(mine)
        return made


def _unfold(x: np.ndarray, w: int) -> np.ndarray:
    n = x.shape[1] - w + 1
    return np.concatenate([x[:, j : j + n] for j in range(w)], axis=2)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on cross-entropy; a third of the windows of each batch is cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "V": rng.normal(0, 0.2, (total, len(langs))), "c": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"K{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x, y, rows = windows[some].copy(), labels[some], np.arange(len(some))
            short = rng.random(len(some)) < 0.33
            x[np.arange(WINDOW)[None, :] >= np.where(short, rng.integers(8, WINDOW, len(some)), WINDOW)[:, None]] = 0
            e = p["E"][x]
            e[x == 0] = 0
            pooled, keep = [], []
            for w in WIDTHS:
                u = _unfold(e, w)
                z = u @ p[f"K{w}"] + p[f"b{w}"]
                arg = z.argmax(1)
                pooled.append(np.take_along_axis(z, arg[:, None, :], 1)[:, 0])
                keep.append((u, arg))
            h = np.maximum(np.concatenate(pooled, 1), 0)
            logits = h @ p["V"] + p["c"]
            q = np.exp(logits - logits.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[rows, y] -= 1
            q /= len(some)
            g = {"V": h.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
            dh = (q @ p["V"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                u, arg = keep[i]
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                picked = u[rows[:, None], arg]
                g[f"K{w}"], g[f"b{w}"] = np.einsum("bfk,bf->kf", picked, d), d.sum(0)
                back = (d[:, :, None] * p[f"K{w}"].T[None]).reshape(len(some), FILTERS, w, EMBED)
                where = x[rows[:, None, None], arg[:, :, None] + np.arange(w)]
                np.add.at(g["E"], where, back)
            g["E"][0] = 0
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    p["E"][0] = 0
    return Network(langs, p["E"], [p[f"K{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["V"], p["c"])


def log_probabilities(net: Network, tables: list, windows: np.ndarray) -> np.ndarray:
    """windows x languages."""
    pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
    pooled = []
    for w, mine in zip(WIDTHS, tables):
        n = WINDOW - w + 1
        z = None
        for j, t in mine:
            part = t.take(pairs[:, j : j + n] if len(t) > 256 else windows[:, j : j + n], axis=0)
            z = part if z is None else np.add(z, part, out=z)
        pooled.append(z.max(1))
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def cut_windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each) over whole rows."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    at = off[:-1][row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    held = np.minimum(WINDOW, off[1:][row] - at)
    padded = np.concatenate([LOWER[buf], np.zeros(WINDOW, np.uint8)])
    windows = padded[at[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW)[None, :] >= held[:, None]] = 0
    return windows, row, held


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", docs: int = TRAIN_DOCS, per_doc: int = TRAIN_WINDOWS) -> Network | None:
    """Trains on the windows of a bounded sample; None if there is nothing to learn from.

    The sample is a hash threshold per language, so texts are filtered where they are read.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = hash_sample(usable, F.col(lang_col), F.col(order_col), docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = string_buffers(batch.column(1))
            windows, row, held = cut_windows(buf, off)
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            count = np.bincount(row, minlength=batch.num_rows)[row]
            step = np.maximum(1, count // per_doc)
            pick = np.flatnonzero((nth % step == 0) & (nth // step < per_doc) & (held > 8))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[pick])), pa.array([w.tobytes() for w in windows[pick]], pa.binary())], ["lang", "win"])

    rows = mapped(sample.select("lang", "text"), run, "lang string, win binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["win"])) for r in rows)
    langs = sorted({lang for lang, _ in rows})
    return train(np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW), np.array([langs.index(lang) for lang, _ in rows]), langs)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode(errors="ignore"))


def predict(documents: DataFrame, net: Network | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns with lang_pred and score (share of the weighted probability); UNKNOWN and 0 without a letter."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            buf, off = string_buffers(batch.column(batch.num_columns - 1))
            for i, j, b, o in chunks(buf, off, 2 << 20):
                rows = j - i
                best, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
                low = LOWER[b]
                letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                ok = letters[o[1:]] > letters[o[:-1]]
                for r in np.flatnonzero(~ok & (o[1:] > o[:-1])):
                    ok[r] = _has_letter(b[o[r] : o[r + 1]].tobytes())
                if net and ok.any():
                    windows, row, held = cut_windows(b, o)
                    logs = np.concatenate([log_probabilities(net, tables, windows[k : k + 512]) for k in range(0, len(windows), 512)])
                    weight = held / np.maximum(1, np.bincount(row, held, rows))[row]
                    mean = np.stack([np.bincount(row, weight * np.maximum(logs[:, c], -12), rows) for c in range(len(net.langs))], 1)
                    q = np.exp(mean - mean.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                    best[ok] = np.array(net.langs, object)[mean[ok].argmax(1)]
                    score[ok] = q[ok].max(1)
                own = [batch.column(k).slice(i, rows) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(best.tolist(), pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

    return mapped(documents.select(*columns, text_col), run, with_fields(documents, columns, "lang_pred string, score double"))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Null, empty and letterless texts are UNKNOWN with score 0, as is every text if no language is labelled;
    texts of any length are read whole; rows are answered one by one, repeats alike; an empty table gives an empty
    result; other columns are ignored.
    """
    held_out = fold(F.col(id_col), folds) == held_out_fold
    net = fit(documents.where(~held_out), text_col, lang_col, id_col)
    return predict(documents, net, [id_col], text_col).withColumn("held_out", held_out).select(id_col, "held_out", "lang_pred", "score")


def keep_identified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least that score, with all their columns; learns from their own labels."""
    net = fit(documents, text_col, lang_col, id_col)
    keyed = documents.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("gone_src"), F.col(text_col).alias("text"))
    found = predict(keyed, net, ["gone_src"])
    rejected = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("gone_src").distinct()
    return without(documents, stored(rejected, "unidentified"), id_col, text_col)
