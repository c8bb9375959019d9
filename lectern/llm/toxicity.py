"""Toxicity with a weighted finite-state pattern grammar.

Words are first read by a lexical transducer (whole words and word stems -> class and weight). Small transducers
for insult, threat, target, negation and reported speech are composed into one machine, which reads the classes
of a clause and emits weighted matches with their frame; a text is scored by its matched clauses. The closed
classes are fixed lists; the insult lexicon and the weight of each frame are estimated from labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, hash_sample, mapped, stored, with_fields
from .textarrays import ALNUM, chunks, find_sorted, lower_latin, mix, running_hash, spans_from, string_buffers, word_spans

# Closed word classes in English, French, German and Spanish.
TARGETS = "you your you're yourself u tu toi vous ton votre te du dich dir ihr euch dein euer tú ti usted ustedes vosotros tus"
NEGATIONS = "not no never n't isn't aren't don't didn't without pas jamais sans non nicht kein keine nie ohne nunca jamás sin tampoco"
REPORTS = "said says say saying told wrote writes quoted called claims claimed according dit dite écrit selon sagte sagt schrieb laut dijo dice escribió según"
THREATS = (
    "kill kills killing hurt hurts hurting destroy destroying murder murdering stab stabbing shoot shooting strangle strangling burn burning "
    "tuer tue tuerai frapper frapperai détruire détruirai töten töte umbringen schlagen vernichten vernichte matar mato mataré golpear golpearé destruir destruiré")
THREATENED = "killed hurt destroyed murdered stabbed shot strangled burned burnt tué tués frappé détruit getötet umgebracht geschlagen vernichtet matado muerto golpeado destruido"
#: What a threat weighs where no insults were learned; else as much as these do on average, and in both cases what
#: labelled texts say, against a prior of so many texts.
THREAT_WEIGHT, THREAT_PRIOR = 4.0, 10

#: The labelled sample: about so many texts of each label, by hash of the id.
SAMPLE = 2500
#: A term is learned as an insult if so many toxic texts of the sample hold it (or this share, if that is more), in as
#: many different contexts, at such odds.
MIN_TEXTS, MIN_SHARE, MIN_LOG_ODDS, MAX_CLEAN_SHARE = 6, 0.004, 2.5, 0.002
STEM_BYTES = (4, 5, 6, 7)
OTHER, INSULT, THREAT, THREATENED_BY, TARGET, NEGATION, REPORT = range(7)
_CLAUSE_END = np.isin(np.arange(256), list(b".!?;:\n"))
_STEM_SALT = {n: np.uint64(0x9E3779B97F4A7C15 * (n + 1) % (1 << 64)) for n in STEM_BYTES}

# A transducer: (start, step(state, symbol) -> (state, tag or None)).
REACH = 3  # words that a negation or a target reaches over
THREAT_REACH = 5  # words that a threat reaches over


def _countdown(symbol: int, tag: str, on: tuple[int, ...]):
    def step(state: int, seen: int) -> tuple[int, str | None]:
        return (REACH if seen == symbol else max(0, state - 1)), (tag if state and seen in on else None)

    return range(REACH + 1), step


def _sticky(symbol: int, tag: str, on: tuple[int, ...]):
    def step(state: int, seen: int) -> tuple[int, str | None]:
        return int(state or seen == symbol), (tag if state and seen in on else None)

    return range(2), step


def _emit(symbol: int, tag: str):
    return range(1), lambda state, seen: (0, tag if seen == symbol else None)


def _threat():
    """A threat before its target, or its target before what is done to it: states (words left of the threat, of the target)."""
    def step(state: tuple[int, int], seen: int) -> tuple[tuple[int, int], str | None]:
        after, before = state
        hit = (after and seen == TARGET) or (before and seen == THREATENED_BY)
        return (THREAT_REACH if seen == THREAT else max(0, after - 1), REACH if seen == TARGET else max(0, before - 1)), ("threat" if hit else None)

    return list(product(range(THREAT_REACH + 1), range(REACH + 1))), step


def _negation():
    """Negated are insults and targets that a negation reaches, and the target of a threat that it reaches: states (words left of the negation, of the negated threat)."""
    def step(state: tuple[int, int], seen: int) -> tuple[tuple[int, int], str | None]:
        near, held = state
        hit = (near and seen in (INSULT, TARGET, THREATENED_BY)) or (held and seen == TARGET)
        return (REACH if seen == NEGATION else max(0, near - 1), THREAT_REACH if near and seen == THREAT else 0 if seen == THREAT else max(0, held - 1)), ("negated" if hit else None)

    return list(product(range(REACH + 1), range(THREAT_REACH + 1))), step


MACHINES = {
    "insult": _emit(INSULT, "insult"),
    "target": _countdown(TARGET, "targeted", (INSULT,)),
    "threat": _threat(),
    "negation": _negation(),
    "report": _sticky(REPORT, "reported", (INSULT, TARGET, THREATENED_BY)),
}
FRAMES = ("plain", "targeted", "negated", "reported")


def compose(machines: dict = MACHINES) -> tuple[list[list[int]], list[list[frozenset]]]:
    """The product machine: next state and emitted tags, by state and symbol; state 0 is the start."""
    states = list(product(*[m[0] for m in machines.values()]))
    index = {s: i for i, s in enumerate(states)}
    steps = [m[1] for m in machines.values()]
    goto, tags = [], []
    for s in states:
        rows = [[f(x, symbol) for f, x in zip(steps, s)] for symbol in range(7)]
        goto.append([index[tuple(x for x, _ in row)] for row in rows])
        tags.append([frozenset(t for _, t in row if t) for row in rows])
    return goto, tags


GOTO, TAGS = compose()


def frame(tags: frozenset) -> str | None:
    """The frame of a match; None without one."""
    if "insult" not in tags and "threat" not in tags:
        return None
    return next((f for f in ("reported", "negated", "targeted") if f in tags), "plain")


@dataclass
class Grammar:
    keys: np.ndarray  # sorted hashes of words and stems
    classes: np.ndarray
    weights: np.ndarray
    frames: dict[str, float]
    coefficients: np.ndarray  # of intercept, strongest clause, log of the total


def _closed() -> dict[int, tuple[int, float]]:
    made = {}
    for kind, text in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREATENED_BY, THREATENED), (THREAT, THREATS)):
        for w in text.split():
            b = np.frombuffer(w.encode(), np.uint8)
            starts, ends, _ = word_spans(b, np.array([0, len(b)]), ALNUM)
            if len(starts) == 1:
                made[int(spans_from(running_hash(b), starts, ends)[0])] = (kind, THREAT_WEIGHT if kind in (THREAT, THREATENED_BY) else 0.0)
    return made


def _terms(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(starts, ends, row, [hashes of words, then of each stem], [words that have it])."""
    starts, ends, row = word_spans(b, o, ALNUM)
    total = running_hash(b)
    hashes, held = [spans_from(total, starts, ends)], [np.arange(len(starts))]
    for n in STEM_BYTES:
        long = np.flatnonzero(ends - starts >= n)
        hashes.append(mix(spans_from(total, starts[long], starts[long] + n) + _STEM_SALT[n]))
        held.append(long)
    return starts, ends, row, hashes, held


def _classify(grammar: Grammar, hashes: list, held: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    kinds, weights = np.zeros(n, np.int8), np.zeros(n)
    for h, words in zip(hashes, held):
        at = find_sorted(grammar.keys, h)
        hit = np.flatnonzero(at >= 0)
        better = hit[(grammar.weights[at[hit]] > weights[words[hit]]) | (kinds[words[hit]] == OTHER)]
        kinds[words[better]], weights[words[better]] = grammar.classes[at[better]], grammar.weights[at[better]]
    return kinds, weights


def matches(grammar: Grammar, b: np.ndarray, o: np.ndarray) -> list[tuple[int, int, int, int, str, float]]:
    """(row, clause, start, end, frame, weight before the frame's) of each match in lower-cased bytes."""
    starts, ends, row, hashes, held = _terms(b, o)
    kinds, weights = _classify(grammar, hashes, held, len(starts))
    stops = np.concatenate([[0], np.cumsum(_CLAUSE_END[b])])
    clause = stops[starts]
    new = np.concatenate([[True], (clause[1:] != clause[:-1]) | (row[1:] != row[:-1])]) if len(starts) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(starts))
    found = []
    for c in np.unique(number[np.isin(kinds, (INSULT, THREAT, THREATENED_BY))]).tolist():
        state, pending = 0, 0.0
        for i in range(first[c], first[c + 1]):
            kind = int(kinds[i])
            if kind == THREAT:
                pending = float(weights[i])
            tags = TAGS[state][kind]
            if tags and (f := frame(tags)):
                found.append((int(row[i]), c, int(starts[i]), int(ends[i]), f, float(weights[i]) if kind in (INSULT, THREATENED_BY) else pending))
            state = GOTO[state][kind]
    return found


def features(grammar: Grammar, b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """rows x (1, strongest clause, log of 1 + total)."""
    rows = len(o) - 1
    clauses: dict[tuple[int, int], float] = {}
    for row, clause, _, _, f, weight in matches(grammar, b, o):
        clauses[row, clause] = clauses.get((row, clause), 0.0) + weight * grammar.frames[f]
    x = np.zeros((rows, 3))
    x[:, 0] = 1
    for (row, _), s in clauses.items():
        x[row, 1] = max(x[row, 1], min(s, 12.0))
        x[row, 2] += s
    x[:, 2] = np.log1p(np.maximum(0, x[:, 2]))
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept."""
    c = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ c)
    return c


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """(text, y) of about per_label texts of each label, by a hash threshold per label."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("y"))
    chosen = hash_sample(known, F.col("y"), F.col("sample_id"), per_label)
    mine = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mine.join(F.broadcast(chosen), F.col(id_col) == F.col("sample_id")).select("text", "y")  # about 2 * per_label rows


def fit(sample: DataFrame) -> Grammar:
    """Learns lexicon, frame weights and calibration from (text, y)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = string_buffers(batch.column(0))
            for i, _, b, o in chunks(lower_latin(buf), off):
                _, _, row, hashes, held = _terms(b, o)
                key, rows = np.concatenate(hashes), np.concatenate([row[w] for w in held])
                order = np.lexsort((rows, key))
                key, rows = key[order], rows[order]
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])]) if len(key) else np.zeros(0, bool)
                key, toxic = key[once], y[i + rows[once]]
                keys, which = np.unique(key, return_inverse=True)
                pos = np.bincount(which, toxic, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(np.bincount(which, minlength=len(keys)) - pos)], ["key", "pos", "neg"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    least = max(MIN_TEXTS, MIN_SHARE * n_pos)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    sums = mapped(sample, count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = sums.where(F.col("pos") >= least).withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("neg") <= MAX_CLEAN_SHARE * n_neg)).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, odds_found, pos = keys[order], found["odds"].to_numpy(float)[order], found["pos"].to_numpy(np.int64)[order]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(candidate, hash of the word before): copies of a text repeat a context, an insult has many."""
        for batch in batches:
            buf, off = string_buffers(batch.column(0))
            for _, _, b, o in chunks(lower_latin(buf), off):
                _, _, row, hashes, held = _terms(b, o)
                before = np.concatenate([[np.uint64(0)], hashes[0][:-1]])
                before[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]] = 0
                for h, words in zip(hashes, held):
                    at = find_sorted(keys, h)
                    hit = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(at[hit].astype(np.int64)), pa.array(before[words[hit]].view(np.int64))], ["term", "before"])

    kept = np.zeros(len(keys), bool)
    if len(keys):
        spread = mapped(sample.where("y = 1").select("text"), contexts, "term long, before long").groupBy("term").agg(F.count_distinct("before").alias("n")).toPandas()
        at = spread["term"].to_numpy(np.int64)
        kept[at] = spread["n"].to_numpy(np.int64) >= np.maximum(least, 0.25 * pos[at])
    lexicon = _closed() | {int(k): (INSULT, float(w)) for k, w in zip(keys[kept], odds_found[kept])}
    ordered = sorted(lexicon)
    grammar = Grammar(np.array(ordered, np.uint64), np.array([lexicon[k][0] for k in ordered], np.int8), np.array([lexicon[k][1] for k in ordered]), {f: 1.0 for f in FRAMES}, np.zeros(3))

    def threats_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The label of each text with a threat."""
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = string_buffers(batch.column(0))
            for i, _, b, o in chunks(lower_latin(buf), off):
                yield pa.RecordBatch.from_arrays([pa.array(y[i + np.array(sorted({h[0] for h in matches(threats, b, o)}), int)], pa.int32())], ["y"])

    is_threat = np.isin(grammar.classes, (THREAT, THREATENED_BY))
    closed = np.isin(grammar.classes, (INSULT,), invert=True)
    threats = Grammar(grammar.keys[closed], grammar.classes[closed], grammar.weights[closed], grammar.frames, grammar.coefficients)
    said = mapped(sample, threats_in, "y int").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    usual = float(odds_found[kept].mean()) if kept.any() else THREAT_WEIGHT
    pos_seen, neg_seen = said["pos"] or 0, said["n"] - (said["pos"] or 0)
    own = np.log((pos_seen + 0.5) / (n_pos + 1)) - np.log((neg_seen + 0.5) / (n_neg + 1))
    grammar.weights[is_threat] = max(0.0, (THREAT_PRIOR * usual + said["n"] * own) / (THREAT_PRIOR + said["n"]))

    def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = string_buffers(batch.column(0))
            for i, _, b, o in chunks(lower_latin(buf), off):
                hits = matches(grammar, b, o)
                yield pa.RecordBatch.from_arrays([pa.array([h[4] for h in hits], pa.string()), pa.array([int(y[i + h[0]]) for h in hits], pa.int32())], ["frame", "y"])

    # A frame's weight: the share of its matches that are in toxic texts, with a prior worth ten matches.
    prior = {"plain": 1.0, "targeted": 1.0, "negated": 0.4, "reported": 0.5}
    seen = {r["frame"]: r for r in mapped(sample, frames_of, "frame string, y int").groupBy("frame").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    for f in FRAMES:
        n, toxic = (seen[f]["n"], seen[f]["pos"]) if f in seen else (0, 0)
        grammar.frames[f] = (10 * prior[f] + toxic) / (10 + n)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = string_buffers(batch.column(0))
            for i, j, b, o in chunks(lower_latin(buf), off):
                x = features(grammar, b, o)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1).slice(i, j - i)], ["a", "b", "y"])

    rows = mapped(sample, measured, "a double, b double, y int").toPandas().sort_values(["a", "b", "y"])
    x = np.column_stack([np.ones(len(rows)), rows["a"], rows["b"]]) if len(rows) else np.zeros((0, 3))
    grammar.coefficients = logistic(x, rows["y"].to_numpy(float)) if n_pos and n_neg else np.array([-4.0, 1.0, 1.0])
    return grammar


def score(documents: DataFrame, grammar: Grammar, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns, score, and the matched spans (start and end in bytes, frame, weight)."""
    shared = documents.sparkSession.sparkContext.broadcast(grammar)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("frame", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            buf, off = string_buffers(batch.column(batch.num_columns - 1))
            for i, j, b, o in chunks(buf, off):
                b = lower_latin(b)
                x = features(grammar, b, o)
                spans: list[list] = [[] for _ in range(j - i)]
                for row, _, start, end, f, weight in matches(grammar, b, o) if (x[:, 1] > 0).any() else []:
                    spans[row].append({"start": start - int(o[row]), "end": end - int(o[row]), "frame": f, "weight": weight * grammar.frames[f]})
                own = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-np.clip(x @ grammar.coefficients, -30, 30)))), pa.array(spans, span)], [*columns, "score", "spans"])

    return mapped(documents.select(*columns, text_col), run, with_fields(documents, columns, "score double, spans array<struct<start:bigint,end:bigint,frame:string,weight:double>>"))


def detect(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0, per_label: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted, spans.

    Null and empty texts hold no match and score as such; without labels of both kinds the fixed lists alone
    speak; texts of any length are read whole; rows are answered one by one, repeats alike; an empty table gives an
    empty result; other columns are ignored.
    """
    held_out = fold(F.col(id_col), folds) == held_out_fold
    sample = stored(labelled_sample(documents.where(~held_out), labels.where(~held_out), label_col, id_col, text_col, per_label), "toxicity-sample")
    found = score(documents, fit(sample), [id_col], text_col)
    return found.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
