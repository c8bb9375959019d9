"""The best texts of a shard by how many words of a question they hold, for all questions at once."""

from __future__ import annotations

import numpy as np

#: Rows and questions whose scores are in memory at once.
ROW_BLOCK, QUESTION_BLOCK = 2048, 2048
#: A word goes into the matrix product if more than one pair of row and question in so many has it; others are added up hit by hit.
DENSE_PAIRS = 200


def held_words(texts: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word number) of each word that is part of a text, once, by row.

    Words are of three bytes or more and have no white space, so each lies in one token of a text, and the words in a
    token are looked up once however many texts have it.
    """
    lengths: dict[bytes, set[int]] = {}
    for w in number:
        lengths.setdefault(w[:3], set()).add(len(w))
    seen: dict[bytes, int] = {}
    mine = [[seen.setdefault(t, len(seen)) for t in set(text.split())] for text in texts]
    inside = [{number[p] for i in range(len(t) - 2) for n in lengths.get(t[i : i + 3], ()) if (p := t[i : i + n]) in number} for t in seen]
    size = np.fromiter(map(len, inside), np.int64, len(inside))
    words = np.fromiter((w for found in inside for w in found), np.int64, int(size.sum()))
    token = np.fromiter((t for found in mine for t in found), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(found) for found in mine])
    at = _spans((np.cumsum(size) - size)[token], size[token])
    hits = np.sort(np.repeat(row, size[token]) * max(len(number), 1) + words[at])
    return np.divmod(hits[np.concatenate([[True], hits[1:] != hits[:-1]])] if len(hits) else hits, max(len(number), 1))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. of spans of these sizes, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def best_rows(texts: list[bytes], questions: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of the k texts that hold most words of each question, repeats counted, of equal ones the first.

    Scores of a block of rows and questions are one product of frequent words, exact in whole numbers, plus single hits of
    the others; memory does not grow with either side beyond the hits of the texts.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(w for words in questions for w in words))}
    row, word = held_words(texts, number)
    n, m = len(texts), len(number)
    asked = np.fromiter((q * max(m, 1) + number[w] for q, words in enumerate(questions) for w in words), np.int64)
    asked, times = np.unique(asked, return_counts=True)
    of, needs = np.divmod(asked, max(m, 1))
    often = np.bincount(word, minlength=m).astype(float) * np.bincount(needs, minlength=m)
    column = np.full(m, -1)
    dense = np.flatnonzero(often * DENSE_PAIRS > n * len(questions))
    column[dense] = np.arange(len(dense))
    starts = np.searchsorted(row, np.arange(0, n + ROW_BLOCK, ROW_BLOCK))
    out = []
    for low in range(0, len(questions), QUESTION_BLOCK):
        high = min(low + QUESTION_BLOCK, len(questions))
        part = slice(*np.searchsorted(of, [low, high]))
        q, w, t = of[part] - low, needs[part], times[part]
        wanted = np.zeros((high - low, len(dense)), np.float32)
        wanted[q[column[w] >= 0], column[w][column[w] >= 0]] = t[column[w] >= 0]
        order = np.argsort(w, kind="stable")
        q, t, count = q[order], t[order], np.bincount(w, minlength=m)
        first = np.cumsum(count) - count
        best = np.full((high - low, k), -1, np.int64)  # score * n + places after it, so that of equal scores the first row is larger
        for block, begin in enumerate(range(0, n, ROW_BLOCK)):
            rows = min(ROW_BLOCK, n - begin)
            r, v = row[starts[block] : starts[block + 1]] - begin, word[starts[block] : starts[block + 1]]
            thick = column[v] >= 0
            has = np.zeros((rows, len(dense)), np.float32)
            has[r[thick], column[v[thick]]] = 1
            score = wanted @ has.T
            r, v = r[~thick], v[~thick]
            at = _spans(first[v], count[v])
            if len(at):
                score += np.bincount(q[at] * rows + np.repeat(r, count[v]), t[at], score.size).reshape(score.shape).astype(np.float32)
            better = np.flatnonzero(score.max(1) > np.maximum(best.min(1), 0) // n)
            if len(better):
                keys = score[better].astype(np.int64) * n + (n - 1 - begin - np.arange(rows))
                top = np.partition(keys, -k, axis=1)[:, -k:] if rows > k else keys
                best[better] = np.partition(np.concatenate([best[better], top], 1), -k, axis=1)[:, -k:]
        i, j = np.nonzero(best >= n)
        out.append((i + low, n - 1 - best[i, j] % n, best[i, j] // n))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
