"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Pieces are dealt by hash into blocks of about BLOCK pieces; each block is packed on its own, which costs at
most one partly filled sequence a block. In a block the best-fit solution is the first incumbent, and a lower
bound says whether it can be improved. If so, bin completion searches: the largest piece left opens a sequence,
the undominated fillings around it are tried in order of their waste, and a branch ends where its waste so far
leaves no room for fewer sequences than the incumbent has.
"""

from __future__ import annotations

import string
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import AT_END, mapped, ship, stored
from .textarrays import chunks, string_buffers
from .wordcache import WordCache

LENGTH = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
BLOCK = 4000
#: Steps of the search for each piece of a block. Bin packing is NP-hard: when they are used up the incumbent stands,
#: which is never worse than best fit; a higher limit never gives more sequences.
EFFORT = 150
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
_caches: dict[str, WordCache] = {}
AT_END.append(_caches.clear)  # a tokeniser is read again in an eighth of a second


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cache(path: str) -> WordCache:
    if path not in _caches:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # Words of printable Latin-1 need no normalising beyond lower case: their parts go to the merges directly.
        plain = regex.compile(r"[!-~¡-ÿ]+")
        part = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)})
        merges, marks = tokenizer.model.tokenize, string.punctuation.encode()

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def encode(words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
            parts: dict[bytes, bytes] = {}

            def merged(p: bytes) -> bytes:
                if (held := parts.get(p) or known.get(p)) is None:
                    held = parts[p] = packed([t.id for t in merges(p.decode() if p.isascii() else p.decode("latin-1").translate(shown))])
                return held

            out = []
            for word in words:
                if word.isascii() and (core := word.rstrip(marks)).isalpha() and core.islower():
                    out.append(merged(core) if len(core) == len(word) else merged(core) + merged(word[len(core) :]))
                    continue
                text = word.decode()
                if "<|" in text or not plain.fullmatch(text):
                    out.append(packed(tokenizer.encode(text, add_special_tokens=False).ids))
                elif text.isalpha():
                    out.append(merged(text.lower().encode()))
                else:
                    out.append(b"".join([merged(p.encode()) for p in part.findall(text.lower())]))
            return out

        _caches[path] = WordCache(encode)
    return _caches[path]


def split_words(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased where that cannot touch a special token: no token joins two words."""
    if b"<|" in text:
        return [w if b"<|" in w else w.lower() for w in text.split()]
    return text.lower().split()


def tokenise(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit) if kept."""
    path = path or vocabulary_path(VOCABULARY)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _cache(path)
        for batch in batches:
            buf, off = string_buffers(batch.column(1))
            for i, j, b, o in chunks(buf, off):
                texts = [split_words(b[x:y].tobytes()) for x, y in zip(o[:-1], o[1:])]
                row, piece, start, size, crc, kept = [], [], [], [], [], []
                for r, ids in enumerate(cache.ids(texts)):
                    ids += END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        row.append(i + r), piece.append(k), start.append(at // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary())), names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(documents.select(id_col, text_col), run, PIECES.format(id=kind) + ", ids binary" * keep_ids)


def lower_bound(sizes: list[int], room: int) -> int:
    """Martello and Toth's bound: pieces over half a sequence and those that fit beside none of them."""
    s = np.sort(np.asarray(sizes, np.int64))[::-1]
    best = -(-int(s.sum()) // room)
    total = np.concatenate([[0], np.cumsum(s)])
    over = int(np.searchsorted(-s, -room / 2, "left"))  # pieces over half
    for k in np.unique(s[s <= room / 2]):
        alone = int(np.searchsorted(-s, -(room - k), "left"))
        end = int(np.searchsorted(-s, -k, "right"))
        spare = (over - alone) * room - int(total[over] - total[alone])
        best = max(best, over + max(0, -(-(int(total[end] - total[over]) - spare) // room)))
    return max(best, over)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where it leaves least."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect_left(free, (s, -1))
        if k == len(free):
            left, at = room, len(bins)
            bins.append([])
        else:
            left, at = free.pop(k)
        bins[at].append(s)
        if left > s:
            insort(free, (left - s, at))
    return bins


def _exact(counts: dict[int, int], sizes: list[int], room: int, work: list[int]) -> list[int] | None:
    """A filling without waste by large pieces first, if one is found at once."""
    chosen: list[int] = []
    left = room
    taken: Counter = Counter()
    while left:
        if counts.get(left, 0) > taken[left]:
            return [*chosen, left]
        k = bisect_right(sizes, left)
        best = 0
        while k:
            k -= 1
            s = sizes[k]
            work[0] -= 1
            if counts[s] > taken[s]:
                best = best or s
                rest = left - s
                if rest > s or k + 60 < bisect_right(sizes, left):
                    break
                if counts.get(rest, 0) > taken[rest] + (rest == s):
                    return [*chosen, s, rest]
        if not best:
            return None
        chosen.append(best)
        taken[best] += 1
        left -= best
    return chosen


def fillings(counts: dict[int, int], room: int, most_waste: int, work: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(waste, filling) of the undominated fillings of room that waste at most that much, the least waste first.

    A filling is dominated if a piece that is left out could replace some of its pieces without wasting more: the
    smaller pieces it sets free are then as good anywhere else. For each waste, fillings of large pieces come first;
    the first of all cannot be dominated. work[0]: steps left, of which sums, fillings and comparisons use some.
    """
    ascending = sorted(s for s in counts if s <= room)
    if quick := _exact(counts, ascending, room, work):
        yield 0, quick
    sizes = ascending[::-1]
    whole = (1 << (room + 1)) - 1
    reach = [1]  # bit t: some of the sizes from here on add up to t
    for s in ascending:
        bits, n, k = reach[-1], min(counts[s], room // s), 1
        while n:
            k = min(k, n)
            bits |= (bits << (s * k)) & whole
            n -= k
            k *= 2
        reach.append(bits)
    reach.reverse()
    work[0] -= len(sizes)
    first = quick is None

    def dominated(chosen: list[int], waste: int) -> bool:
        sums = 1
        for s in chosen:
            sums |= sums << s
        used = Counter(chosen)
        for x in sizes:
            if counts[x] > used[x]:
                low = max(1, x - waste)
                others = sums
                if used[x]:  # the sum x by the piece x itself is no exchange
                    others = 1
                    for s in chosen:
                        if s != x:
                            others |= others << s
                if (others >> low) & ((1 << (x - low + 1)) - 1):
                    return True
        return False

    for waste in range(0, min(most_waste, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        stack: list[tuple[int, int, list[int]]] = [(0, room - waste, [])]
        while stack and work[0] > 0:
            work[0] -= 1
            k, left, chosen = stack.pop()
            if not left:
                if first or (chosen != quick and not dominated(chosen, waste)):
                    yield waste, chosen
                work[0] -= 0 if first else len(sizes)
                first = False
                continue
            while sizes[k] > left:
                k += 1
            s = sizes[k]
            for n in range(0, min(counts[s], left // s) + 1):  # the most of the larger piece is looked at first
                if reach[k + 1] >> (left - n * s) & 1:
                    stack.append((k + 1, left - n * s, [*chosen, *[s] * n]))


def complete_bins(sizes: list[int], room: int, effort: int = EFFORT) -> list[list[int]]:
    """The pieces' sizes in sequences: the best solution that the search finds."""
    best = best_fit(sizes, room)
    bound = lower_bound(sizes, room)
    total, work = sum(sizes), [effort * len(sizes)]
    counts = {s: n for s, n in sorted(Counter(sizes).items())}
    done: list[list[int]] = []  # the sequences of the branch at hand
    tries: list[Iterator[tuple[int, list[int]]]] = []
    wasted = [0]

    def take(pieces: list[int]) -> None:
        for s in pieces:
            counts[s] -= 1
            if not counts[s]:
                del counts[s]

    def give(pieces: list[int]) -> None:
        for s in pieces:
            counts[s] = counts.get(s, 0) + 1

    def opened() -> Iterator[tuple[int, list[int]]]:
        first = max(counts)
        take([first])
        done.append([first])
        spare = (len(best) - 1) * room - total - wasted[-1]  # waste that fewer sequences than the incumbent allow
        return fillings(counts, room - first, spare, work) if spare >= 0 else iter(())

    if len(best) > bound and sizes:
        tries.append(opened())
    while tries:
        if len(wasted) > len(tries):  # the filling tried before
            give(done[-1][1:])
            del done[-1][1:]
            wasted.pop()
        step = next(tries[-1], None) if work[0] > 0 and len(best) > bound else None
        if step is None or wasted[-1] + step[0] > (len(best) - 1) * room - total:
            tries.pop()
            give(done.pop())
            continue
        take(step[1])
        done[-1] += step[1]
        wasted.append(wasted[-1] + step[0])
        if counts:
            tries.append(opened())
        elif len(done) < len(best):
            best = [list(x) for x in done]
    return best


def pack_sizes(lengths: np.ndarray, room: int = LENGTH, effort: int = EFFORT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    order = np.argsort(lengths, kind="stable")
    values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
    waiting = {int(v): list(order[f : f + c]) for v, f, c in zip(values, first, n)}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = sum(1 for x in lengths if x == room)
    bins = [[room]] * full + complete_bins([int(x) for x in lengths if x < room], room, effort)
    for number, pieces in enumerate(bins):
        at = 0
        for s in pieces:
            i = waiting[s].pop()
            sequence[i], offset[i] = number, at
            at += s
    return sequence, offset


def pack(pieces: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows with a column length (at most the sequence length).

    Rows that are alike are counted, numbered and then dealt to blocks by hash, so that the result depends on the
    rows alone and no block is large.
    """
    columns = list(pieces.columns)
    blocks = max(1, -(-pieces.count() // block))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    alike = pieces.groupBy(*columns).agg(F.count("*").alias("alike"))
    numbered = alike.select(*columns, F.explode(F.sequence(F.lit(1), F.col("alike").cast("int"))).alias("copy"))
    dealt = numbered.withColumn("place", F.xxhash64(*[F.col(c) for c in columns], "copy")).withColumn("block", F.pmod("place", F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("place", "ascending")])
        sequence, offset = pack_sizes(table["length"].to_numpy(), length)
        number = table["block"][0].as_py()
        return table.select(columns).append_column("sequence_id", pa.array(sequence + (number << 32))).append_column("offset", pa.array(offset))

    ship(pieces.sparkSession)
    return dealt.groupBy("block").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; longer documents, however long, are cut into full sequences and a
    rest; pieces of equal length are interchangeable and go in order of a hash; repeated rows are packed one by
    one; an empty table gives an empty result; other columns are ignored.
    """
    return pack(stored(tokenise(documents, id_col, text_col, path, length), "pieces"), length)
