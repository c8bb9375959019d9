"""Brute-force versions and awkward inputs for the operator tests."""

import math
import re
from collections import Counter, defaultdict

WORD9 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def lower_ascii(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeats, ties and columns whose names clash with inner ones."""
    prose = "the of and in to erthan onble thion anre. heerou ined that for with on ater ening shou wherea, and the thing of ent rean "
    rows = [
        (1, prose * 3, "en", "src0", 10), (2, prose * 3, "en", "src0", 10), (2, prose * 3, "en", "src0", 10), (None, prose + "x", None, None, None), (3, None, "en", "src1", None),
        (4, "", "de", None, 0), (5, " \n\t ", "fr", "src1", 3), (6, "123 !!! 456", "es", "src2", 11), (7, prose * 2000, "en", "src0", 1), (8, "idiot", "en", "src0", 5), (9, "a", None, "src3", 1),
        (10, "été naïve ПРИВЕТ 漢字 \U0001f600", "fr", "src4", 1), (11, prose.upper(), "en", "src0", 1), (12, "\x00\x01 odd", "en", "src0", 1), (12, "other text with the same id", "en", "src0", 1),
    ]
    names = "score node key row text_a hash piece ws n label word size bucket kept_row held_out lang_pred evidence host path doc src base".split()
    extra = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")


def shingles(text, k=5):
    ws = [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "") if w]
    ws = [lower_latin(w) for w in ws]
    return [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []


def lower_latin(word):
    return "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in word)


def near_duplicate_classes(docs, threshold=0.8, rare=1e-3):
    """doc_id -> least id of its class, by weighted Jaccard similarity of all pairs that share a shingle."""
    df, bags = Counter(), {}
    for i, text in docs.items():
        ws = {w for s in shingles(text, 1) for w in s}
        df.update(ws)
    n = len(docs)
    idf = lambda w: min(1, max(0, math.log(n / df[w]) / math.log(1 / rare))) if df[w] >= max(2, rare * n) else 1.0
    inverted = defaultdict(list)
    for i, text in docs.items():
        bags[i] = {s: c * (1 + sum(map(idf, s)) / len(s)) for s, c in Counter(shingles(text)).items()}
        for s in bags[i]:
            inverted[s].append(i)
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for ids in inverted.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        low = sum(min(w, bags[b][s]) for s, w in bags[a].items() if s in bags[b])
        if low / (sum(bags[a].values()) + sum(bags[b].values()) - low) >= threshold:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in docs}


def contaminated(docs, items, window=10):
    wins = set()
    for text in items:
        ws = WORD9.findall(lower_ascii(text))
        wins |= {tuple(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1))} if ws else set()
    sizes = {len(w) for w in wins}
    bad = set()
    for i, text in docs.items():
        ws = WORD9.findall(lower_ascii(text))
        if any(tuple(ws[j : j + n]) in wins for n in sizes for j in range(len(ws) - n + 1)):
            bad.add(i)
    return bad


def whole_text_verdicts(docs, groups, model, floors, width=4.0, bins=2, spans=(0, 1, 3), least=50):
    """doc_id -> (tokens, kept) of the fertility rules, from ids of whole texts and sorted lists."""
    rows = {}
    for i, text in docs.items():
        text = text or ""
        ws = SPACED.findall(text)
        seen = Counter(tuple(ws[j : j + 8]) for j in range(len(ws) - 7))
        again = {q for j in range(len(ws) - 7) if seen[tuple(ws[j : j + 8])] > 1 for q in range(j, j + 8)}
        ids = model.encode(text)
        n = len(ids)
        spread = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        measures = (sum(map(len, ws)) / n, sum(map(model.is_byte, ids)) / n, spread / max(1.0, math.log2(n))) if n else None
        rows[i] = (n, len(ws) < 20 or 100 * len(again) > 30 * len(ws), measures, groups[i])
    usable = [r for r in rows.values() if r[0] and not r[1]]
    xs = [math.log2(r[0]) for r in usable]
    mean = lambda v: sum(v) / len(v)
    slopes = []
    for m in range(3):
        ys = [r[2][m] for r in usable]
        slopes.append(sum((x - mean(xs)) * (y - mean(ys)) for x, y in zip(xs, ys)) / sum((x - mean(xs)) ** 2 for x in xs))
    level = lambda r, m: r[2][m] - slopes[m] * math.log2(r[0])
    bin_of = lambda r: math.floor(bins * math.log2(r[0]))
    rank = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    out = {}
    for i, r in rows.items():
        kept = not r[1]
        if kept and r[0]:
            near = [[x for x in usable if x[3] == r[3] and abs(bin_of(x) - bin_of(r)) <= s] for s in spans] + [[x for x in usable if x[3] == r[3]], usable]
            chosen = next((x for x in near if len(x) >= least), None)
            for m, (low, high) in enumerate([(True, True), (False, True), (True, False)] if chosen else []):
                v = [level(x, m) for x in chosen]
                off = (level(r, m) - rank(v, 0.5)) / max((rank(v, 0.75) - rank(v, 0.25)) / 1.349, floors[m])
                kept = kept and not (low and off < -width) and not (high and off > width)
        out[i] = (r[0], kept)
    return out


def suffix_tree_scores(docs, spelling, held, frequent=1e-6, smooth=4.0, least_g=20.0):
    """doc_id -> log10 probability under contexts of none, one and two words; spelling(word): log10 of its spelled probability."""
    tokens = {i: SPACED.findall(lower_ascii(t)) for i, t in docs.items()}
    train = [tokens[i] for i in docs if not held(i)]
    count = Counter(w for ws in train for w in ws)
    n_words, texts = sum(count.values()), len(train)
    often = {w for w, c in count.items() if c >= max(2, frequent * n_words)}
    symbols = lambda ws: ["<s>", *[w if w in often else "<rare>" for w in ws], "</s>"]
    single = Counter(s for ws in train for s in symbols(ws))
    z = n_words + texts + 2
    p0 = lambda s: (single[s] + (s in ("<rare>", "</s>"))) / z
    pairs, triples = Counter(), Counter()
    for ws in train:
        s = symbols(ws)
        pairs.update(zip(s, s[1:]))
        triples.update(zip(s, s[1:], s[2:]))
    kept1 = {k: c for k, c in pairs.items() if c >= 2 and 2 * c * math.log(c / (single[k[0]] * p0(k[1]))) >= least_g}
    mass1 = Counter()
    for (u, _), c in kept1.items():
        mass1[u] += c
    p1 = lambda u, w: (kept1.get((u, w), 0) + (single[u] - mass1[u] + smooth) * p0(w)) / (single[u] + smooth)
    kept2 = {k: c for k, c in triples.items() if c >= 2 and k[:2] in kept1 and 2 * c * math.log(c / (kept1[k[:2]] * p1(k[1], k[2]))) >= least_g}
    mass2 = Counter()
    for k, c in kept2.items():
        mass2[k[:2]] += c

    def p2(t, u, w):
        if (t, u) not in mass2:
            return p1(u, w)
        n = kept1[t, u]
        return (kept2.get((t, u, w), 0) + (n - mass2[t, u] + smooth) * p1(u, w)) / (n + smooth)

    rare_tokens, rare_types = n_words - sum(count[w] for w in often), len(count) - len(often)
    out = {}
    for i, ws in tokens.items():
        s = symbols(ws)
        total = sum(math.log10(p2(s[k - 2] if k > 1 else None, s[k - 1], s[k])) for k in range(1, len(s)))
        for w in ws:
            if w not in often:
                p = spelling(w)
                total += math.log10((count[w] + rare_types * 10**p) / (rare_tokens + rare_types)) if rare_types else p
        out[i] = total
    return out


def pack_exhaustively(sizes, room):
    """Least number of sequences, by trying all."""
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= room}.values():
            bins[k] += sizes[i]
            go(i + 1, bins)
            bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]
