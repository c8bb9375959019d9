"""Each operator against brute force or held-out labels, and on awkward inputs."""

import math
import os
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from lectern.llm import decontaminate, fertility, html_main, language, licenses, near_duplicates, packing, quality, queries, suffix_tree_lm, toxicity, wordcache

from tests.llm import helpers as H


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{H.SF}/documents.parquet").collect()}


def run(spark, name, sf=H.SF):
    return queries.queries()[name](spark, sf)


def test_every_operator_has_one_query():
    assert {re.match(r"op\d+", n)[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


def test_winnowing_and_licences_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{H.SF}/{t}.parquet'")
    for name in ("op9_decontaminate", "op4_license_scan"):
        ours = run(spark, name).toPandas()
        theirs = con.sql(queries.oracle_sql()[name]).df()[list(ours.columns)]
        rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
        assert rows(ours) == rows(theirs), name


def test_short_items_large_benchmarks_and_repeats(spark, monkeypatch):
    d = spark.createDataFrame([(1, "x A b C y"), (2, "a b"), (3, "la " * 40), (4, None), (5, "b c d e f g h i j k l m")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a B c"), (7, "a b c"), (8, "la " * 15), (9, ""), (None, "b c d e f g h i j k"), (10, None)], "item_id long, text string")
    want = {1: (5, 3, [7]), 2: (2, 0, []), 3: (40, 40, [8]), 4: (0, 0, []), 5: (12, 10, [])}
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", limit)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.decontaminate(d, b).collect()}
        assert got == want
    empty = decontaminate.decontaminate(d, b.limit(0)).collect()
    assert len(empty) == 5 and not any(r["contaminated"] for r in empty)


def test_licences_inside_longer_texts(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "mit" and "\n\n" in t)
    gpl3 = next(t for n, t in licenses.TEMPLATES if n == "gpl-3.0" and "\n\n" in t)
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(200))
    wrapped = "Some words of a readme. This project is licensed\nunder the MIT License. And more of it\nfollows here."
    rows = [(1, f"# Copyright someone\n\n{mit}\n\n{code}"), (2, f"{code}\n\n{gpl3}\n\n{code}"), (3, wrapped), (4, code), (5, None), (6, "a software licence is discussed here at some length"), (7, gpl3.replace("version 3", "version 2").replace("software:", "software;").replace("Foundation, either", "Foundation; either"))]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["mit"], 2: ["gpl-3.0"], 3: ["mit"], 4: [], 5: [], 6: [], 7: ["gpl-2.0"]}
    notices = spark.createDataFrame([(1, "Released under CC BY 4.0."), (2, "Available under CC BY-SA 4.0.")], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(notices).collect()} == {1: ["cc-by-4.0"], 2: ["cc-by-sa-4.0"]}
    every = [grams for _, grams in licenses.patterns(licenses.TEMPLATES)]
    wanted = licenses.cues(every)
    for grams in every:  # what a unit can lack of a template is less than what holds a cue
        assert sum(any(w in wanted for w in g.split(" ")) for g in grams) > len(grams) - len(grams) * licenses.THRESHOLD / (2 - licenses.THRESHOLD)


def test_near_duplicates_match_brute_force(spark, docs):
    want = H.near_duplicate_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op2_weighted_minhash").collect()}
    assert got == want


def test_members_of_classes_have_links(spark):
    rows = run(spark, "op2_weighted_minhash", "/root/testdata/sf0.01").collect()
    size = Counter(r["class_id"] for r in rows)
    assert all((r["n_links"] > 0) == (size[r["class_id"]] > 1) for r in rows) and max(size.values()) > 1


def test_groups_in_one_bucket_are_told_apart(spark):
    rng = np.random.default_rng(4)
    shared = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(12):  # groups share most of a text, members of a group nearly all
        own = [*shared, *[f"g{g}x{i}" for i in range(40)]]
        for m in range(6):
            at = int(rng.integers(0, len(own)))
            rows.append((g * 100 + m, " ".join([*own[:at], f"new{g}{m}", *own[at + 1 :]])))
    docs = dict(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.duplicate_classes(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()}
    assert got == H.near_duplicate_classes(docs)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.uniform(1, 3, 400), rng.uniform(1, 3, 400)
    estimates, exact = [], np.minimum(a, b).sum() / np.maximum(a, b).sum()
    for salt in range(40):
        k = np.sort(near_duplicates.mix(keys + np.uint64(salt)))
        x, y = (near_duplicates.sample(np.array([0]), k, w) for w in (a, b))
        estimates.append((x == y).mean())
    assert abs(np.mean(estimates) - exact) < 0.04


def test_star_of_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))] + [(i, " ".join([*words[: i * 9], f"new{i}", *words[i * 9 + 1 :]])) for i in range(1, 40)]
    got = near_duplicates.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["class_id"] for r in got.collect()} == {0}


def test_language_on_held_out_texts(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = run(spark, "op3_language_cnn", "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    net = language.train(windows, np.array([0, 1, 0, 1, 1]), ["a", "b"], epochs=1)
    got = language.log_probabilities(net, net.tables(), windows)
    e = net.embed[windows]
    pooled = [(language._unfold(e, w) @ k + b).max(1) for w, k, b in zip(language.WIDTHS, net.kernels, net.bias)]
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(got, want, atol=1e-4)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    rows = run(spark, "op5_best_fit_packing").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[i], key=lambda r: r["piece"])] == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_tokenising_by_words_is_exact_on_odd_texts():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path(packing.VOCABULARY)
    t = Tokenizer.from_file(path)
    odd = ["don't I'VE it's", "é é É ΣΑΣ İstanbul", "a b c　d", "<|endoftext|> x", "a<|endoftext|>b <|STARTOFTEXT|>q", "\x1c\x1d a\x85b", "ab12 3,4;;5 _x_", "ﬁ ½ K Å ª²³ µß÷×ÿÀÞ ­x\xa0y", "漢字かな \U0001f600\U0001f601", "\x00 a\x00b", "x'sy 'S it'LLs'd''t"]
    got = packing._cache(path).ids([packing.split_words(x.encode()) for x in odd])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_word_cache_keeps_what_is_in_use():
    cache = wordcache.WordCache(lambda ws, known: [w * 2 for w in ws], limit=3)
    for texts in ([[b"a", b"b"]], [[b"b", b"c", b"d"]], [[b"b", b"e"] * 3]):
        assert cache.ids(texts) == [b"".join(w * 2 for w in t) for t in texts]
        assert len(cache.known) <= 3
    cache.known.clear()


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 1500).astype(int) + 1)
    sequence, offset = packing.pack_sizes(lengths)
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) + 1 + (lengths > 1900).sum() // 8
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048


def test_bin_completion_is_exact_on_small_sets():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes = [int(x) for x in rng.integers(8, 70, rng.integers(1, 11))]
        best = H.pack_exhaustively(sizes, 100)
        bins = packing.complete_bins(sizes, 100, 100_000)
        assert sorted(sum(bins, [])) == sorted(sizes) and max(map(sum, bins)) <= 100 and len(bins) == best
        assert packing.lower_bound(sizes, 100) <= best


def test_more_search_never_gives_more_sequences():
    sizes = [int(x) for x in np.random.default_rng(3).integers(350, 760, 1500)]
    n = [len(packing.complete_bins(sizes, 2048, effort)) for effort in (0, 20, 150, 600)]
    assert n == sorted(n, reverse=True) and n[-1] < n[0]


def test_fillings_come_by_waste_and_none_is_dominated():
    counts = {50: 1, 30: 1, 20: 2, 10: 1, 7: 1}
    got = list(packing.fillings(dict(counts), 60, 60, [10**6]))
    assert got[0] == (0, [50, 10]) and [w for w, _ in got] == sorted(w for w, _ in got)
    assert (0, [20, 30, 10]) not in [(w, sorted(f)) for w, f in got]  # 50 could stand for 20 and 30


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20"))
    key = lambda r: tuple(r)
    one = sorted(map(key, packing.pack(packing.tokenise(docs), block=100).collect()))
    two = sorted(map(key, packing.pack(packing.tokenise(docs.repartition(7)), block=100).collect()))
    assert one == two


def test_suffix_tree_base_and_normalisation(spark, docs):
    rows = run(spark, "op6_suffix_tree_lm").collect()
    train, tokens = Counter(), {}
    for i, text in docs.items():
        tokens[i] = [*H.SPACED.findall(H.lower_ascii(text)), "\n"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0
    frame = spark.createDataFrame([("ab ab abc é",)] * 9, "text string")
    counts = frame.mapInArrow(suffix_tree_lm._count_partition, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    model = suffix_tree_lm.fit(counts)
    unseen = 256 - len(set(model.classes)) + 1
    p = 10.0 ** model.logp.astype(float)
    assert np.allclose(p[:, 1:].sum(1) + p[:, 0] * unseen, 1, atol=1e-4)
    known, new = suffix_tree_lm.word_logp(model, np.frombuffer(b"abzz", np.uint8), np.array([0, 2, 4]))
    assert known > new


@pytest.mark.parametrize("broadcast, frequent", [(1_000_000, 1e-6), (0, 1e-6), (1_000_000, 2e-4), (0, 2e-4)])
def test_suffix_tree_scores_match_brute_force(spark, docs, monkeypatch, broadcast, frequent):
    monkeypatch.setattr(suffix_tree_lm, "BROADCAST_GRAMS", broadcast)
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", frequent)
    table = spark.read.parquet(f"{H.SF}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = table.where(~F.col("doc_id").isin([i for i in docs if held(i)])).select("text")
    model = suffix_tree_lm.fit(train.mapInArrow(suffix_tree_lm._count_partition, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))

    def spelling(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return float(np.float32(suffix_tree_lm.word_logp(model, raw, np.array([0, len(raw)]))[0]))

    want = H.suffix_tree_scores(docs, spelling, held, frequent)
    for r in suffix_tree_lm.score(table).collect():
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-7), r["doc_id"]


def test_suffix_tree_joins_only_what_is_not_broadcast(spark, docs, monkeypatch):
    table, held = spark.read.parquet(f"{H.SF}/documents.parquet"), []
    want = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(table).collect()}

    def joined(documents, words, values, run=suffix_tree_lm.joined_values):
        held.append(values.count())
        return run(documents, words, values)

    monkeypatch.setattr(suffix_tree_lm, "joined_values", joined)
    for most in (0, 300):
        monkeypatch.setattr(suffix_tree_lm, "BROADCAST_GRAMS", most)
        got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(table).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in docs)
    assert 0 < held[0] - held[1] <= 300


def test_suffix_tree_keeps_little_with_the_driver(spark, docs, monkeypatch):
    """What is broadcast for a step goes with it, words are broadcast once, and bitmaps are sent compressed or not at all."""
    sent, live = [], []

    def broadcast(self, value, run=SparkContext.broadcast):
        out = run(self, value)
        sent.append((type(value), len(pickle.dumps(value)), out))
        live.append(sum(os.path.exists(x._path) for _, _, x in sent))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(suffix_tree_lm, "BROADCAST_GRAMS", 300)
    assert len(suffix_tree_lm.score(spark.read.parquet(f"{H.SF}/documents.parquet")).collect()) == len(docs)
    assert max(live) <= 3 and sum(os.path.exists(x._path) for _, _, x in sent) <= 3
    assert max(size for _, size, _ in sent) < 4 << 20


def test_kept_map_holds_every_key(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "GRAM_FLUSH", 1000)
    key = np.random.default_rng(5).integers(0, 1 << 62, 20_000)
    made = suffix_tree_lm.kept_map(spark.createDataFrame(pa.table({"key": np.append(key, key[:5000])})))
    bits = np.unique(suffix_tree_lm._bits(key.view(np.uint64)))
    others = np.random.default_rng(6).integers(0, 1 << 62, 200_000).view(np.uint64)
    assert made.likely(key.view(np.uint64)).all() and np.array_equal(made.likely(others), np.isin(suffix_tree_lm._bits(others), bits))
    assert not suffix_tree_lm.kept_map(spark.createDataFrame([], "key long")).likely(others).any()


def test_order_of_words_changes_the_score_and_known_texts_beat_the_base(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = suffix_tree_lm.score(table).collect()
    known = [r for r in rows if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    seen = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    line = "one two three four five six seven"
    texts = [(i, line) for i in range(20)] + [(100, " ".join(reversed(line.split())))]
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0] > got[100] + 1


def test_toxicity_finds_held_out_and_spares_clean(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in run(spark, "op1_toxicity_grammar", sf).where("held_out").collect() if r["doc_id"] in truth]
    hit = sum(r["predicted"] for r in rows if truth[r["doc_id"]])
    false = sum(r["predicted"] for r in rows if not truth[r["doc_id"]])
    toxic = sum(truth[r["doc_id"]] for r in rows)
    assert hit / toxic > 0.85 and false / (len(rows) - toxic) < 0.01


def test_grammar_frames():
    word = lambda kind: kind
    T = toxicity

    def frames(*symbols):
        state, out = 0, []
        for s in map(word, symbols):
            if f := T.frame(T.TAGS[state][s]):
                out.append(f)
            state = T.GOTO[state][s]
        return out

    assert frames(T.INSULT) == ["plain"]
    assert frames(T.TARGET, T.OTHER, T.INSULT) == ["targeted"]
    assert frames(T.TARGET, T.NEGATION, T.INSULT) == ["negated"]
    assert frames(T.NEGATION, T.OTHER, T.OTHER, T.OTHER, T.INSULT) == ["plain"]
    assert frames(T.REPORT, T.OTHER, T.TARGET, T.INSULT) == ["reported"]
    assert frames(T.THREAT, T.TARGET) == ["plain"] and frames(T.THREAT, T.OTHER) == []


def test_quality_follows_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in run(spark, "op7_quality_bayes", sf).where("held_out").collect() if r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in rows) / len(rows) > 0.97
    good = [r["kept"] for r in rows if truth[r["doc_id"]]]
    assert sum(good) / len(good) > 0.995


def test_sparse_sites_are_shrunk(spark):
    docs = spark.createDataFrame([(i, "plain words stand here " * 9 if i % 3 else "JUNK ### $$$ %%% " * 9, f"s{i % 4}", "en") for i in range(400)] + [(1000, "plain words stand here " * 9, "lone", "xx")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    rates = {r["host_rate"] for i, r in got.items() if i != 1000}
    assert min(rates) <= got[1000]["host_rate"] < 1 and abs(got[1000]["host_rate"] - 2 / 3) < 0.2 and got[1000]["good"]


def test_html_structures():
    cases = {
        "<body><div class='content'><p>One &amp; two</p><p>a<br>b</p></div><div class=comments><p>nice</p></div></body>": "One & two\na b",
        "<nav>x</nav><main><h1>T</h1><p>body text <a href=#>link</a></p><aside>no</aside><form>f</form></main><footer>c</footer>": "T\nbody text link",
        "<article><p>unclosed <b>bold<p>next<ul><li>i<li>ii</ul></article>": "unclosed bold\nnext\ni\nii",
        "plain &lt; text": "plain < text", "": "", "<p>": "", "<script>a</script>": "", "<!-- <p>x</p> -->y": "y", "<div hidden>h</div><p>s": "s", "a < b": "a < b",
    }
    for page, want in cases.items():
        assert html_main.extract(html_main.parse(page), []) == want, page


def test_html_unwanted_elements_without_end_tags():
    cases = {
        "<article><p class=notice>ad<p>one<p>two</article>": "one\ntwo",
        "<article><ul><li class=ad>ad<li>one<li>two</ul><p>three</article>": "one\ntwo\nthree",
        "<main><table><tr class=promo><td>ad<tr><td>one<td class=ad>ad<td>two</table></main>": "one\ntwo",
        "<main><div class=content><p>one</p><div class=ad>ad</div></main>after": "one",
        "<article><ul><li class=ad>ad<ul><li>x<li>y</ul></li><li>one</ul></article>": "one",
        "<article><p>one<span class=ad>ad<p>two</article>": "one\ntwo",
        "<article><p>one<aside><p>a<p>b</p></aside>two</article>": "one\ntwo",
        "<article><li>one<nav><ul><li>a<li>b</ul></nav><p>two</article>": "one\ntwo",
        "<article><div class=ad><script>'</div></article>'</script>ad</div><p>one</article>": "one",
        "<article><dl><dt>one<dd class=ad>ad<dt>two</dl></article>": "one\ntwo",
    }
    for page, want in cases.items():
        assert html_main.extract(html_main.parse(page), []) == want, page


def test_html_unclosed_and_named_elements():
    cases = {
        "<body><nav><ul><li>a<li>b</ul><article><p>one</p><p>two</article></body>": "one\ntwo",
        "<body><div class=ad>Buy<p>one<p>two</body>": "one\ntwo",
        "<main><div class='social-history'><p>one</p></div><div id=related-work>two</div><p class=share-price>three</p></main>": "one\ntwo\nthree",
        "<main><p>a</p><div class='ad-slot'>x</div><div class='cookie-banner'>c</div><ul class=site-nav><li>n</ul></main>": "a",
        "<form id=f><div class=content><article><p>one</article></div></form>": "one",
        "<article><p>x</p><aside>note</article>": "x", "<p>a <a href=x>b</a> c</p>": "a b c", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<title>t<p>x": "t\nx",
    }
    for page, want in cases.items():
        assert html_main.extract(html_main.parse(page), []) == want, page


@pytest.mark.parametrize("page", ['<div class="' * 80_000, "<a " * 300_000, '<a ">" ' * 140_000, "<div>" * 100_000 + "x" + "</p>" * 100_000, "<ul><li>" * 60_000, "<b>" * 100_000 + "</i>" * 100_000, "<" * 1_000_000, "<!--" * 200_000, "<title>" * 100_000, "<li>" + "<div>" * 30_000 + "<li>" * 30_000, "&" * 1_000_000])
def test_html_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_main.extract(html_main.parse(page), [])
    assert time.process_time() - began < 8  # a quadratic reader takes minutes


def test_every_path_of_a_host_can_win(spark):
    kinds = [(f"<body><div class='k{c}'><p>body {c} text</p></div><div class='x{c}'><p>{'stray ' * n}</p></div></body>", c) for c in "abcdef" for n in [1] * 12 + [30]]
    rows = [(i, "http://h.org/p", page) for i, (page, _) in enumerate(kinds)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"body {c} text" for i, (_, c) in enumerate(kinds))


def test_html_consensus_outvotes_a_page(spark):
    good = "<html><body><div class='story s{0}'><p>{1}</p></div><div class='pad'><p>{2}</p></div></body></html>"
    rows = [(i, "http://h.org/a", good.format(i, "main words here " * 9, "short")) for i in range(8)] + [(99, "http://H.org:80/b", good.format(9, "main", "a long stray passage " * 30)), (100, None, None), (101, "http://x.org", "")]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == "main" and got[0] == ("main words here " * 9).strip() and got[100] == got[101] == ""


def test_fertility_counts(spark, docs):
    for r in run(spark, "op10_tokeniser_fertility").collect():
        text = docs[r["doc_id"]] or ""
        ws = H.SPACED.findall(text)
        lines = [x for x in text.split("\n") if H.SPACED.search(x)]
        seen = Counter(tuple(ws[j : j + 8]) for j in range(len(ws) - 7))
        again = {q for j in range(len(ws) - 7) if seen[tuple(ws[j : j + 8])] > 1 for q in range(j, j + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(again) > 30 * len(ws)) and (not r["kept"] or not r["base_failed"])


def test_fertility_ids_are_those_of_whole_texts(docs):
    import sentencepiece

    path = packing.vocabulary_path(fertility.VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["foo\nbar", "a  b", "\n\nx", "\tx y", " lead", "tail ", "<s> x", "a▁b", "x\r\ny", "\x00a", "\n", " ", "\n \n", "  ", "a \n b", "▁", "漢字 é́", ""]
    texts = odd + [t or "" for t in docs.values()]
    cache, is_byte = fertility._cache(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in cache.ids([fertility.split_pieces(t.encode()) for t in texts])]
    assert got == [model.encode(t) for t in texts]
    assert is_byte[got[0]].any()


def test_fertility_verdicts_match_brute_force(spark):
    import sentencepiece

    sf = "/root/testdata/sf0.01"
    model = sentencepiece.SentencePieceProcessor(model_file=packing.vocabulary_path(fertility.VOCABULARY))
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = H.whole_text_verdicts({r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["lang"] for r in rows}, model, list(fertility.FLOORS[m] for m in ("chars_per_token", "fallback_share", "entropy_ratio")))
    got = run(spark, "op10_tokeniser_fertility", sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["kept"]) for r in got} == want
    assert sum(r["fallback_share"] is not None and r["fallback_share"] > 0 for r in got) > 900


def test_fertility_bands_fit_each_length(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in run(spark, "op10_tokeniser_fertility", sf).collect() if not r["base_failed"]]
    bad = [r for r in judged if truth.get(r["doc_id"]) == 0]
    good = [r for r in judged if truth.get(r["doc_id"]) == 1]
    assert sum(not r["kept"] for r in bad) > len(bad) / 2
    assert sum(not r["kept"] for r in good) <= 0.01 * len(good)
    assert any(not r["kept"] and r["n_tokens"] < 80 for r in judged)


OPERATORS = {
    "op1": lambda s, d: toxicity.detect(d, H.labels(s)),
    "op2": lambda s, d: near_duplicates.duplicate_classes(d),
    "op3": lambda s, d: language.identify(d),
    "op4": lambda s, d: licenses.scan(d),
    "op6": lambda s, d: suffix_tree_lm.score(d),
    "op7": lambda s, d: quality.classify(d, H.labels(s)),
    "op9": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "idiot"), (None, None)], "item_id long, text string")),
    "op10": lambda s, d: fertility.judge(d, group_col="lang"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_are_each_answered(spark, name):
    rows = H.awkward(spark)
    got = OPERATORS[name](spark, rows).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows.select("doc_id").collect())
    twins = [tuple(r) for r in got if r["doc_id"] == 2]
    assert twins[0] == twins[1]
    assert OPERATORS[name](spark, rows.limit(0)).count() == 0


def test_awkward_rows_pack_and_pages(spark):
    rows = H.awkward(spark)
    packed = packing.pack_documents(rows).collect()
    assert {str(r["doc_id"]) for r in packed} == {str(r["doc_id"]) for r in rows.collect()}
    assert sum(r["piece"] == 0 for r in packed) == rows.count()
    assert {r["length"] for r in packed if r["doc_id"] in (3, 4, 5)} == {1}
    assert packing.pack_documents(rows.limit(0)).count() == 0
    pages = rows.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "score", "text")
    assert html_main.main_text(pages).count() == rows.count() and html_main.main_text(pages.limit(0)).count() == 0


def test_defined_results_of_odd_rows(spark):
    rows = H.awkward(spark)
    lang = {str(r["doc_id"]): r["lang_pred"] for r in language.identify(rows).collect()}
    assert [lang[k] for k in ("3", "4", "5", "6")] == ["und"] * 4
    classes = {(str(r["doc_id"])): r["class_id"] for r in near_duplicates.duplicate_classes(rows).collect()}
    assert classes["1"] == classes["2"] == 1 and classes["3"] == 3 and classes["4"] == 4


def test_html_article_in_two_containers_is_whole(spark):
    split = "<body><nav>menu here</nav><div class='lead'><p>A lead of {0} words, in one sentence.</p></div><div class='rest'><p>" + "The rest goes on with words. " * 6 + "</p></div><div class='note'>tiny</div></body>"
    many = "<body><div class='{0} w'><p>The story is told here, at some length.</p></div><div class='{1} w'><p>Buy now. It is cheap today.</p></div></body>".format("a b c d story", "a b c d teaser")
    rows = [(1, "http://one.org/x", split.format(3))] + [(i, "http://host.org/x", split.format(i)) for i in range(2, 12)] + [(20, "http://host.org/y", "<body><div class='lead'><p>Only this.</p></div><div class='rest'><p>And this.</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    rest = ("The rest goes on with words. " * 6).strip()
    assert all(got[i] == f"A lead of {3 if i == 1 else i} words, in one sentence.\n{rest}" for i in range(1, 12)) and got[20] == "Only this.\nAnd this."
    paths = html_main.parse(many).path
    assert len(set(paths)) == len(paths)  # containers that differ in their fifth class are two


def test_threats_and_their_negations():
    base = toxicity._closed()
    keys = sorted(base)
    grammar = toxicity.Grammar(np.array(keys, np.uint64), np.array([base[k][0] for k in keys], np.int8), np.array([base[k][1] for k in keys]), {f: 1.0 for f in toxicity.FRAMES}, np.zeros(3))
    want = {
        "You will be killed tonight.": ["plain"], "We are killing you.": ["plain"], "Someone is going to kill them all, and your family too.": ["plain"], "I will kill you.": ["plain"],
        "I do not want to hurt you.": ["negated"], "You were not killed.": ["negated"], "He said he would kill you.": ["reported"], "You can kill the process with this command.": [], "The frost killed the roses. You were late.": [],
    }
    for text, frames in want.items():
        b = np.frombuffer(text.lower().encode(), np.uint8)
        assert [m[4] for m in toxicity.matches(grammar, b, np.array([0, len(b)]))] == frames, text


def test_quality_rates_match_grouped_sums(spark):
    """Rates and scores from the evidence of each document, by plain sums over hosts and paths."""
    docs = [(i, "good words go here in a row. " * (1 + i % 5) if i % 3 else "x#$ " * 9, f"p{i % 2}" if i % 11 else None, f"h{i % 4 if i % 4 < 3 else 7 + i % 8}", 0) for i in range(500)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"]: r for r in quality.classify(table, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")).collect()}
    p = {i: 1 / (1 + math.exp(-got[i]["evidence"])) for i in got}
    mean = sum(p.values()) / len(p)

    def groups(key):
        out = {}
        for i, _, lang, source, _ in docs:
            out.setdefault(key(lang, source), []).append(p[i])
        return out

    def strength(found, prior):
        n = sum(map(len, found.values()))
        within = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in found.values())
        between = sum(len(v) * (sum(v) / len(v) - prior(k)) ** 2 for k, v in found.items())
        scale = n - sum(len(v) ** 2 for v in found.values()) / n
        tau2 = (between - within / n * (len(found) - 1)) / scale
        total = sum(len(v) * prior(k) * (1 - prior(k)) for k, v in found.items()) / n
        return min(max(total / tau2 - 1, quality.STRENGTH[0]), quality.STRENGTH[1]) if tau2 > 0 else quality.STRENGTH[1]

    hosts, paths = groups(lambda lang, source: source), groups(lambda lang, source: (source, lang))
    a = strength(hosts, lambda k: mean)
    host_rate = {k: (sum(v) + a * mean) / (len(v) + a) for k, v in hosts.items()}
    b = strength(paths, lambda k: host_rate[k[0]])
    path_rate = {k: (sum(v) + b * host_rate[k[0]]) / (len(v) + b) for k, v in paths.items()}
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for i, _, lang, source, _ in docs:
        r = got[i]
        assert math.isclose(r["host_rate"], host_rate[source], rel_tol=1e-6) and math.isclose(r["path_rate"], path_rate[source, lang], rel_tol=1e-6)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(r["evidence"] + logit(path_rate[source, lang]) - logit(mean)))), rel_tol=1e-6)


def test_near_duplicates_of_a_larger_table_are_found(spark):
    """Of all pairs of similarity 0.8 and more, by an inverted index of shingles, the share that is in one class."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = H.near_duplicate_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op2_weighted_minhash", sf).collect()}
    pairs = [(i, c) for i, c in want.items() if i != c]
    assert len(pairs) > 20 and sum(got[i] == got[c] for i, c in pairs) >= 0.99 * len(pairs)
    assert sum(want[i] == want[c] for i, c in got.items()) >= 0.99 * len(got)


def test_pipelines_in_two_threads_have_their_own_scratch(spark):
    from concurrent.futures import ThreadPoolExecutor

    from lectern.llm.shared import scratch, stored

    def one(n):
        with scratch(spark):
            kept = stored(spark.range(n), "numbers")
            with scratch(spark):
                inner = stored(spark.range(2 * n), "numbers").count()
            return kept.count(), inner

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(one, range(1, 9))) == [(n, 2 * n) for n in range(1, 9)]


def test_members_of_a_group_still_meet_those_of_others(spark):
    """A text near a member of a joined group, but not near its anchor, is linked, also where finer buckets do not bring the two together."""
    text = lambda i: " ".join(f"w{j}" for j in range(i, i + 60))
    texts = spark.createDataFrame([(n, text(4 * n)) for n in range(3)] + [(3, text(900))], "node long, text string")
    idf = (np.zeros(0, np.uint64), np.zeros(0))
    for labels in ((0, 0, 2, 3), (0, 1, 1, 3)):
        split = spark.createDataFrame([(7, n, 1.0, labels[n]) for n in range(4)], "bucket long, node long, weight double, label long")
        assert {(r["a"], r["b"]) for r in near_duplicates._bucket_links(split, texts, idf, 0.8).collect()} == {((0, 1), (1, 2))[labels[1] == 0]}
        rows = near_duplicates._finer_links(split, texts, idf, 0.8).collect()
        assert {(r["a"], r["b"]) for r in rows} == {((0, 1), (1, 2))[labels[1] == 0]}


def test_a_large_split_bucket_is_compared_without_rows_of_pairs(spark, monkeypatch):
    """Copies that are all alike under the threshold share their buckets: their pairs grow with the square, rows and links do not, whatever the blocks."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(80)]
    docs = {}
    for n in range(60):
        words = list(base)
        for at in rng.choice(80, 3, replace=False):
            words[at] = f"n{n}x{at}"
        docs[n] = " ".join(words)
    docs |= {100 + n: docs[n] + f" more{n}" for n in range(0, 60, 4)}
    want = H.near_duplicate_classes(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    joined = []
    monkeypatch.setattr(near_duplicates, "verify", lambda pairs, *more, whole=near_duplicates.verify: joined.append(pairs.count()) or whole(pairs, *more))
    for size in (4000, 7):
        monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", size)
        assert {r["doc_id"]: r["class_id"] for r in near_duplicates.duplicate_classes(rows).collect()} == want
    assert max(joined) <= near_duplicates.BANDS * len(docs)  # stars only
