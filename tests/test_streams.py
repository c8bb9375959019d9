"""Streams over several batches and runs: equal to batch results, bounded in what a batch writes, safe to replay."""

import random

from pyspark.sql import functions as F

from lectern.operators import analytics as A
from lectern.storage import Files, KeyedStore, summed
from lectern.streaming import streams as T

DAY = 86_400


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet")) if path.exists() else 0


def struggle(spark, sessions, messages):
    held = spark.createDataFrame(sessions, SESSION)
    rows = spark.createDataFrame([(s, "user") for s in messages], "session_id long, role string")
    return sorted(map(tuple, A.topic_struggle(held, rows).select("course_id", "topic", "questions_asked", "avg_confidence", "struggling_students").collect()))


SESSION = "session_id long, course_id string, title string, confidence_score double, user_id long"


def test_struggle_stream_resumes_over_several_batches(spark, tmp_path):
    sessions = [(i, f"c{i % 2}", f" Topic {i % 3}" if i != 7 else " ", None if i == 5 else i % 5 / 5, i % 4 if i != 9 else None) for i in range(12)]
    rows, path, folder, done = [(i % 13,) for i in range(40)], tmp_path / "in", str(tmp_path / "state"), 0
    for upto in (10, 25, 40):
        append(spark, path, rows[done:upto], "session_id long")
        done = upto
        got = T.incremental_struggle(T.table_stream(spark, str(path), 1), spark.createDataFrame(sessions, SESSION), folder)
        assert sorted(map(tuple, got.collect())) == struggle(spark, sessions, [s for (s,) in rows[:upto]])


def test_struggle_stream_follows_sessions_that_change(spark, tmp_path):
    base = {i: (i, f"c{i % 2}", f"topic {i % 3}", i % 5 / 5, i % 4) for i in range(10)}
    schema = SESSION + ", is_session boolean"
    path, folder, sessions, asked = tmp_path / "in", str(tmp_path / "state"), dict(base), []
    batches = [
        [(3, None, None, None, None, False), (3, None, None, None, None, False), (20, "c9", "new", 0.1, 5, True), (20, None, None, None, None, False)],
        [(3, "c1", "topic 1", 0.9, 3, True), (4, "c0", "topic 1", 0.2, 1, True), (99, None, None, None, None, False)],
        [(20, "c9", "new", 0.8, 5, True), (3, None, None, None, None, False)],
    ]
    for batch in batches:
        append(spark, path, batch, schema)
        for r in batch:
            if r[-1]:
                sessions[r[0]] = r[:-1]
        asked += [r[0] for r in batch if not r[-1] and r[0] in sessions]
        got = T.incremental_struggle(T.table_stream(spark, str(path), 1), spark.createDataFrame(list(base.values()), SESSION), folder)
        assert sorted(map(tuple, got.collect())) == struggle(spark, list(sessions.values()), asked)


def test_what_a_struggle_batch_writes_follows_the_batch(spark, tmp_path):
    wrote = []
    for n in (300, 6000):
        sessions = spark.range(n).select(F.col("id").alias("session_id"), (F.col("id") % 50).cast("string").alias("course_id"), (F.col("id") % 9).cast("string").alias("title"), F.lit(0.3).alias("confidence_score"), F.col("id").alias("user_id"))
        folder = tmp_path / f"state{n}"
        state = T.StruggleState(spark, str(folder), sessions)
        state.begin(sessions)
        for table in ("sessions", "sums", "users"):
            assert Files(spark, str(folder)).names(f"{folder}/{table}/data") == ["0"]
        asked = spark.createDataFrame([(5, 1), (6, 2)], "session_id long, n_asked long")
        state.change(asked, None, 1)
        wrote.append(sum(size_of(folder / t / "data" / "1") for t in ("sessions", "sums", "users")))
        before = sorted(map(tuple, state.result().collect()))
        state.change(asked, None, 1)  # a replay
        assert sorted(map(tuple, state.result().collect())) == before
    assert wrote[1] < 1.2 * wrote[0]


def test_keyed_store_merges_compacts_and_replays(spark, tmp_path):
    r, want = random.Random(3), {}
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], "k long, v string", buckets=4, fan=3)
    sums, total = KeyedStore(spark, str(tmp_path / "t"), ["k"], "k long, n long", summed(["k"]), buckets=4, fan=3), {}
    for version in range(11):
        rows = [(k, f"{version}-{k}") for k in r.sample(range(40), 6)]
        want |= dict(rows)
        df = spark.createDataFrame(rows, "k long, v string")
        for _ in range(2):  # the second one is a replay
            store.write(df, version)
            sums.write(df.select("k", F.lit(2).cast("long").alias("n")), version)
        total = {**total, **{k: total.get(k, 0) + 2 for k, _ in rows}}
        if version == 6:
            before = dict(want)
    assert {x["k"]: x["v"] for x in store.read().collect()} == want
    assert {x["k"]: x["n"] for x in sums.read().collect()} == total
    assert store.versions() == [9, 10] and all(sum(level == at for _, at in parts) < 3 for parts in store._manifest(10).values() for level in range(4))
    some = spark.createDataFrame([(k,) for k in list(want)[:3]], "k long")
    assert {x["k"]: x["v"] for x in store.read(some).collect()} == {k: want[k] for k in list(want)[:3]}
    files = store.read(spark.createDataFrame([(list(want)[0],)], "k long")).inputFiles()
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1
    assert before != want and len(Files(spark, str(tmp_path)).names(f"{tmp_path}/s/manifests")) == 2


def test_upsert_into_buckets_writes_what_changes(spark, tmp_path):
    from lectern.sources.corpus import upsert_store

    old = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("n").alias("namespace"), F.lit("old").alias("payload"))
    folder = tmp_path / "vectors"
    schema = "namespace string, chunk_id string, payload string"
    upsert_store(spark, str(folder), ["namespace", "chunk_id"], schema, old, 1)
    new = old.where("chunk_id in ('c1', 'c2')").withColumn("payload", F.lit("new"))
    for _ in range(2):
        store = upsert_store(spark, str(folder), ["namespace", "chunk_id"], schema, new, 2)
    got = {r["chunk_id"]: r["payload"] for r in store.read().collect()}
    assert len(got) == 5000 and sorted(k for k, v in got.items() if v == "new") == ["c1", "c2"]
    assert size_of(folder / "data" / "2") < 0.1 * size_of(folder / "data" / "1")


def test_unread_counts_with_marks_of_all_in_any_order(spark, tmp_path):
    r = random.Random(5)
    events = [(u, 1 if r.random() < 0.7 else -1, r.randrange(200), r.random() < 0.04) for u in range(5) for _ in range(60)] + [(None, 1, 3, False)]
    want = {}
    for user in {e[0] for e in events}:
        mine = [e for e in events if e[0] == user]
        last = max([e[2] for e in mine if e[3]], default=-1)
        want[user] = sum(e[1] for e in mine if not e[3] and e[2] > last)
    for seed in range(2):
        random.Random(seed).shuffle(events)
        path, folder = tmp_path / f"in{seed}", str(tmp_path / f"unread{seed}")
        for at in range(0, len(events), 60):
            append(spark, path, events[at : at + 60], "user_id long, delta int, second long, reset boolean")
            got = T.unread_counts(T.table_stream(spark, str(path), 1), folder)
        found = {x["user_id"]: x["n_unread"] for x in got.collect()}
        assert all(found.get(u, 0) == n for u, n in want.items())


def test_unread_and_feed_streams_resume(spark, tmp_path):
    path, folder, total = tmp_path / "in", str(tmp_path / "unread"), {}
    for batch in ([(1, 1), (1, 1), (2, 1)], [(1, -1), (3, 1)], [(2, -1)]):
        append(spark, path, batch, "user_id long, delta int")
        for user, delta in batch:
            total[user] = total.get(user, 0) + delta
        got = T.unread_counts(T.table_stream(spark, str(path), 1), folder)
        assert {r["user_id"]: r["n_unread"] for r in got.collect()} == total


def test_feed_of_two_streams_drops_repeats_after_a_restart(spark, tmp_path):
    materials, enrolments, folder = tmp_path / "m", tmp_path / "e", str(tmp_path / "feed")
    m, e = "event_id string, material_id long, course_id string, file_name string, status string, lecturer_id long", "event_id string, student_id long, email string, course_id string, course_title string, lecturer_id long"
    ready, joined = ("a", 1, "c", "x.pdf", "ready", 9), ("b", 5, "s@u.edu", "c", "Heaps", 9)
    for more in ([ready, ready, ("f", 2, "c", "y.pdf", "failed", 9)], [ready, ("g", 3, "d", "z.pdf", "ready", None)]):
        append(spark, materials, more, m)
        append(spark, enrolments, [joined, joined, ("h", 6, "t@u.edu", "c", "Heaps", None)], e)
        got = T.lecturer_feed(T.table_stream(spark, str(materials), 1), T.table_stream(spark, str(enrolments), 1), folder).collect()
    assert sorted((r["user_id"], r["type"], r["body"]) for r in got) == [("9", "material_ready", "x.pdf is ready to study."), ("9", "new_enrollment", "s@u.edu has enrolled in Heaps.")]
    assert {r["data"] for r in got} == {'{"material_id":"1","course_id":"c"}', '{"course_id":"c","student_id":"5"}'}


EVENT = "event_id long, cache_key long, kind string, s long, name string"


def registry(spark, tmp_path, name, files, **more):
    path = tmp_path / name / "in"
    for rows in files:
        append(spark, path, rows, EVENT)
    stream = T.table_stream(spark, str(path), 1).withColumn("ts", F.timestamp_seconds("s"))
    return {r["event_id"]: r["outcome"] for r in T.ttl_registry(stream, folder=str(tmp_path / name / "state"), **more).collect()}


def test_registry_is_right_for_any_split_of_the_events(spark, tmp_path):
    from lectern.fixtures import Views

    v = Views(spark, "/root/testdata/sf0.01")
    want = {r["event_id"]: r["outcome"] for r in A.cache_lookup(v.cache_events).collect()}
    rows = [(r["event_id"], r["cache_key"], r["kind"], r["s"], None) for r in v.cache_events.withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp"))).collect()]
    assert len(want) > 1900
    rows.sort(key=lambda x: x[3])
    ordered = [rows[i : i + 600] for i in range(0, len(rows), 600)]
    random.Random(1).shuffle(rows)
    shuffled = [rows[i : i + 300] for i in range(0, len(rows), 300)]
    for name, files in (("ordered", ordered), ("shuffled", shuffled)):
        assert registry(spark, tmp_path, name, files) == want, name


def brute_registry(events, ttl=DAY, grace=300):
    out = {}
    ordered = sorted({e[0]: e for e in events}.values(), key=lambda e: (e[3], e[0]))
    held = {}
    for event, key, kind, second, name in ordered:
        if kind == "register":
            held[key] = (second, name)
        elif kind == "evict":
            held = {k: (s, None if n == name else n) if n == name else (s, n) for k, (s, n) in held.items() if n != name}
        else:
            out[event] = "miss" if key not in held else "hit" if second < held[key][0] + ttl - grace else "expired"
    return out


def test_registry_evicts_by_name_in_any_order(spark, tmp_path):
    r, events = random.Random(7), []
    for i in range(160):
        kind = r.choice(["register", "request", "request", "evict"])
        key = r.randrange(4)
        events.append((i, None if kind == "evict" else key, kind, r.randrange(6 * DAY), f"n{r.randrange(4)}{r.randrange(2)}" if kind == "evict" else f"n{key}{r.randrange(2)}" if kind == "register" else None))
    want = brute_registry(events)
    assert len(set(want.values())) == 3
    r.shuffle(events)
    assert registry(spark, tmp_path, "evict", [events[i : i + 40] for i in range(0, 160, 40)] + [events[:30]]) == want
    assert {x["event_id"]: x["outcome"] for x in A.cache_lookup(spark.createDataFrame(events, EVENT).withColumn("ts", F.timestamp_seconds("s"))).collect()} == want


class Calls:
    """A key's state as the registry sees it, counting the calls; each is a round trip to the JVM."""

    def __init__(self):
        self.n, self.maps, self.one = 0, {}, None

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def _count(self, value=None):
        self.n += 1
        return value

    def exists(self):
        return self._count(self.one is not None)

    def get(self):
        return self._count(self.one)

    def update(self, value):
        self.one = self._count(value)

    def containsKey(self, key):
        return self._count(key in self.maps)

    def getValue(self, key):
        return self._count(self.maps[key])

    def updateValue(self, key, value):
        self.maps[key] = self._count(value)


def test_registry_reads_and_writes_one_value_for_a_key_with_few_events(monkeypatch):
    import pandas as pd

    from lectern.streaming import ttl_state

    r = random.Random(3)
    events = [(i, r.choice(["register", "request", "request"]), r.randrange(30 * DAY)) for i in range(90)]
    want = brute_registry([(i, 5, kind, s, None) for i, kind, s in events])
    for small in (ttl_state.SMALL, 40, 0):
        monkeypatch.setattr(ttl_state, "SMALL", small)
        calls, of, got, most = Calls(), ttl_state.Registry(DAY, 300, False), {}, 0
        of.init(calls)
        for at in range(0, 90, 30):
            before, frame = calls.n, pd.DataFrame(events[at : at + 30], columns=["event_id", "kind", "second"]).assign(name=None)
            for answers in of.handleInputRows((5,), iter([frame]), None):
                got |= dict(zip(answers["event_id"], answers["outcome"]))
            most = max(most, calls.n - before)
        assert got == want, small
        assert most <= 3 if small >= 90 else len(calls.maps) > 20


def test_registry_with_bounded_lateness_folds_old_days(spark, tmp_path):
    files = [[(1, 7, "register", 0, None), (2, 7, "request", DAY // 2, None)], [(3, 7, "request", DAY + 5, None), (4, 8, "request", DAY + 5, None)], [(5, 9, "register", 5 * DAY, None)], [(6, 9, "request", 5 * DAY + 9, None)], [(7, 7, "request", 5 * DAY + 20, None)], [(8, 7, "register", 4 * DAY + DAY // 2, None)]]
    files = [[(e, k, kind, s + 100 * DAY, name) for e, k, kind, s, name in rows] for rows in files]  # at 0 the watermark starts
    got = registry(spark, tmp_path, "late", files, lateness=DAY)
    assert got == {2: "hit", 3: "expired", 4: "miss", 6: "hit", 7: "hit"}


def flaky(content, attempt):
    """Fails for good on 'bad', and twice on 'late'."""
    text = content.decode() if isinstance(content, bytes | bytearray) else content
    if text is None or text == "bad" or (text.startswith("late") and attempt < 3):
        raise ValueError(f"try {attempt}")
    return text.split("\f")


def test_ingest_retries_what_fails_and_goes_on(spark, tmp_path):
    from lectern.streaming import ingest as I

    path, folder = tmp_path / "in", str(tmp_path / "made")
    batches = [[(1, "one\ftwo " * 3), (2, "bad"), (3, "late page"), (None, "x")], [(4, "x" * 1500), (5, None)], [(2, "now good"), (1, "one only")]]
    for batch in batches:
        append(spark, path, batch, "material_id long, content string")
        made = I.ingest(T.table_stream(spark, str(path), 1), flaky, folder)
    got = {r["material_id"]: (r["status"], r["attempts"], r["page_count"], r["error"]) for r in made.materials().collect()}
    assert got == {1: ("ready", 1, 1, None), 2: ("ready", 1, 1, None), 3: ("ready", 3, 1, None), 4: ("ready", 1, 1, None), 5: ("failed", 4, 0, "ValueError: try 4")}
    chunks = sorted((r["material_id"], r["page_number"], r["chunk_index"], r["content"]) for r in made.chunks().collect())
    assert [c[:3] for c in chunks] == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (4, 1, 1), (4, 1, 2)] and chunks[0][3] == "one only"


def test_ingest_of_files_rejects_kinds_and_reads_the_rest(spark, tmp_path):
    from lectern.streaming import ingest as I

    folder = tmp_path / "files"
    folder.mkdir()
    for name, body in (("a.pdf", b"page one\fpage two"), ("b.exe", b"x"), ("c.pdf", b" \f "), ("d", b"no extension")):
        (folder / name).write_bytes(body)
    made = I.ingest(I.file_stream(spark, str(folder)), folder=str(tmp_path / "made"))
    got = {r["material_id"].rsplit("/", 1)[1]: (r["status"], r["attempts"], r["page_count"]) for r in made.materials().collect()}
    assert got == {"a.pdf": ("ready", 1, 2), "b.exe": ("rejected", 0, 0), "c.pdf": ("failed", 4, 0), "d": ("ready", 1, 1)}
    (folder / "e.pdf").write_bytes(b"later")
    made = I.ingest(I.file_stream(spark, str(folder)), folder=str(tmp_path / "made"))
    assert {r["material_id"].rsplit("/", 1)[1] for r in made.chunks().collect()} == {"a.pdf", "d", "e.pdf"}


def answers(rows):
    return [(k, q, a, None, c) for k, q, a, c in rows]


def test_answers_are_scored_once_with_or_without_a_judge(spark, tmp_path):
    from lectern.operators import dialogue as D

    schema = "key long, question string, answer string, reference string, contexts array<string>"
    rows = answers([(1, "what is a heap", "a heap is a tree.", ["a heap is a tree", "x"]), (2, "q", "a", []), (3, "stack or queue", "a stack", ["a stack is last in"])])
    want = {r["key"]: tuple(r)[1:5] for r in D.rag_scores(spark.createDataFrame(rows, schema)).collect()}

    def judge(question, answer, reference, contexts):
        return [{"faithfulness": 3, "context_recall": "x", "context_precision": 0.12345, "answer_relevancy": 0.5} if "heap" in q else None for q in question]

    def broken(question, answer, reference, contexts):
        raise RuntimeError("provider is down")

    for name, hook in (("plain", None), ("judge", judge), ("broken", broken)):
        path, folder = tmp_path / name / "in", str(tmp_path / name / "made")
        for _ in range(2):
            append(spark, path, rows + rows[:1], schema)
            got = {r["key"]: r for r in T.score_answers(T.table_stream(spark, str(path), 1), folder, hook).collect()}
        log = T.score_answers(T.table_stream(spark, str(path), 1), folder, hook)
        assert log.count() == 3
        assert all(tuple(got[k])[1:5] == want[k] for k in want if not (name == "judge" and k == 1))
        if hook:
            assert {k: r["judged_by"] for k, r in got.items()} == {1: "hook" if name == "judge" else "default", 2: "default", 3: "default"}
    assert tuple(got[1])[1:5] == want[1]
    judged = {r["key"]: tuple(r)[1:5] for r in D.rag_scores(spark.createDataFrame(rows, schema), judge).collect()}
    assert judged == {1: (0.1235, None, 1.0, 0.5), 2: want[2], 3: want[3]}
