"""Structured Streaming: incremental heatmap, notification feed, unread counts, ingest, scoring, TTL registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import sliding_chunks
from ..operators.analytics import GRACE, STRUGGLE, TTL, sanitised_score, score_of, topic_key
from ..operators.dialogue import RAG_SCORES, rag_scores
from ..storage import Files, KeyedStore, shared_folder, stored, summed
from .ttl_state import Names, Registry


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files of a table, which may be one file or a folder."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[1]) for f in batch.inputFiles()):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Runs a stream to the end of what is there now, batch by batch; a later run with the same folder goes on where it stopped."""
    running = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()


def _append(stream: DataFrame, what: str, folder: str | None) -> DataFrame:
    """All rows that the stream has given under this folder, run by run; a replayed batch overwrites itself."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, what)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_available(stream, each, folder)
    if not Files(spark, folder).names(f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def once(stream: DataFrame, event_id: str = "event_id", at: str | None = None, within: str = "1 day") -> DataFrame:
    """Repeated events go, in a batch and across batches and restarts.

    The state is bounded: an id is kept until the watermark is past its time. at: the column with the time of the event;
    without one the time of arrival counts, and within is how long after its first arrival an event may come again.
    """
    timed = stream.withColumn("arrived", F.col(at).cast("timestamp") if at else F.current_timestamp())
    return timed.withWatermark("arrived", within).dropDuplicatesWithinWatermark([event_id]).drop("arrived")


class StruggleState:
    """Topic struggle as sums that changes are added to: what a batch reads and writes follows the batch.

    Three keyed tables: the sessions (with how many questions each has), sums a topic, and how many struggling sessions a
    user has in a topic - a counted multiset, since distinct users can't be subtracted. A batch looks up the sessions it
    touches and adds, for each, what is new less what was there. The tables of before the batch are read, so a
    batch that is replayed after a crash adds the same.
    """

    def __init__(self, spark: SparkSession, folder: str, sessions: DataFrame):
        user, key = sessions.schema["user_id"].dataType.simpleString(), sessions.schema["session_id"].dataType.simpleString()
        self.sessions = KeyedStore(spark, f"{folder}/sessions", ["session_id"], f"session_id {key}, course_id string, topic string, confidence double, user_id {user}, asked long")
        topic = ["course_id", "topic"]
        self.sums = KeyedStore(spark, f"{folder}/sums", topic, "course_id string, topic string, sessions long, asked long, scored long, confidence decimal(38,18)", summed(topic))
        self.users = KeyedStore(spark, f"{folder}/users", [*topic, "user_id"], f"course_id string, topic string, user_id {user}, sessions long", summed([*topic, "user_id"]))

    @staticmethod
    def _flat(sessions: DataFrame) -> DataFrame:
        return sessions.select("session_id", "course_id", topic_key(F.col("title")).alias("topic"), F.col("confidence_score").cast("double").alias("confidence"), "user_id")

    def _add(self, rows: DataFrame, version: int) -> None:
        """rows: sessions as they are (sign 1) and as they were (sign -1)."""
        counted = rows.where("topic <> ''")
        exact = F.col("confidence").try_cast("decimal(38,18)")  # sums of doubles would not come back to what they were
        sums = counted.groupBy("course_id", "topic").agg(
            F.sum("sign").alias("sessions"), F.sum(F.col("sign") * F.col("asked")).alias("asked"), F.sum(F.when(exact.isNotNull(), F.col("sign")).otherwise(0)).alias("scored"),
            F.coalesce(F.sum(F.when(F.col("sign") == 1, exact).otherwise(-exact)), F.lit(0)).cast("decimal(38,18)").alias("confidence"))
        users = counted.where(F.col("user_id").isNotNull() & (F.col("confidence") < STRUGGLE)).groupBy("course_id", "topic", "user_id").agg(F.sum("sign").alias("sessions"))
        self.sums.write(sums, version)
        self.users.write(users.where("sessions <> 0"), version)
        self.sessions.write(rows.where("sign = 1"), version)  # last: with it the batch is done

    def begin(self, sessions: DataFrame) -> None:
        """The sessions there are, as version 0, with no questions yet."""
        if not self.sessions.versions():
            self._add(self._flat(sessions).withColumns({"asked": F.lit(0).cast("long"), "sign": F.lit(1)}), 0)

    def change(self, asked: DataFrame | None, changed: DataFrame | None, version: int) -> None:
        """asked (session_id, n_asked): new questions; changed: sessions as they are from now on."""
        if self.sessions.versions()[-1] >= version:
            return
        old_columns = ["course_id", "topic", "confidence", "user_id"]
        touched = asked.select("session_id", "n_asked") if asked is not None else changed.select("session_id", F.lit(0).cast("long").alias("n_asked"))
        old = self.sessions.read(touched, before=version)
        both = touched.join(old, "session_id", "inner" if changed is None else "left")
        before = F.struct(*old_columns, F.col("asked"), F.lit(-1).alias("sign"))
        if changed is not None:
            news = self._flat(changed).select("session_id", *[F.col(c).alias(f"new_{c}") for c in old_columns], F.lit(True).alias("is_changed"))
            both = both.join(news, "session_id", "left")
            now = [F.when(F.col("is_changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in old_columns]
        else:
            now = [F.col(c) for c in old_columns]
        after = F.struct(*now, (F.coalesce("asked", F.lit(0)) + F.col("n_asked")).alias("asked"), F.lit(1).alias("sign"))
        rows = both.select("session_id", F.explode(F.array(before, after)).alias("row")).select("session_id", "row.*").where("sign = 1 or asked is not null")
        self._add(stored(rows, "struggle-changes"), version)

    def result(self) -> DataFrame:
        users = self.users.read().where("sessions > 0").groupBy("course_id", "topic").agg(F.count("*").alias("struggling_students"))
        mean = F.when(F.col("scored") > 0, F.round(F.col("confidence").cast("double") / F.col("scored"), 4)).otherwise(0.0)
        sums = self.sums.read().where("sessions > 0").join(users, ["course_id", "topic"], "left")
        return sums.select("course_id", "topic", F.col("asked").alias("questions_asked"), mean.alias("avg_confidence"), F.coalesce("struggling_students", F.lit(0)).cast("long").alias("struggling_students"))


def incremental_struggle(messages: DataFrame, sessions: DataFrame, folder: str | None = None) -> DataFrame:
    """The struggle heatmap, kept up by a stream of user messages (session_id); equal to a full recompute at any time.

    sessions: the base table when the folder is new. The stream may also carry session rows that are new or changed: then it
    has the columns course_id, title, confidence_score, user_id and is_session too, and rows with is_session are sessions
    as they are from now on (of one batch the greatest row of a session), the others messages.
    Messages of sessions that are not known count nothing. folder holds progress and tables.
    """
    spark = messages.sparkSession
    folder = folder or shared_folder(spark, "struggle")
    state = StruggleState(spark, folder, sessions)
    state.begin(sessions)
    mixed = "is_session" in messages.columns

    def each(batch: DataFrame, number: int) -> None:
        if not mixed:
            state.change(batch.groupBy("session_id").agg(F.count("*").alias("n_asked")), None, number + 1)
            return
        columns = ["course_id", "title", "confidence_score", "user_id"]
        changed = batch.where("is_session").groupBy("session_id").agg(F.max(F.struct(*columns)).alias("row")).select("session_id", "row.*")
        asked = batch.groupBy("session_id").agg(F.count_if(~F.col("is_session")).alias("n_asked"))
        known = asked.join(changed.select("session_id"), "session_id", "left_semi").unionByName(asked.join(changed.select("session_id"), "session_id", "left_anti").join(state.sessions.read(asked, before=number + 1).select("session_id"), "session_id", "left_semi"))
        state.change(known, changed, number + 1)

    run_available(messages, each, folder)
    return state.result()


def ready_text() -> list[Column]:
    """type, title, body and data of notifications that materials are ready."""
    body = F.concat("file_name", F.lit(" is ready to study."))
    data = F.to_json(F.struct(F.col("material_id").cast("string").alias("material_id"), "course_id"))
    return [F.lit("material_ready").alias("type"), F.lit("Material ready").alias("title"), body.alias("body"), data.alias("data")]


def enrolment_text() -> list[Column]:
    """The same of new enrolments (student_id, email, course_id, course_title)."""
    body = F.concat("email", F.lit(" has enrolled in "), "course_title", F.lit("."))
    data = F.to_json(F.struct(F.col("course_id").cast("string").alias("course_id"), F.col("student_id").cast("string").alias("student_id")))
    return [F.lit("new_enrollment").alias("type"), F.lit("New Enrollment").alias("title"), body.alias("body"), data.alias("data")]


def notifications_of(materials: DataFrame) -> DataFrame:
    """Notification rows of materials that became ready."""
    return materials.where("status = 'ready'").select("material_id", "course_id", *ready_text())


def notification_feed(materials: DataFrame, folder: str | None = None, event_id: str | None = None) -> DataFrame:
    """One row per ready material; with event_id, events that come again give none, whatever the restarts."""
    if event_id:
        materials = once(materials.where("status = 'ready'"), event_id)
    return _append(notifications_of(materials), "feed", folder)


def lecturer_feed(materials: DataFrame, enrolments: DataFrame, folder: str | None = None) -> DataFrame:
    """One feed (user_id, type, title, body, data) of two streams, to the lecturer of the course: materials that became
    ready and new enrolments. Courses without lecturer give no row. Both streams carry event_id and lecturer_id, and an
    event that comes again gives no second row."""
    told = lambda rows, text: rows.where("lecturer_id is not null").select("event_id", F.col("lecturer_id").cast("string").alias("user_id"), *text)
    both = told(materials.where("status = 'ready'"), ready_text()).unionByName(told(enrolments, enrolment_text()))
    return _append(once(both).drop("event_id"), "lecturer-feed", folder)


def unread_counts(changes: DataFrame, folder: str | None = None) -> DataFrame:
    """Unread notifications of each user from a stream of changes, whatever the order they come in.

    changes: (user_id, delta), +1 for a notification and -1 for a read one, optionally with second, the time of the
    change, and reset, true where a user marks all as read: that takes out all changes up to and with its second.
    The keyed table holds sums a user and second; a batch adds its own sums only, and merging drops what a reset took out.
    """
    spark = changes.sparkSession
    folder = folder or shared_folder(spark, "unread")
    user = changes.schema["user_id"].dataType.simpleString()

    def merge(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("user_id", "second").agg(F.sum("delta").alias("delta"), F.max("reset").alias("reset"), F.max("change_version").alias("change_version"))
        last = each.where("reset").groupBy(F.col("user_id").alias("of")).agg(F.max("second").alias("from"))
        left = each.join(last, F.col("user_id").eqNullSafe(F.col("of")), "left").where("from is null or second > from or (second = from and reset)")
        return left.select("user_id", "second", F.when(F.col("reset"), 0).otherwise(F.col("delta")).cast("long").alias("delta"), "reset", "change_version")

    counts = KeyedStore(spark, f"{folder}/counts", ["user_id"], f"user_id {user}, second long, delta long, reset boolean", merge)
    second = F.col("second").cast("long") if "second" in changes.columns else F.lit(0).cast("long")
    reset = F.coalesce("reset", F.lit(False)) if "reset" in changes.columns else F.lit(False)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", second.alias("second"), F.when(reset, 0).otherwise(F.col("delta")).alias("delta"), reset.alias("reset"))
        counts.write(rows.groupBy("user_id", "second").agg(F.sum("delta").cast("long").alias("delta"), F.max("reset").alias("reset")), number)

    run_available(changes, each, folder)
    return counts.read().groupBy("user_id").agg(F.sum("delta").alias("n_unread"))


def streaming_ingest(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages -> sliding chunks, written per batch; a retried batch overwrites itself, so chunks never double."""
    cut = sliding_chunks(pages.select("doc_id", "course_id", "text")).select("doc_id", "course_id", "chunk_index", "content")
    return _append(cut, "ingest", folder)


def score_and_log(interactions: DataFrame, folder: str | None = None) -> DataFrame:
    """Interactions with their sanitised faithfulness, appended; unscorable rows stay with a null score."""
    return _append(interactions.select("id", "course_id", sanitised_score(score_of(F.col("ragas_json"), "faithfulness").cast("string")).alias("faithfulness")), "scores", folder)


def score_answers(answers: DataFrame, folder: str | None = None, judge=None, event_id: str = "key") -> DataFrame:
    """Answers (key, question, answer, reference, contexts) of a stream with their retrieval scores, appended to a log.

    An answer that comes again is scored once, whatever the restarts. judge: see dialogue.rag_scores; where it fails
    the lexical scores stand, so scoring never holds the log up.
    """
    fresh = once(answers, event_id)
    if judge is None:
        return _append(rag_scores(fresh), "answer-scores", folder)
    spark = answers.sparkSession
    folder = folder or shared_folder(spark, "answer-scores")

    def each(batch: DataFrame, number: int) -> None:
        rag_scores(batch, judge).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_available(fresh, each, folder)
    return spark.read.option("recursiveFileLookup", "true").schema("key " + answers.schema["key"].dataType.simpleString() + ", " + ", ".join(f"{s} double" for s in RAG_SCORES) + ", judged_by string").parquet(f"{folder}/rows")


def _registry_provider(spark: SparkSession):
    """Keyed state with maps and timers needs the RocksDB store; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return lambda: spark.conf.set(name, before) if before else spark.conf.unset(name)


def ttl_registry(events: DataFrame, ttl: int = TTL, grace: int = GRACE, folder: str | None = None, lateness: int | None = None) -> DataFrame:
    """(event_id, cache_key, outcome) of the requests of a stream: hit, expired or miss against the latest registration before.

    events: (event_id, cache_key, kind, ts), kind register, request or evict, optionally name: what a registration goes
    by. An eviction has a name and no key, and takes out the registration of that name, wherever it is.

    Events may come in any order and any batches: a request is answered at once and again when an earlier event comes
    later, and the newest answer counts, so the result equals that of the batch operator on the same events, however
    they were split. Without lateness all events stay in the state, by key and day. With it (seconds), events
    may come so much behind the newest one; days before that are folded into their last registration, and events that
    come later still are left out. Events that come again count once. Rows without event_id, time or kind are no events.
    """
    spark = events.sparkSession
    folder = folder or shared_folder(spark, "registry")
    key_type = events.schema["cache_key"].dataType.simpleString()
    named = "name" in events.columns
    timed = events.where("event_id is not null and ts is not null and kind in ('register', 'request', 'evict')")
    timed = timed.select("event_id", "cache_key", "kind", F.col("ts").cast("timestamp").alias("at"), F.col("name") if named else F.lit(None).cast("string").alias("name"))
    put_back = _registry_provider(spark)
    try:
        if named:
            pairs = timed.where("name is not null and kind <> 'request'").select("name", "event_id", "kind", F.unix_timestamp("at").alias("second"), F.col("cache_key").cast("string").alias("key_text"))
            found = pairs.groupBy("name").transformWithStateInPandas(Names(), "event_id long, key_text string, second long, name string", "Update", "None")
            evictions = f"{folder}/evictions"
            spark.createDataFrame([], found.schema).write.mode("ignore").parquet(f"{evictions}/rows/batch=none")

            def each_pair(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{evictions}/rows/batch={number}")

            run_available(found, each_pair, evictions, "update")
            keyed = spark.readStream.schema(found.schema).option("recursiveFileLookup", "true").parquet(f"{evictions}/rows")
            keyed = keyed.select("event_id", F.col("key_text").cast(key_type).alias("cache_key"), F.lit("evict").alias("kind"), F.timestamp_seconds("second").alias("at"), "name")
            timed = timed.where("kind <> 'evict'").unionByName(keyed)
        if lateness is not None:
            timed = timed.withWatermark("at", f"{lateness} seconds")
        rows = timed.where("kind <> 'evict' or name is not null").withColumn("second", F.unix_timestamp("at"))
        answers = rows.groupBy("cache_key").transformWithStateInPandas(Registry(ttl, grace, lateness is not None), f"event_id long, cache_key {key_type}, outcome string", "Update", "None" if lateness is None else "EventTime")
        newest = KeyedStore(spark, f"{folder}/answers", ["event_id"], f"event_id long, cache_key {key_type}, outcome string")
        run_available(answers, newest.write, folder, "update")
    finally:
        put_back()
    return newest.read()
