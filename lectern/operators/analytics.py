"""Learning analytics and evaluation: struggle heatmaps, quality summaries, risk bands, audits over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRUGGLE = 0.5
SCORES = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
CACHE_MIN_TOKENS = 32_768
TTL, GRACE = 86_400, 300


def topic_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def topic_struggle(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Per (course, topic): user messages, mean confidence of its sessions (0 when none), users under 0.5.

    Messages are counted per session before the join, so a chatty session weighs once in the mean.
    Blank titles are skipped; titles that differ in case or outer space are one topic.
    """
    asked = messages.where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("n_asked"))
    rows = sessions.withColumn("topic", topic_key(F.col("title"))).where("topic <> ''").join(asked, "session_id", "left")
    return rows.groupBy("course_id", "topic").agg(
        F.coalesce(F.sum("n_asked"), F.lit(0)).alias("questions_asked"),
        F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("avg_confidence"),
        F.count_distinct(F.when(F.col("confidence_score") < STRUGGLE, F.col("user_id"))).alias("struggling_students"))


def leading_words(text: Column, n: int = 3) -> Column:
    """The first n words in lower case."""
    return F.array_join(F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, n), " ")


def keyword_heatmap(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Per course and leading words of user messages: count, distinct students, constant confidence."""
    rows = messages.where("role = 'user'").withColumn("topic", leading_words(F.col("content"))).where("topic <> ''")
    joined = rows.join(sessions.select("session_id", "course_id", "user_id"), "session_id")
    return joined.groupBy("course_id", "topic").agg(F.count("*").alias("questions_asked"), F.count_distinct("user_id").alias("students"), F.lit(0.5).alias("avg_confidence"))


def score_of(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}").try_cast("double")


def failure_heatmap(interactions: DataFrame) -> DataFrame:
    """Per course and bloom level: count, share with faithfulness under 0.5 (unscored count as passing), sessions."""
    failed = F.when(score_of(F.col("ragas_json"), "faithfulness") < 0.5, 1.0).otherwise(0.0)
    return interactions.groupBy("course_id", "bloom_level").agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(failed), 4), F.lit(0.0)).alias("failure_rate"), F.count_distinct("session_id").alias("n_sessions"))


def risk_band(faithfulness: Column) -> Column:
    return F.when(faithfulness.isNull(), "unknown").when(faithfulness >= 0.85, "low").when(faithfulness >= 0.60, "medium").otherwise("high")


def quality_summary(interactions: DataFrame) -> DataFrame:
    """Per course: count, scored, complete, the four means (nulls ignored), risk from the unrounded mean."""
    scores = {s: score_of(F.col("ragas_json"), s) for s in SCORES}
    complete = F.count_if(F.expr(" and ".join(f"{s} is not null" for s in SCORES))).alias("complete_count")
    flat = interactions.select("course_id", "ragas_json", *[c.alias(s) for s, c in scores.items()])
    means = flat.groupBy("course_id").agg(F.count("*").alias("n"), F.count("ragas_json").alias("scored"), complete, *[F.avg(s).alias(s) for s in SCORES])
    return means.select("course_id", "n", "scored", "complete_count", *[F.round(s, 4).alias(f"avg_{s}") for s in SCORES], risk_band(F.col("faithfulness")).alias("risk"))


def sanitised_score(raw: Column) -> Column:
    """Unparseable and NaN become null; held to 0..1; four decimals."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4))


def total_and_page(rows: DataFrame, group: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of each group with the group's total; the total comes from an aggregate, not from a window over the group."""
    totals = rows.groupBy(F.col(group).alias("total_group")).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    paged = rows.withColumn("place", place).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    return paged.join(totals, F.col(group).eqNullSafe(F.col("total_group"))).drop("total_group")


def request_rates(events: DataFrame, user: str, ts: str, limit: int = 1000, anonymous_limit: int = 100) -> DataFrame:
    """Adds how many requests the user made in the 24 h up to each, and whether that is over the limit.

    Requests without a user are one sender, which may have a third of all rows: they are counted by sender and second
    first, and sums run over the seconds of a day and the day before, so no window holds more than two days of seconds.
    Requests without a time have no count.
    """
    day = 86_400
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    counted = events.withColumn("second", second)
    each = counted.groupBy(F.col(user).alias("sender"), "second").agg(F.count("*").alias("n"))
    # A second of day d counts for those of day d and of day d + 1: sums run inside (sender, day).
    dealt = each.select("sender", "second", "n", F.explode(F.array(F.floor(F.col("second") / day), F.floor(F.col("second") / day) + 1)).alias("day"))
    trailing = F.sum("n").over(Window.partitionBy("sender", "day").orderBy("second").rangeBetween(-(day - 1), 0))
    sums = dealt.withColumn("in_day", trailing).where(F.floor(F.col("second") / day) == F.col("day")).select("sender", F.col("second").alias("at"), "in_day")
    joined = counted.join(sums, F.col(user).eqNullSafe(F.col("sender")) & F.col("second").eqNullSafe(F.col("at")), "left").drop("sender", "at", "second")
    return joined.withColumn("over_limit", F.col("in_day") > F.when(F.col(user).isNull(), anonymous_limit).otherwise(limit))


#: Seconds of a time bucket of the as-of join: no window holds more than the events of a key in it, or a row a bucket.
BUCKET = 3600


def _carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds name: the last value that is not null of the same key, up to and with the row, in the order of second and event_id.

    Windows run inside a bucket of time; what a bucket starts with is the last value of the buckets before it, which is
    found over one row a key and bucket and joined back on both.
    """
    held = rows.withColumns({"bucket": F.floor(F.col("second") / BUCKET), name: value})
    inside = Window.partitionBy("cache_key", "bucket").orderBy("second", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.groupBy("cache_key", "bucket").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.struct("second", "event_id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("cache_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select(F.col("cache_key").alias("start_key"), F.col("bucket").alias("start_bucket"), before.alias("start")).where("start is not null")
    seen = held.withColumn(name, F.last(name, ignorenulls=True).over(inside))
    joined = seen.join(starts, F.col("cache_key").eqNullSafe(F.col("start_key")) & (F.col("bucket") == F.col("start_bucket")), "left")
    return joined.withColumn(name, F.coalesce(name, "start")).drop("bucket", "start_key", "start_bucket", "start")


def cache_lookup(events: DataFrame, ttl: int = TTL, grace: int = GRACE) -> DataFrame:
    """(event_id, cache_key, outcome) of each request: hit, expired or miss against the latest registration before it.

    events: (event_id, cache_key, kind, ts), optionally name: then an event of kind evict takes out the registration that
    goes by its name, wherever it is, and later requests miss. Rows without time are no events; repeated ones count once.
    """
    named = "name" in events.columns
    timed = events.where("event_id is not null and ts is not null").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp"))).dropDuplicates(["event_id", "kind"])
    registered = F.struct("second", F.col("event_id").alias("event"), *([F.col("name")] if named else []))
    seen = _carried(timed.where("kind <> 'evict'"), F.when(F.col("kind") == "register", registered), "registered").where("kind = 'request'")
    evicted = F.lit(False)
    if named:
        # A name's registrations and evictions in one order: each registration knows the first eviction after it.
        both = timed.where("name is not null and kind in ('register', 'evict')").select(F.col("name").alias("cache_key"), "second", "event_id", "kind")
        back = both.withColumns({"at": F.struct("second", "event_id"), "second": -F.col("second"), "event_id": -F.col("event_id")})
        next_one = _carried(back, F.when(F.col("kind") == "evict", F.col("at")), "gone").where("kind = 'register' and gone is not null").select(F.col("at.event_id").alias("of"), "gone")
        seen = seen.join(next_one, F.col("registered.event") == F.col("of"), "left")
        evicted = F.coalesce(F.col("gone") < F.struct("second", "event_id"), F.lit(False))
    outcome = F.when(F.col("registered").isNull() | evicted, "miss").when(F.col("second") < F.col("registered.second") + ttl - grace, "hit").otherwise("expired")
    return seen.select("event_id", "cache_key", outcome.alias("outcome"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def cache_eligible(tokens: Column) -> Column:
    return tokens >= CACHE_MIN_TOKENS


def ingest_stats(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.groupBy(group).agg(F.count_if(F.col("chunk_type") == "text").alias("n_text"), F.count_if(F.col("chunk_type") == "multimodal").alias("n_multimodal"))
