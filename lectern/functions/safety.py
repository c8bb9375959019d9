"""Masking of personal data and detection of prompt attacks."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity patterns, in the order in which they are applied (an address may hold an id).
EDUCATION = [
    ("INSTITUTIONAL_EMAIL", r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.edu(?:\.[a-z]{2})?\b", 0.98),
    ("MATRIC_NUMBER", r"(?i)\b[A-Z]{2,4}/20\d{2}/\d{2,4}\b", 0.95),
    ("STUDENT_ID", r"(?i)\b(?:STU|ADM|LEC|REG|MAT)[-_]?\d{5,8}\b", 0.90),
]
GENERAL = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("URL", r"https?://[^ \t\r\n<>]+"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("PHONE_NUMBER", r"\+?\d{0,3} ?\(\d{3}\) ?\d{3}-\d{4}\b"),
    ("DATE_TIME", r"\b\d{4}-\d{2}-\d{2}\b"),
]
CARD = r"\b\d{13,19}\b"
#: How sure a match of a general pattern is; a text is safe to send if no match reaches SAFE (STRICT in strict use).
SCORES = {"EMAIL_ADDRESS": 1.0, "URL": 0.75, "US_SSN": 0.85, "IP_ADDRESS": 0.75, "PHONE_NUMBER": 0.75, "DATE_TIME": 0.6, "CREDIT_CARD": 1.0}
SAFE, STRICT = 0.7, 0.5
ATTACK_CONFIDENCE = 0.95

# Attack categories, first match wins.
ATTACKS = [
    ("role_override", r"ignore\s+(all\s+)?(?:previous\s+)?instructions?|disregard\s+(?:all\s+)?(?:your\s+)?(?:previous\s+)?instructions?|forget\s+(?:all\s+)?(?:your\s+)?(?:previous\s+)?instructions?|new\s+instructions?:?\s*(?:you\s+are|act\s+as)|override\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?)|pretend\s+you\s+(?:are|have\s+no)|you\s+are\s+now\s+(?:a\s+)?(?:different|new|free)\s+ai|act\s+as\s+if\s+you\s+(?:have\s+no\s+restrictions?|are\s+not\s+a\s+tutor)"),
    ("dan_prompt", r"\bDAN\b|jailbreak\s+mode|developer\s+mode|do\s+anything\s+now|you\s+are\s+(?:jailbroken|unrestricted|unfiltered|uncensored)|enable\s+(?:developer|jailbreak|chaos)\s+mode|maximum\s+(?:power|override|mode)|\[JAILBREAK\]|\[DAN\]|\[UNRESTRICTED\]"),
    ("system_extraction", r"(?:show|print|display|reveal|output|repeat|tell\s+me|give\s+me)\s+(?:me\s+)?(?:your\s+)?(?:system\s+prompt|initial\s+instructions?|original\s+(?:prompt|instructions?)|full\s+(?:prompt|context))|what\s+(?:are|were)\s+(?:your\s+)?(?:original|initial|system)\s+instructions?|what\s+is\s+your\s+(?:system\s+)?prompt|ignore\s+the\s+above\s+and\s+(?:instead|say)|your\s+system\s+prompt|(?:show|reveal|print|display)\s+(?:your\s+)?(?:instructions?|prompt|context)"),
    ("harmful_content", r"how\s+to\s+(?:hack|crack|exploit|bypass|break\s+into)|write\s+(?:a\s+)?(?:virus|malware|ransomware|exploit|backdoor)|create\s+(?:a\s+)?(?:bomb|weapon|poison)|step(?:s|-by-step)?\s+(?:instructions?\s+)?(?:to\s+)?(?:make|build|create)\s+(?:a\s+)?(?:bomb|weapon|drug|explosive)"),
    ("academic_dishonesty", r"write\s+(?:my|the|this|an?)\s+(?:essay|assignment|report|thesis|dissertation|homework|lab\s+report|coursework)|do\s+(?:my|this|the)\s+(?:assignment|homework|quiz|exam|test)|complete\s+(?:my|this|the)\s+(?:assignment|homework|coursework)|give\s+me\s+(?:all\s+)?(?:the\s+)?answers?\s+(?:to|for)\s+(?:the\s+)?(?:quiz|exam|test|assignment)|solve\s+(?:all\s+)?(?:these|my)\s+(?:questions?|problems?)\s+(?:for\s+me)?"),
    ("topic_violation", r"what\s+is\s+(?:the\s+)?(?:weather|stock\s+price|news|sports\s+result)|recommend\s+(?:a\s+)?(?:movie|song|restaurant|hotel)|(?:book|order|buy)\s+(?:me\s+)?(?:a\s+|tickets?\s+for|some\s+)?"),
]
#: What a text holds, in lower case, wherever a pattern of the category matches: all words of one of these. They only
#: keep the patterns from texts that they cannot match in.
CUES = {
    "role_override": [("instruction",), ("override",), ("pretend",), ("you", "now"), ("you", "act")],
    "dan_prompt": [(w,) for w in ("dan", "mode", "anything", "jailbr", "unrestricted", "unfiltered", "uncensored", "maximum")],
    "system_extraction": [(w,) for w in ("instruction", "prompt", "context", "ignore")],
    "harmful_content": [(w,) for w in ("hack", "crack", "exploit", "bypass", "break", "virus", "malware", "ransomware", "backdoor", "bomb", "weapon", "poison", "drug", "explosive")],
    "academic_dishonesty": [(w,) for w in ("essay", "assignment", "report", "thesis", "dissertation", "homework", "coursework", "quiz", "exam", "test", "question", "problem")],
    "topic_violation": [(w,) for w in ("weather", "stock", "news", "sports", "movie", "song", "restaurant", "hotel", "book", "order", "buy")],
}
REFUSALS = {
    "role_override": "I keep to my role as a course tutor.",
    "dan_prompt": "That mode does not exist here; ask me about the course.",
    "system_extraction": "My set-up is not part of the course.",
    "harmful_content": "I cannot help with that.",
    "academic_dishonesty": "I can help you work on it, but not hand you the finished piece.",
    "topic_violation": "I answer questions about the course material only.",
}
DEFAULT_REFUSAL = "I cannot answer that; please ask about the course."


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)
    ds = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mask_education(text: Column) -> Column:
    for name, pattern, _ in EDUCATION:
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text


def education_spans(text: Column) -> Column:
    """array<struct<type, value, start, end, score>> of the education entities in the text, by start.

    Starts are 0-based characters. A match that overlaps one of an earlier pattern gives way, as in masking.
    """
    found = F.array().cast("array<struct<type:string,value:string,start:int,end:int,score:double>>")
    for name, pattern, score in EDUCATION:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
        starts = F.transform(values, lambda v, i: F.struct(v.alias("value"), (length(gaps, i + 1) + length(values, i)).alias("start")))  # noqa: B023
        mine = F.transform(starts, lambda s: F.struct(F.lit(name).alias("type"), s["value"].alias("value"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), F.lit(score).alias("score")))  # noqa: B023
        free = F.filter(mine, lambda m: ~F.exists(found, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])))  # noqa: B023
        found = F.concat(found, F.coalesce(free, F.array().cast("array<struct<type:string,value:string,start:int,end:int,score:double>>")))
    return F.array_sort(found, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))


def mask_cards(text: Column) -> Column:
    """Runs of 13 to 19 digits with a right check digit; other runs stay."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)))
    return F.aggregate(F.filter(runs, luhn_valid), text, lambda t, r: F.regexp_replace(t, F.concat(F.lit(r"\b"), r, F.lit(r"\b")), F.lit("<CREDIT_CARD>")))


def mask_general(text: Column, cards: bool = True) -> Column:
    """Structured entities after the education ones. Persons and places need a recogniser: pass one to safety()."""
    masked = mask_education(text)
    masked = mask_cards(masked) if cards else masked
    for name, pattern in GENERAL:
        masked = F.regexp_replace(masked, pattern, f"<{name}>")
    # Every pattern needs one of these, and most texts have none.
    return F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | text.rlike("[0-9]"), masked).otherwise(text)


def entity_types(masked: Column) -> Column:
    """Sorted distinct entity types in masked text."""
    names = [n for n, *_ in EDUCATION] + [n for n, _ in GENERAL] + ["CREDIT_CARD"]
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(masked, F.lit(f"<{n}>")), F.lit(n)) for n in sorted(names)])))


def _attack(text: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<category, matched> of the first category whose pattern occurs, each pattern run once; null for none."""
    def first(low: Column) -> Column:
        found = F.lit(None).cast("struct<category:string,matched:string>")
        for category, pattern in reversed(rules):
            hit = F.regexp_extract(text, "(?i)" + pattern, 0)
            cues = CUES[category] if (category, pattern) in ATTACKS else [()]
            able = reduce(or_, [reduce(and_, [F.contains(low, F.lit(w)) for w in words], F.lit(True)) for words in cues])
            found = F.when(able & text.rlike("(?i)" + pattern), F.struct(F.lit(category).alias("category"), F.substring(hit, 1, 100).alias("matched"))).otherwise(found)
        return found

    return F.when(F.trim(text) != "", F.transform(F.array(F.lower(text)), first)[0])


def attack_category(text: Column, rules: list[tuple[str, str]] = ATTACKS) -> Column:
    """The first category whose pattern occurs; null for none and for blank text."""
    return _attack(text, rules)["category"]


def attack_match(text: Column, rules: list[tuple[str, str]] = ATTACKS) -> Column:
    """What matched, up to 100 characters."""
    return _attack(text, rules)["matched"]


def attacks(rows: DataFrame, text_col: str = "text", rules: list[tuple[str, str]] = ATTACKS, classifier=None) -> DataFrame:
    """Adds category, matched, confidence and method (pattern).

    classifier: optional pandas UDF from text to category for what no pattern finds (method model, confidence null).
    """
    found = F.explode_outer(F.array(_attack(F.col(text_col), rules)))
    rows = rows.select("*", found.alias("attack_found"))
    hit = F.col("attack_found.category")
    more = classifier(F.col(text_col)) if classifier else F.lit(None).cast("string")
    rows = rows.withColumns({"category": F.coalesce(hit, more), "matched": F.col("attack_found.matched"), "confidence": F.when(hit.isNotNull(), F.lit(ATTACK_CONFIDENCE))})
    return rows.withColumn("method", F.when(hit.isNotNull(), "pattern").when(F.col("category").isNotNull(), "model")).drop("attack_found")


def refusal(category: Column) -> Column:
    messages = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    return F.when(category.isNotNull(), F.coalesce(F.try_element_at(messages, category), F.lit(DEFAULT_REFUSAL)))


def safe_to_send(entities: Column, strict: bool = False) -> Column:
    """Whether no entity type among these is sure enough to keep a text back."""
    least = STRICT if strict else SAFE
    scores = {name: score for name, _, score in EDUCATION} | SCORES
    return ~F.arrays_overlap(entities, F.array(*[F.lit(n) for n, score in sorted(scores.items()) if score >= least]))


def safety(rows: DataFrame, text_col: str = "text", recogniser=None, cards: bool = True, classifier=None, strict: bool = False) -> DataFrame:
    """Adds masked, entities, has_pii, safe_to_send, category, matched, confidence, method, blocked and message.

    Text is masked once, and each attack pattern runs once on the masked text. recogniser: optional pandas UDF from
    text to text that masks persons and places, applied after the patterns; classifier: see attacks.
    """
    masked = mask_general(F.coalesce(F.col(text_col), F.lit("")), cards)
    rows = rows.select("*", F.explode_outer(F.array(recogniser(masked) if recogniser else masked)).alias("masked"))
    rows = attacks(rows.withColumn("entities", entity_types(F.col("masked"))), "masked", classifier=classifier)
    return rows.withColumns({"has_pii": F.size("entities") > 0, "safe_to_send": safe_to_send(F.col("entities"), strict), "blocked": F.col("category").isNotNull(), "message": refusal(F.col("category"))})
