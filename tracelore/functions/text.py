"""Column expressions for text: cleaning, labels, keyword terms, prompt origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelore import params

# Every character a Unicode-aware split treats as blank.
BLANKS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

# Wrapper tag of a prompt the harness submits -> key it is read under.
PROMPT_TAGS = {
    "task-notification": "background_task_notification",
    "agent-message": "subagent_report",
    "teammate-message": "teammate_message",
    "cross-session-message": "message_from_another_session",
    "channel": "channel_message",
}


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def clip(text: Column, limit: int) -> Column:
    """Cut at ``limit`` with a three-dot tail, no whitespace before the dots."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def truncate(text: Column, limit: int = params.LEARNING_TEXT_CAP) -> Column:
    return clip(collapse(text), limit)


def hard_cap(text: Column, limit: int) -> Column:
    """Keep ``limit`` characters and say how many went."""
    return F.when(
        F.length(text) > limit,
        F.concat(
            F.substring(text, 1, limit),
            F.lit("...[truncated "),
            (F.length(text) - limit).cast("string"),
            F.lit(" chars]"),
        ),
    ).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))


def keyword_terms(text: Column, limit: int = params.KEYWORD_TERMS) -> Column:
    """First-seen distinct search terms."""
    return F.slice(F.array_distinct(tokens(F.coalesce(text, F.lit("")))), 1, limit)


def normalize_label(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def slugify(value: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("default")).otherwise(slug)


def prompt_origin(prompt: Column) -> Column:
    """Leading wrapper tag when it is a known one, else ``user``."""
    tag = F.regexp_extract(F.regexp_replace(F.coalesce(prompt, F.lit("")), "^" + BLANKS, ""), r"^<([a-z][a-z-]*)[\s>]", 1)
    return F.when(tag.isin(*PROMPT_TAGS), tag).otherwise(F.lit("user"))


def prompt_key(prompt: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in PROMPT_TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, prompt_origin(prompt)), F.lit("prompt"))


def sha16(*parts: Column) -> Column:
    """First 16 hex digits of sha1 over the parts joined by newlines."""
    return F.substring(F.sha1(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def learning_namespace(project_id: Column, scope: Column, user_id: Column) -> Column:
    return F.when(scope == "user", F.concat(F.lit("user:"), user_id.cast("string"))).otherwise(project_id.cast("string"))


def learning_id(namespace: Column, text: Column) -> Column:
    return F.concat(F.lit("learning:"), namespace, F.lit(":"), sha16(namespace, F.trim(text)))


def pattern_id(project_id: Column, normalized: Column) -> Column:
    return F.concat(F.lit("taskpattern:"), project_id.cast("string"), F.lit(":"), sha16(project_id, normalized))


def age_label(ended: Column, now: Column) -> Column:
    """'5m ago' under an hour (at least one), '3h ago' under two days, else days."""
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ended), F.lit(0))
    return (
        F.when(ended.isNull(), F.lit(""))
        .when(seconds < 3600, F.concat(F.greatest(F.lit(1), F.floor(seconds / 60)).cast("string"), F.lit("m ago")))
        .when(seconds < 48 * 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def parse_instant(text: Column) -> Column:
    """ISO text to timestamp; text without a zone is UTC (the session zone)."""
    return F.try_to_timestamp(text)


def iso_sort_key(text: Column) -> Column:
    """Timestamp text in one spelling of UTC, so text order is time order."""
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "Z$", "+00:00")


def add_months_to_first(day: Column, months: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), months)
