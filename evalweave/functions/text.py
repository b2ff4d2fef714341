"""Rule-based text functions, as column expressions. Pattern lists are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of patterns doesn't matter, but that of the routes does.
INJECTION = ("act as unrestricted ai", "bypass safety", "ignore previous instructions", "jailbreak", "override instructions", "reveal system prompt")
CUES = ("statistics show", "experts believe", "it is widely known", "some reports indicate", "many scientists say", "research suggests", "according to recent studies", "studies have shown")
ROUTES = (
    ("workday_api", ("days off", "leave balance", "pto", "time off", "vacation")),
    ("servicenow_api", ("hardware", "incident", "keyboard", "laptop", "support request", "ticket")),
    ("policy_retriever", ("guideline", "handbook", "paid leave", "policy", "procedure", "regulation", "rule")),
)
NO_CONTEXT = ("not have enough information", "insufficient context")
DAYS, TICKET = 12, "INC0012345"
ANSWERS = {
    "unknown": "I could not determine the {} for your query.".format("appropriate tool"),
    "policy_retriever": "Here is the relevant {} section.".format("company policy"),
    "workday_api": f"Your PTO balance is {DAYS} days.",
    "servicenow_api": f"A support ticket has been created ({TICKET}).",
}
REASONS = (
    "Pipeline error",
    "No answer / insufficient context",
    "No expected answer provided",
    "Semantic mismatch — answer unrelated to expected",
    "Low similarity — partially incorrect answer",
    "Borderline — answer close but below threshold",
    "—",
)


def contains_any(text: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(p) for p in patterns), F.lit(False)), F.lit(False))


def injection_label(prompt: Column, patterns: tuple[str, ...] = INJECTION) -> Column:
    return F.when(contains_any(prompt, patterns), "Injection").otherwise("Normal")


def cue_count(response: Column, cues: tuple[str, ...] = CUES) -> Column:
    """How many of the cues occur; one that repeats counts once."""
    low = F.lower(F.coalesce(response, F.lit("")))
    return reduce(lambda a, b: a + b, (low.contains(c).cast("int") for c in cues), F.lit(0))


def hallucination_label(response: Column, cues: tuple[str, ...] = CUES) -> Column:
    n = cue_count(response, cues)
    return F.when(n == 0, "Grounded").when(n <= 2, "Possible Hallucination").otherwise("Likely Hallucination")


def route(query: Column, routes: tuple[tuple[str, tuple[str, ...]], ...] = ROUTES) -> Column:
    """The first tool one of whose keywords begins a word of the query, else unknown."""
    low = F.lower(F.coalesce(query, F.lit("")))
    out = F.lit(None).cast("string")
    for tool, words in reversed(routes):
        out = F.when(low.rlike(route_pattern(words)), tool).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def route_pattern(words: tuple[str, ...]) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words) + ")"


def tool_answer(tool: Column, answers: dict[str, str] = ANSWERS) -> Column:
    out = F.lit(answers["unknown"])
    for name, answer in answers.items():
        out = F.when(tool == name, answer).otherwise(out)
    return out


def passed(similarity: Column, threshold: float = 0.55) -> Column:
    return F.coalesce(similarity >= threshold, F.lit(False))


def failure_reason(answer: Column, similarity: Column, phrases: tuple[str, ...] = NO_CONTEXT) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return (
        F.when(low.contains("[error]"), REASONS[0])
        .when(contains_any(answer, phrases), REASONS[1])
        .when(similarity.isNull(), REASONS[2])
        .when(similarity < 0.25, REASONS[3])
        .when(similarity < 0.40, REASONS[4])
        .when(similarity < 0.55, REASONS[5])
        .otherwise(REASONS[6])
    )


def failure_severity(answer: Column, similarity: Column, phrases: tuple[str, ...] = NO_CONTEXT) -> Column:
    return F.when(contains_any(answer, phrases), "Low").when(similarity.isNull() | (similarity < 0.40), "Critical").otherwise("Medium")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Critical", 0).when(severity == "Medium", 1).otherwise(2)


def words(text: Column) -> Column:
    """The white-space separated words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.size(words(text)) / F.lit(0.75)).cast("long"))


def no_common_word(expected: Column, answer: Column) -> Column:
    return F.size(F.array_intersect(words(F.lower(expected)), words(F.lower(answer)))) == 0


def why_failed(expected: Column, answer: Column, similarity: Column) -> Column:
    """failure_reason with the similarity spelt out, and a word-overlap test where it is below 0.25."""
    share = F.format_string("%.0f%%", F.coalesce(similarity, F.lit(0.0)) * 100)
    reason = failure_reason(answer, similarity)
    unrelated = F.when(no_common_word(expected, answer), F.concat(F.lit("No word in common with the expected answer ("), share, F.lit(")")))
    return F.when(reason == REASONS[3], F.coalesce(unrelated, F.concat(reason, F.lit(" ("), share, F.lit(")")))).otherwise(reason)


def shortened(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def highlighted(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Query words of over three letters marked in a text, whole words, any case; one pass, longest first."""
    keys = sorted({w for w in query.lower().split() if len(w) > 3}, key=lambda w: (-len(w), w))
    if not keys:
        return text
    quoted = "|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in keys)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({quoted})(?![\p{{L}}\p{{N}}_])", f"{before}$1{after}")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def dataset_name(path: Column) -> Column:
    name = file_name(path)
    return F.replace(F.replace(name, F.lit(".json"), F.lit("")), F.lit(".csv"), F.lit(""))


def source_label(source: Column, chunk: Column, page: Column) -> Column:
    """Where a chunk is from; what isn't known is a question mark."""
    known = (F.coalesce(c.cast("string"), F.lit("?")) for c in (source, chunk, page))
    return F.format_string("%s – chunk %s, page %s", *known)


def timestamp_text(at: Column) -> Column:
    """A time as reports print it, in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def iso_text(at: Column) -> Column:
    """A time as it is stored in JSON."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def symbol(flag: Column, yes: str = "Pass", no: str = "Fail") -> Column:
    """A word or sign for a flag; null is as false."""
    return F.when(flag, yes).otherwise(no)


def percent(x: Column, missing: str = "—") -> Column:
    return F.when(x.isNull(), missing).otherwise(F.format_string("%.2f%%", x * 100))
