"""Column functions over request, history and answer text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Whitespace as Unicode-aware string stripping sees it: wider than Java's \s.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = "[" + BLANKS + "]+"

HISTORY_TYPE = "array<struct<query:string,response:string>>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def cache_key(query: Column) -> Column:
    """Exact-match key: digest of the stripped, lower-cased query."""
    return F.concat(F.lit(C.KEY_PREFIX), F.md5(F.lower(strip(query)).cast("binary")))


def needs_context(query: Column, signals: Sequence[str] = C.CONTEXT_SIGNALS) -> Column:
    """True when a signal word is a whitespace token; punctuation stays attached."""
    words = F.split(F.lower(query), WHITESPACE)
    return F.coalesce(
        F.arrays_overlap(words, F.array(*[F.lit(s) for s in signals])), F.lit(False)
    )


def history_texts(history: Column) -> Column:
    return F.transform(history, lambda m: F.concat(m["query"], F.lit(": "), m["response"]))


def history_text(history: Column) -> Column:
    return F.array_join(history_texts(history), "\n")


def trim_history(history: Column, turns: int = 3) -> Column:
    """The last ``turns`` messages; NULL becomes an empty history."""
    safe = F.coalesce(history, F.array().cast(HISTORY_TYPE))
    return F.slice(safe, F.greatest(F.size(safe) - turns + 1, F.lit(1)), turns)


def fill_template(template: str, **parts: Column) -> Column:
    """Substitute ``{name}`` slots of a constant template with columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at, name = min(
            ((rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest),
            default=(-1, ""),
        )
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def rewrite_applies(
    query: Column, history: Column, signals: Sequence[str] = C.CONTEXT_SIGNALS
) -> Column:
    return needs_context(query, signals) & (F.coalesce(F.size(history), F.lit(0)) > 0)


def rewrite_prompt(
    query: Column, history: Column, signals: Sequence[str] = C.CONTEXT_SIGNALS
) -> Column:
    """Prompt built on the most recent turn only; untouched query otherwise."""
    last = F.try_element_at(history_texts(history), F.lit(-1))
    prompt = fill_template(C.REWRITE_TEMPLATE, context=last, query=query)
    return F.when(rewrite_applies(query, history, signals), prompt).otherwise(query)


def rewrite_prompt_strict(query: Column, history: Column) -> Column:
    """Prompt over the whole history; untouched query when there is none."""
    prompt = fill_template(C.STRICT_REWRITE_TEMPLATE, context=history_text(history), query=query)
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, prompt).otherwise(query)


def chat_messages(query: Column, history: Column) -> Column:
    """Alternating user / assistant messages, then the request itself."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    past = F.flatten(
        F.transform(
            F.coalesce(history, F.array().cast(HISTORY_TYPE)),
            lambda m: F.array(message("user", m["query"]), message("assistant", m["response"])),
        )
    )
    return F.concat(past, F.array(message("user", query)))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(lowered, F.lit(needle))
    return F.coalesce(found, F.lit(False))


def lifetime_keywords(
    query: Column,
    volatile: Sequence[str] = C.VOLATILE_KEYWORDS,
    slow: Sequence[str] = C.SLOW_KEYWORDS,
) -> Column:
    """Substring rules, most volatile list first."""
    return (
        F.when(contains_any(query, volatile), F.lit("volatile"))
        .when(contains_any(query, slow), F.lit("slow-moving"))
        .otherwise(F.lit("static"))
    )


def uncacheable(response: Column, phrases: Sequence[str] = C.UNCACHEABLE_PHRASES) -> Column:
    return contains_any(response, phrases)


def judge_prompts(
    query: Column, response: Column, templates: Mapping[str, str] = C.JUDGE_TEMPLATES
) -> Column:
    """Array of (signal, prompt), one element per judged signal."""
    return F.array(
        *[
            F.struct(
                F.lit(signal).alias("signal"),
                fill_template(template, query=query, response=response).alias("prompt"),
            )
            for signal, template in templates.items()
        ]
    )


def clip_relevance(response: Column) -> Column:
    return F.substring(response, 1, 512)


def clip_report(text: Column) -> Column:
    return F.substring(text, 1, 200)


def clip_listing(text: Column) -> Column:
    return F.when(
        F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))
    ).otherwise(text)


def parse_score(raw: Column, strict: bool = True) -> Column:
    """First decimal between 0 and 1 found in a judge's reply, else 0.

    ``strict`` keeps the historic pattern, which misses a bare ``1``;
    ``strict=False`` accepts it.  NULL input (no reply at all) stays NULL.
    """
    number = F.regexp_extract(raw, C.SCORE_PATTERN, 1)
    if not strict:
        number = F.when(strip(raw) == "1", F.lit("1.0")).otherwise(number)
    value = F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(raw.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
