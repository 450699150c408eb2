"""Constants of the decision cascade, gathered in one frozen object.

Everything here is a default.  Each operator takes the values it needs as
arguments, so a caller can swap word lists, lifetimes and thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Labels, word lists, templates and limits that must keep their
# exact content for results to be comparable with existing decision logs.
# ---------------------------------------------------------------------------

STATIC = "Static"
SLOW = "Slow-Moving"
VOLATILE = "Volatile"
UNKNOWN = "Unknown"
CLASSES = (STATIC, SLOW, VOLATILE)

REDIS_HIT = "REDIS_HIT"
CACHE_HIT_FAST = "CACHE_HIT_FAST"
CACHE_HIT_VERIFIED = "CACHE_HIT_VERIFIED"
GEMINI_API = "GEMINI_API"
GEMINI_VOLATILE = "GEMINI_VOLATILE"
ERROR = "ERROR"
HIT_SOURCES = (REDIS_HIT, CACHE_HIT_FAST, CACHE_HIT_VERIFIED)

KEY_PREFIX = "tg:"

# Lifetimes in seconds; None means "never expires".
LIVE_LIFETIMES = {STATIC: 7 * 86400, SLOW: 3 * 86400, VOLATILE: 300}
SERVER_LIFETIMES = {STATIC: None, SLOW: 30 * 86400, VOLATILE: 300}
CLASSIFIER_LIFETIMES = {STATIC: None, SLOW: 30 * 86400, VOLATILE: 300}
PROTOTYPE_LIFETIMES = {"static": None, "slow-moving": 30 * 86400, "volatile": 300}
LIFETIME_DISPLAY = {
    STATIC: "∞  (never expires)",
    SLOW: "30 days",
    VOLATILE: "5 minutes",
}

CONTEXT_SIGNALS = (
    "it", "he", "she", "they", "that", "this", "him", "her", "then", "there",
    "his", "their", "its",
)
VOLATILE_KEYWORDS = (
    "now", "right now", "today", "currently", "live", "real-time",
    "stock price", "current price", "latest news", "breaking",
)
SLOW_KEYWORDS = (
    "latest version", "current version", "recommended", "policy",
    "regulation", "law", "salary", "pricing", "cost", "fee",
)
UNCACHEABLE_PHRASES = (
    "please provide more context",
    "i need more information",
    "could you clarify",
    "can you clarify",
    "it depends",
    "unclear",
    "which one do you mean",
)

SCORE_PATTERN = r"\b(1\.0+|0?\.\d+)\b"

REWRITE_TEMPLATE = (
    "Given the following context, rewrite the question to be fully standalone and clear.\n\n"
    "Context: {context}\n"
    "Question: {query}\n\n"
    "Rewritten Question:"
)
STRICT_REWRITE_TEMPLATE = (
    "You are a query rewriting system.\n\n"
    "Your task is to rewrite the current query into a clear, standalone question "
    "by resolving ambiguous references (e.g., 'it', 'they', 'this') using ONLY the "
    "provided conversation history.\n\n"
    "STRICT RULES:\n"
    "1. Preserve the original meaning exactly. Do NOT add, remove, or infer new information.\n"
    "2. Only rewrite if the history clearly resolves ambiguity.\n"
    "3. If the history is irrelevant, insufficient, or ambiguous, return the original query EXACTLY.\n"
    "4. Do NOT answer the question.\n"
    "5. Do NOT explain your reasoning.\n"
    "6. Output ONLY the final query text.\n\n"
    "History:\n"
    "{context}\n\n"
    "Current Query:\n"
    "{query}\n\n"
    "Final Query:"
)
CONFIDENCE_TEMPLATE = """You are a cache quality evaluator.

Query: "{query}"
Response: "{response}"

Should this response be cached for future reuse?

A response is worth caching ONLY if:
- it is factually accurate
- it is complete
- it is stable over time
- it directly answers the query

If the response asks for clarification or does not provide a concrete answer, return 0.0.

Output ONLY a number between 0.0 and 1.0.
"""
FAITHFULNESS_TEMPLATE = """You are a cache quality evaluator.

Query: "{query}"
Response: "{response}"

Does this response faithfully and directly answer the query?

A response is ONLY faithful if:
- it directly answers the query
- it does not hallucinate or speculate
- it provides useful information

If the response asks for clarification or does not answer the query, return 0.0.

Output ONLY a number between 0.0 and 1.0.
"""
REUSABILITY_TEMPLATE = """You are a cache quality evaluator.

Query: "{query}"
Response: "{response}"

Would this response be useful for future users asking the SAME query?

Reject responses that:
- ask for clarification
- are generic
- do not provide a concrete answer

Return a score from 0.0 to 1.0.

Output ONLY a number.
"""
JUDGE_TEMPLATES = {
    "reusability": REUSABILITY_TEMPLATE,
    "confidence": CONFIDENCE_TEMPLATE,
    "faithfulness": FAITHFULNESS_TEMPLATE,
}
JUDGE_WEIGHTS = {"reusability": 0.5, "confidence": 0.3, "faithfulness": 0.2}
MODE_BLOCKED = "blocked: heuristic"
MODE_JUDGED = "triple-signal"

ANSWER_PLACEHOLDER = "[LLM placeholder for: {query}]"

# end of fixed values -------------------------------------------------------


@dataclass(frozen=True)
class CacheConfig:
    """Thresholds and size bounds used by the plans."""

    # decision thresholds
    k: int = 5
    busy_rate: int = 10
    quiet_rate: int = 3
    busy_threshold: float = 0.70
    normal_threshold: float = 0.75
    quiet_threshold: float = 0.80
    fixed_threshold: float | None = None
    rerank_threshold: float = 0.70
    contradiction_threshold: float = 0.30
    relevance_threshold: float = 1.50
    floor_threshold: float = 0.75
    prototype_pair_threshold: float = 0.35
    confidence_threshold: float = 0.40
    fallback_label: str = VOLATILE
    admission_threshold: float = 0.5
    wrong_hit_threshold: float = 0.70
    history_turns: int = 3
    rate_seconds: int = 60
    max_entries: int = 1000
    expire_semantic: bool = False
    materialize: bool = True

    # physical bounds: what may sit in one task, or be sent to every task
    max_group_rows: int = 1_000_000
    max_broadcast_bytes: int = 64 << 20
    tile_rows: int = 8192
    max_pivots: int = 1024
    max_hot_keys: int = 10_000
