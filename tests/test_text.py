import pytest
from pyspark.sql import functions as F

from stillgood import config as C
from stillgood.functions import text

SCORES = {
    "1": 0.0, "0": 0.0, ".5": 0.0, "0.": 0.0, "": 0.0, "abc": 0.0, "0.85": 0.85, "1.0": 1.0, "1.00": 1.0,
    "10.5": 0.5, "1.05": 0.05, "2.5": 0.5, "-0.5": 0.5, "0.85/1.0": 0.85, "score: 0.7.": 0.7,
}


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_score(spark):
    got = one(spark, [(k,) for k in SCORES], "t string", "t", text.parse_score(F.col("t")))
    assert dict(got) == SCORES


def test_parse_score_lenient_and_null(spark):
    got = one(spark, [("1",), (" 1 ",), ("11",), (None,)], "t string", text.parse_score(F.col("t"), strict=False))
    assert got == [(1.0,), (1.0,), (0.0,), (None,)]


@pytest.mark.parametrize("padding", ["", " ", "\t\n", "\xa0", " 　", "\x1c\x1f", "\r\n \x85"])
def test_cache_key_ignores_case_and_outer_blanks(spark, padding):
    import hashlib

    query = f"{padding}What IS  it?{padding}"
    want = "tg:" + hashlib.md5(query.strip().lower().encode()).hexdigest()
    assert one(spark, [(query,)], "q string", text.cache_key(F.col("q"))) == [(want,)]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("what is its population?", True), ("what is it?", False), ("what is the capital of France?", False),
        ("THEN what", True), ("", False), ("tell me　it now", True),
    ],
)
def test_needs_context(spark, query, expected):
    assert one(spark, [(query,)], "q string", text.needs_context(F.col("q"))) == [(expected,)]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("What is the stock price of Apple right now?", "volatile"), ("What do we know?", "volatile"),
        ("recommended dose", "slow-moving"), ("What is Python?", "static"),
    ],
)
def test_lifetime_keywords(spark, query, expected):
    assert one(spark, [(query,)], "q string", text.lifetime_keywords(F.col("q"))) == [(expected,)]


def test_uncacheable(spark):
    rows = [("It depends on what aspect you are interested in.",), ("France won the FIFA World Cup in 2018.",), (None,)]
    assert one(spark, rows, "r string", text.uncacheable(F.col("r"))) == [(True,), (False,), (False,)]


HISTORY = [("q1", "a1"), ("q2 with % and {query}", "a2"), ("q3", "a3"), ("q4", "a4")]


def test_history_is_trimmed_and_rendered(spark):
    rows = [(HISTORY,), (HISTORY[:1],), ([],), (None,)]
    got = one(spark, rows, f"h {text.HISTORY_TYPE}", text.history_text(text.trim_history(F.col("h"))))
    assert [r[0] for r in got] == [
        "\n".join(f"{q}: {a}" for q, a in HISTORY[-3:]), "q1: a1", "", "",
    ]


def test_rewrite_prompts(spark):
    query = "what about it now"
    rows = [(query, HISTORY[:2]), (query, []), ("no signal", HISTORY), (query, None)]
    got = one(
        spark, rows, f"q string, h {text.HISTORY_TYPE}",
        text.rewrite_prompt(F.col("q"), F.col("h")), text.rewrite_prompt_strict(F.col("q"), F.col("h")),
    )
    last = ": ".join(HISTORY[1])
    whole = "\n".join(f"{q}: {a}" for q, a in HISTORY[:2])
    assert got[0] == (
        C.REWRITE_TEMPLATE.replace("{context}", last).replace("{query}", query, 1) if "{query}" not in last
        else C.REWRITE_TEMPLATE.split("{context}")[0] + last + "\nQuestion: " + query + "\n\nRewritten Question:",
        C.STRICT_REWRITE_TEMPLATE.split("{context}")[0] + whole + "\n\nCurrent Query:\n" + query + "\n\nFinal Query:",
    )
    assert got[1] == (query, query)
    assert got[2][0] == "no signal"
    assert got[3] == (query, query)


def test_chat_messages(spark):
    got = one(spark, [("now?", HISTORY[:1])], f"q string, h {text.HISTORY_TYPE}", text.chat_messages(F.col("q"), F.col("h")))
    assert [tuple(m) for m in got[0][0]] == [("user", "q1"), ("assistant", "a1"), ("user", "now?")]


def test_judge_prompts_fill_every_template(spark):
    got = one(spark, [("Q", "R")], "q string, r string", text.judge_prompts(F.col("q"), F.col("r")))
    assert {p.signal: p.prompt for p in got[0][0]} == {
        s: t.format(query="Q", response="R") for s, t in C.JUDGE_TEMPLATES.items()
    }


def test_clipping(spark):
    got = one(
        spark, [("x" * 600,), ("y" * 60,)], "t string",
        F.length(text.clip_relevance(F.col("t"))), F.length(text.clip_report(F.col("t"))), text.clip_listing(F.col("t")),
    )
    assert got == [(512, 200, "x" * 57 + "..."), (60, 60, "y" * 60)]
