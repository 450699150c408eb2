"""The registered queries written independently in ANSI SQL."""

from __future__ import annotations

from .. import config as C

BASE = 1_704_067_200_000_000
MINUTE = 60_000_000
DAY = 86_400_000_000


def text(value: str) -> str:
    """SQL string literal; line breaks and quotes are spelled out."""
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **parts: str) -> str:
    """Concatenation that puts SQL expressions into the slots of a template."""
    out = template.replace("'", "''")
    for name, expression in parts.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return f"'{out}'"


def key(expression: str) -> str:
    return rf"'tg:' || md5(lower(regexp_replace({expression}, '^\s+|\s+$', '', 'g')))"


def any_of(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {text(n)})" for n in needles) + ")"


def sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0 + exp(-({x})::DOUBLE)))"


def lifetime(label: str) -> str:
    return f"CASE {label} WHEN 'Static' THEN 604800 WHEN 'Slow-Moving' THEN 259200 WHEN 'Volatile' THEN 300 END"


def expiry(at: str, label: str) -> str:
    return f"{at} + ({lifetime(label)})::BIGINT * 1000000"


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS at_us,
         regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k,
         user_id || ':' || event_type AS key,
         CASE event_type WHEN 'signup' THEN 'Static' WHEN 'purchase' THEN 'Slow-Moving'
              WHEN 'view' THEN 'Slow-Moving' ELSE 'Volatile' END AS true_category
  FROM events)"""

DEC = EV + """, src AS (
  SELECT *, CASE WHEN k <= 9 THEN 'REDIS_HIT' WHEN k <= 39 THEN 'CACHE_HIT_FAST'
                 WHEN k <= 49 THEN 'CACHE_HIT_VERIFIED' WHEN k <= 74 THEN 'GEMINI_API'
                 WHEN k <= 97 THEN 'GEMINI_VOLATILE' ELSE 'ERROR' END AS source
  FROM ev), dec AS (
  SELECT *, value AS latency,
         CASE WHEN source = 'GEMINI_VOLATILE' THEN 'Volatile'
              WHEN source IN ('GEMINI_API', 'CACHE_HIT_FAST')
              THEN CASE WHEN user_id % 3 = 0 THEN 'Slow-Moving' ELSE true_category END
              END AS predicted_category,
         CASE WHEN source = 'GEMINI_API'
              THEN CASE WHEN value < 40 THEN 'admitted' WHEN value < 80 THEN 'blocked' ELSE 'error' END
              END AS admission,
         event_type = 'view' AND value > 20 AS rewritten,
         source IN ('REDIS_HIT', 'CACHE_HIT_FAST', 'CACHE_HIT_VERIFIED') AS hit,
         source = 'GEMINI_API' AS api, source = 'GEMINI_VOLATILE' AS bypass
  FROM src)"""

RATE = DEC + """, rated AS (
  SELECT *, coalesce(sum(CASE WHEN api OR bypass THEN 1 ELSE 0 END) OVER (
    ORDER BY at_us RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rate
  FROM dec)"""

PAIRS = """turns AS (
  SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text, lag(turn) OVER w AS before_turn
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (
  SELECT conv_id, turn AS reply_turn, before_turn AS turn, before_text AS query, text AS response
  FROM turns WHERE role = 'assistant' AND before_role = 'user')"""

HIST = PAIRS + """, past AS (
  SELECT u.conv_id, u.turn, u.text AS query, p.query AS hq, p.response AS hr, p.reply_turn,
         row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY p.reply_turn DESC NULLS LAST) AS rn
  FROM conversations u LEFT JOIN pairs p ON p.conv_id = u.conv_id AND p.reply_turn < u.turn
  WHERE u.role = 'user'), reqs AS (
  SELECT conv_id, turn, any_value(query) AS query, count(hq) FILTER (rn <= 3) AS n,
         coalesce(string_agg(hq || ': ' || hr, chr(10) ORDER BY reply_turn) FILTER (rn <= 3 AND hq IS NOT NULL), '') AS htext,
         max(hq) FILTER (rn = 1) AS last_query, max(hr) FILTER (rn = 1) AS last_response
  FROM past GROUP BY conv_id, turn), sig AS (
  SELECT *, list_has_any(string_split_regex(lower(query), '\\s+'), [%s]) AS signalled FROM reqs)""" % ", ".join(
    text(s) for s in C.CONTEXT_SIGNALS
)

ENTRIES = f"""cat AS (
  SELECT *, CASE lang WHEN 'en' THEN 'Static' WHEN 'fr' THEN 'Slow-Moving' WHEN 'de' THEN 'Slow-Moving'
            ELSE 'Volatile' END AS category, {BASE} + doc_id * {MINUTE} AS cached_us FROM documents), ent AS (
  SELECT doc_id, {key('text')} AS entry_key, source || ':' || lang AS answer, category, cached_us,
         {expiry('cached_us', 'category')} AS expires_us FROM cat), cache AS (
  SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY cached_us DESC) = 1)"""

SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"

KNN = f"""pairs AS (
  SELECT a.vec_id AS req_id, a.label, b.vec_id AS entry_key, b.label AS entry_label, {SIM} AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), near AS (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY similarity DESC, entry_key) AS rank FROM pairs
  QUALIFY rank <= 5)"""


def scored(request: str, entry: str, source: str) -> str:
    return f"""scored AS (
  SELECT *, round(2 * similarity + j / 50.0::DOUBLE, 6) AS rerank_score, (j - 3)::DOUBLE AS logit_ab,
         (j - 4)::DOUBLE AS logit_ba, round(5 * similarity, 6) AS answer_relevance
  FROM (SELECT *, ({request} * 31 + {entry} * 17) % 10 AS j FROM {source}))"""


MU = f"(({sigmoid('logit_ab')} + {sigmoid('logit_ba')}) / 2)"
NU = f"(((1 - {sigmoid('logit_ab')}) + (1 - {sigmoid('logit_ba')})) / 2)"

BEST = KNN + ", " + scored("req_id", "entry_key", "near") + f""", best AS (
  SELECT *, {NU} AS nu FROM scored
  QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY rerank_score DESC, rank) = 1)"""

WRITES = f"""writes AS (
  SELECT {key('key')} AS entry_key, at_us + 1 AS cached_us, {expiry('(at_us + 1)', 'true_category')} AS expires_us,
         CASE WHEN k = 0 THEN '' ELSE 'stored ' || event_id END AS answer, true_category AS category
  FROM ev WHERE event_type IN ('signup', 'purchase'))"""


def replayed(name: str, source: str, ttl: str) -> str:
    """Stores of each key by following, from its first request, the next one past expiry."""
    return f"""{name}_log AS (SELECT event_id, key, at_us, ({ttl})::BIGINT AS ttl FROM {source}),
{name}_next AS (
  SELECT a.key, a.at_us, min(b.at_us) AS nxt FROM {name}_log a JOIN {name}_log b
    ON a.key = b.key AND b.at_us >= a.at_us + a.ttl GROUP BY ALL),
{name}_st AS (
  SELECT key, min(at_us) AS t FROM {name}_log GROUP BY key
  UNION ALL
  SELECT s.key, n.nxt FROM {name}_st s JOIN {name}_next n ON n.key = s.key AND n.at_us = s.t),
{name} AS (
  SELECT l.event_id, l.at_us <> max(s.t) AS hit, max(s.t) + l.ttl AS expires_us
  FROM {name}_log l JOIN {name}_st s ON l.key = s.key AND l.at_us >= s.t GROUP BY l.event_id, l.at_us, l.ttl)"""


REQUESTS = f"""vec AS (
  SELECT vec_id, label, embedding, {key("('vec ' || vec_id)")} AS entry_key,
         CASE WHEN label <= 3 THEN 'Static' WHEN label <= 6 THEN 'Slow-Moving' END AS category FROM embeddings)"""

CASCADE = RATE + ", " + WRITES + ", " + REQUESTS + f""", asked AS (
  SELECT r.event_id AS req_id, r.key AS query, r.at_us, r.user_id,
         CASE WHEN k = 13 THEN 'Volatile' ELSE true_category END AS label,
         CASE WHEN k = 13 THEN 0.0::DOUBLE ELSE round(0.4::DOUBLE + k / 200.0::DOUBLE, 4) END AS confidence,
         CASE WHEN rate > 10 THEN 0.35 WHEN rate < 3 THEN 0.45 ELSE 0.40 END::DOUBLE AS threshold,
         {key('r.key')} AS query_key
  FROM rated r JOIN embeddings e ON e.vec_id = r.user_id), looked AS (
  SELECT a.*, CASE WHEN a.label <> 'Volatile' AND length(w.answer) > 0 AND a.at_us < w.expires_us THEN w.answer END AS exact_answer
  FROM asked a ASOF LEFT JOIN writes w ON w.entry_key = a.query_key AND w.cached_us <= a.at_us), pairs AS (
  SELECT a.vec_id AS user_id, b.vec_id AS cand, 'answer ' || b.vec_id AS answer, coalesce(b.category, 'Static') AS category,
         {SIM} AS similarity, b.entry_key
  FROM vec a JOIN vec b ON a.vec_id <> b.vec_id
  WHERE a.vec_id IN (SELECT user_id FROM asked)), near AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, entry_key) AS rank FROM pairs
  QUALIFY rank <= 5), """ + scored("user_id", "cand", "near") + f""", top AS (SELECT * FROM scored WHERE rank = 1), best AS (
  SELECT *, {MU} AS mu, {NU} AS nu FROM scored
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rerank_score DESC, rank) = 1), decided AS (
  SELECT l.*, t.similarity AS near_sim, t.answer AS near_answer, t.category AS near_category,
         b.answer AS best_answer, b.category AS best_category, b.rerank_score, b.answer_relevance, b.mu, b.nu,
         sqrt(greatest(0.0::DOUBLE, 1 - (b.mu * b.mu + b.nu * b.nu))) AS pi,
         CASE WHEN l.label = 'Volatile' THEN 'GEMINI_VOLATILE' WHEN exact_answer IS NOT NULL THEN 'REDIS_HIT'
              WHEN t.similarity > l.threshold THEN 'CACHE_HIT_FAST'
              WHEN b.rerank_score > 0.70 AND b.nu <= 0.30 AND b.answer_relevance > 1.50 THEN 'CACHE_HIT_VERIFIED'
              ELSE 'GEMINI_API' END AS source
  FROM looked l LEFT JOIN top t USING (user_id) LEFT JOIN best b USING (user_id))"""


def percent(part: str, whole: str) -> str:
    return f"round({part} * 100.0::DOUBLE / {whole}, 2)"


def report_counts(truth: str, predicted: str, table: str) -> str:
    return f"""cls AS (
  SELECT label, sum(tp)::BIGINT AS tp, sum(said)::BIGINT AS said, sum(support)::BIGINT AS support FROM (
    SELECT {truth}::VARCHAR AS label, ({truth} = {predicted})::INT AS tp, 0 AS said, 1 AS support FROM {table}
    UNION ALL SELECT {predicted}::VARCHAR, 0, 1, 0 FROM {table}) GROUP BY label), prf AS (
  SELECT *, coalesce(tp / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
         coalesce(2.0::DOUBLE * tp / nullif(said + support, 0), 0) AS f1 FROM cls)"""


HITS = "count(*) FILTER (hit)"
API = "count(*) FILTER (api)"
VOL = "count(*) FILTER (true_category = 'Volatile')"

ORACLES: dict[str, str] = {
    # sources and sinks
    "scan_requests": "SELECT text AS query, lang AS primary_category, source AS ground_truth_2026 FROM documents",
    "scan_labelled": """SELECT text AS "Question", CASE WHEN quality = 1 AND toxic = 0 THEN 'Static'
        WHEN quality = 1 THEN 'Slow-Moving' ELSE 'Volatile' END AS "Temporal_Category"
        FROM documents JOIN labels USING (doc_id)""",
    "scan_lines": r"""SELECT query FROM (
        SELECT regexp_replace(unnest(string_split_regex(text, '\r\n|\r|\n')), '^\s+|\s+$', '', 'g') AS query
        FROM documents) WHERE length(query) > 0""",
    "scan_conversations": f"WITH {HIST} SELECT query, n AS n_history, last_query, last_response FROM reqs",
    "scan_cache": f"""WITH {ENTRIES} SELECT category, count(*) AS entries, min(cached_us) AS oldest_us,
        max(cached_us) AS newest_us FROM cache GROUP BY category""",
    "sink_results": f"WITH {DEC} SELECT event_id, true_category, source, latency FROM dec",
    "sink_checkpoint": f"WITH {DEC} SELECT event_id, source, predicted_category, latency FROM dec",
    "sink_summary": f"""WITH {DEC}, one AS (SELECT count(*) AS total_queries_tested,
        {percent(HITS, 'count(*)')} AS effective_hit_rate_percent,
        round((1 - {API} / count(*)::DOUBLE) * 100, 2) AS api_reduction_percent,
        {percent("count(*) FILTER (true_category = 'Volatile' AND NOT bypass)", VOL)} AS staleness_rate_percent,
        {percent("count(*) FILTER (admission = 'blocked')", "count(*) FILTER (admission IN ('admitted', 'blocked'))")} AS cache_integrity,
        {percent("count(*) FILTER (predicted_category = true_category)", "count(predicted_category)")} AS ttl_category_accuracy_percent,
        avg(latency) FILTER (hit) AS hs, avg(latency) FILTER (api) AS cs,
        count(*) FILTER (admission = 'admitted') AS admitted, count(*) FILTER (admission = 'blocked') AS blocked,
        {', '.join(f"count(*) FILTER (source = '{s}') AS {s}" for s in (*C.HIT_SOURCES, C.GEMINI_API, C.GEMINI_VOLATILE, C.ERROR))}
        FROM dec) SELECT total_queries_tested, effective_hit_rate_percent, api_reduction_percent, staleness_rate_percent,
        cache_integrity, ttl_category_accuracy_percent, round(hs * 1000, 2) AS cache_hit_latency_ms,
        round(cs * 1000, 2) AS gemini_latency_ms, round(cs / hs, 1) AS speedup_factor, admitted, blocked,
        admitted + blocked AS total, {', '.join((*C.HIT_SOURCES, C.GEMINI_API, C.GEMINI_VOLATILE, C.ERROR))} FROM one""",
    # text and history
    "cache_key": f"SELECT doc_id, {key('text')} AS entry_key FROM documents",
    "needs_context": r"""SELECT conv_id, turn, list_has_any(string_split_regex(lower(text), '\s+'), [%s]) AS needs_context
        FROM conversations WHERE role = 'user'""" % ", ".join(text(s) for s in C.CONTEXT_SIGNALS),
    "history_text": f"WITH {HIST} SELECT conv_id, turn, htext AS history_text FROM reqs",
    "rewrite_prompt": f"""WITH {HIST} SELECT conv_id, turn, CASE WHEN signalled AND n > 0
        THEN {filled(C.REWRITE_TEMPLATE, context="last_query || ': ' || last_response", query="query")} ELSE query END AS prompt FROM sig""",
    "rewrite_prompt_strict": f"""WITH {HIST} SELECT conv_id, turn, CASE WHEN n > 0
        THEN {filled(C.STRICT_REWRITE_TEMPLATE, context="htext", query="query")} ELSE query END AS prompt FROM reqs""",
    "rewrite_apply": f"""WITH {HIST}, out AS (SELECT conv_id, turn, query AS asked, CASE WHEN signalled AND n > 0
        THEN upper({filled(C.REWRITE_TEMPLATE, context="last_query || ': ' || last_response", query="query")}) ELSE query END AS query FROM sig)
        SELECT conv_id, turn, query, query <> asked AS rewritten FROM out""",
    "chat_messages": f"""WITH {HIST}, used AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY reply_turn) - 1 AS i
        FROM past WHERE rn <= 3 AND hq IS NOT NULL)
        SELECT conv_id, turn, 2 * i AS pos, 'user' AS role, hq AS content FROM used
        UNION ALL SELECT conv_id, turn, 2 * i + 1, 'assistant', hr FROM used
        UNION ALL SELECT conv_id, turn, 2 * n, 'user', query FROM reqs""",
    "lifetime_keywords": f"""SELECT doc_id, CASE WHEN {any_of('text', ('now', 'the'))} THEN 'volatile'
        WHEN {any_of('text', ('ing', 'tion'))} THEN 'slow-moving' ELSE 'static' END AS category FROM documents""",
    "lifetime_ttl": f"""WITH {EV} SELECT event_id, ({lifetime('true_category')})::BIGINT AS ttl_seconds,
        CASE true_category WHEN 'Static' THEN '∞  (never expires)' WHEN 'Slow-Moving' THEN '30 days' ELSE '5 minutes' END AS ttl_display,
        (at_us + CASE true_category WHEN 'Slow-Moving' THEN 2592000 WHEN 'Volatile' THEN 300 END::BIGINT * 1000000)::DOUBLE AS expires_us FROM ev""",
    "judge_prompts": f"WITH {PAIRS} " + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{signal}' AS signal, {filled(t, query='query', response='response')} AS prompt FROM pairs"
        for signal, t in C.JUDGE_TEMPLATES.items()
    ),
    "text_clip": """SELECT doc_id, substr(text, 1, 512) AS for_relevance, substr(text, 1, 200) AS for_report,
        CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS for_listing FROM documents""",
    "cacheability_filter": f"SELECT doc_id, {any_of('text', ('thing', 'tionen', 'eaux'))} AS blocked FROM documents",
    "parse_score": rf"""WITH {EV} SELECT event_id, coalesce(nullif(regexp_extract(
        'Score ' || value || ' / ' || (k / 100.0::DOUBLE), '\b(1\.0+|0?\.\d+)\b', 1), '')::DOUBLE, 0.0) AS score FROM ev""",
    # vectors, scores, predicates
    "l2_normalize": """WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS e FROM embeddings)
        SELECT vec_id, pos - 1 AS pos, round(e[pos] / sqrt(list_dot_product(e, e)), 6) AS x
        FROM s, (SELECT unnest(range(1, 65)) AS pos)""",
    "cosine_pairs": f"SELECT a.vec_id, {SIM} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "pyfs_score": f"""WITH l AS (SELECT *, (l_quantity - 25) / 10 AS logit_ab, (l_discount - 0.05::DOUBLE) * 40 AS logit_ba FROM lineitem),
        m AS (SELECT *, {MU} AS mu, {NU} AS nu FROM l)
        SELECT l_orderkey, l_linenumber, round(mu * mu - nu * nu, 6) AS score, round(mu, 6) AS mu, round(nu, 6) AS nu,
        round(sqrt(greatest(0.0::DOUBLE, 1 - (mu * mu + nu * nu))), 6) AS pi, 0.0::DOUBLE AS neutral FROM m""",
    "dynamic_threshold": f"""WITH {RATE} SELECT event_id, rate,
        (CASE WHEN rate > 10 THEN 0.70 WHEN rate < 3 THEN 0.80 ELSE 0.75 END)::DOUBLE AS threshold FROM rated""",
    "fast_accept": f"WITH {KNN} SELECT req_id, entry_key, similarity > 0.40::DOUBLE AS accepted FROM near WHERE rank = 1",
    "floor_accept": f"WITH {KNN} SELECT req_id, entry_key, similarity FROM near WHERE rank = 1 AND similarity >= 0.35::DOUBLE",
    "verify_pair": f"""WITH {BEST} SELECT req_id, entry_key, round(nu, 6) AS nu,
        rerank_score > 0.70::DOUBLE AND nu <= 0.30::DOUBLE AND answer_relevance > 1.50::DOUBLE AS verified FROM best""",
    "admission_score": f"""WITH {EV}, s AS (SELECT event_id, coalesce(CASE WHEN k < 95 THEN k / 100.0::DOUBLE END, 0) AS r,
        (k * 7 % 101) / 100.0::DOUBLE AS c, (k * 13 % 101) / 100.0::DOUBLE AS f FROM ev),
        w AS (SELECT *, 0.5::DOUBLE * r + 0.3::DOUBLE * c + 0.2::DOUBLE * f AS combined FROM s)
        SELECT event_id, round(r, 4) AS reusability_score, round(c, 4) AS confidence_score, round(f, 4) AS faithfulness_score,
        round(combined, 4) AS combined_score, combined >= 0.5::DOUBLE AS admit_to_cache, 'triple-signal' AS mode FROM w""",
    "volatile_bypass": f"""WITH {EV} SELECT event_id, true_category = 'Volatile' AS bypass,
        CASE WHEN true_category <> 'Volatile' THEN {key('key')} END AS lookup_key FROM ev""",
    "confidence_gate": """WITH p AS (SELECT vec_id, exp(4.0::DOUBLE * embedding[1]) AS a, exp(4.0::DOUBLE * embedding[2]) AS b,
        exp(4.0::DOUBLE * embedding[3]) AS c FROM embeddings), q AS (SELECT *, greatest(a, b, c) / (a + b + c) AS top FROM p)
        SELECT vec_id, CASE WHEN top < 0.40::DOUBLE THEN 'Volatile' WHEN a >= b AND a >= c THEN 'Slow-Moving'
        WHEN b >= c THEN 'Static' ELSE 'Volatile' END AS label, round(top, 6) AS confidence,
        CASE WHEN top < 0.40::DOUBLE THEN 'fallback_low_confidence' ELSE 'embedding_classifier' END AS stage FROM q""",
    "fail_safe_label": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'Volatile' WHEN quality = 1 THEN 'Static'
        ELSE 'Slow-Moving' END AS label, CASE WHEN l.doc_id IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + toxic / 4.0::DOUBLE END AS confidence
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "prob_map": """SELECT vec_id, class, (class = CASE WHEN label <= 3 THEN 'Static' WHEN label <= 6 THEN 'Slow-Moving'
        ELSE 'Volatile' END)::INT::DOUBLE AS prob
        FROM embeddings, (SELECT unnest(['Static', 'Slow-Moving', 'Volatile']) AS class)""",
    # joins
    "exact_lookup": f"""WITH {EV}, {WRITES}, f AS (SELECT e.event_id, w.answer, w.category, w.cached_us,
        coalesce(length(w.answer) > 0 AND e.at_us < w.expires_us, false) AS hit
        FROM ev e ASOF LEFT JOIN writes w ON w.entry_key = {key('e.key')} AND w.cached_us <= e.at_us)
        SELECT event_id, hit, CASE WHEN hit THEN answer END AS answer, CASE WHEN hit THEN category END AS category,
        CASE WHEN hit THEN cached_us::DOUBLE END AS cached_us FROM f""",
    "exact_lookup_snapshot": f"""WITH {ENTRIES}, f AS (SELECT d.doc_id, c.answer, c.category,
        c.cached_us <= {BASE + 4 * DAY} AND length(c.answer) > 0 AND {BASE + 4 * DAY} < c.expires_us AS hit
        FROM ent d JOIN cache c USING (entry_key))
        SELECT doc_id, hit, CASE WHEN hit THEN answer END AS answer, CASE WHEN hit THEN category END AS category FROM f""",
    "knn_join": f"WITH {KNN} SELECT req_id, rank, entry_key, similarity FROM near",
    "knn_join_cells": f"WITH {KNN} SELECT req_id, rank, entry_key, similarity FROM near",
    "knn_join_approx": """SELECT vec_id AS req_id, least(5, (SELECT count(*) FROM embeddings) - 1) AS n,
        true AS true_similarity, true AS recall_reached FROM embeddings""",
    "nearest_one": f"WITH {KNN} SELECT req_id, entry_key, similarity FROM near WHERE rank = 1 AND similarity >= 0.35::DOUBLE",
    "memo_score_join": """SELECT doc_id, round(length(text) / (length(replace(text, ' ', '')) + 1)::DOUBLE, 6) AS score FROM documents""",
    "label_vs_prediction": """SELECT doc_id, quality::VARCHAR AS truth, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS predicted,
        quality = CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS correct FROM labels JOIN documents USING (doc_id)""",
    "evict_anti_join": f"""WITH {ENTRIES} SELECT entry_key FROM cache
        QUALIFY row_number() OVER (ORDER BY cached_us, entry_key) > greatest(1, (count(*) OVER ()) // 10)""",
    # aggregations
    "decision_counters": f"""WITH {DEC} SELECT count(*) FILTER (source = 'REDIS_HIT') AS redis_hits,
        count(*) FILTER (source = 'CACHE_HIT_FAST') AS chroma_hits_fast,
        count(*) FILTER (source = 'CACHE_HIT_VERIFIED') AS chroma_hits_verified,
        count(*) FILTER (bypass) AS volatile_bypasses, {API} AS gemini_calls,
        count(*) FILTER (admission = 'admitted') AS gate3_admitted, count(*) FILTER (admission = 'blocked') AS gate3_blocked,
        count(*) FILTER (admission = 'error') AS gate3_errors, count(*) FILTER (source <> 'ERROR') AS total_queries,
        count(*) FILTER (rewritten) AS gate1_rewrites FROM dec""",
    "live_stats": f"""WITH {DEC}, c AS (SELECT greatest(1, count(*)) AS n, {HITS} AS h, {API} AS a FROM dec WHERE source <> 'ERROR')
        SELECT n AS total_queries, {percent('h', 'n')} AS hit_rate_percent, round((1 - a / n::DOUBLE) * 100, 2) AS api_reduction_percent FROM c""",
    "effective_hit_rate": f"""WITH {DEC} SELECT count(*) AS total, {HITS} AS cache_hits,
        count(*) FILTER (bypass) AS volatile_bypasses, {API} AS gemini_calls, {percent(HITS, 'count(*)')} AS hit_rate_percent,
        round((1 - {API} / count(*)::DOUBLE) * 100, 2) AS api_reduction_percent FROM dec""",
    "staleness_rate": f"""WITH {DEC} SELECT {VOL} AS volatile_queries,
        count(*) FILTER (true_category = 'Volatile' AND NOT bypass) AS not_bypassed,
        {percent("count(*) FILTER (true_category = 'Volatile' AND NOT bypass)", f"greatest(1, {VOL})")} AS staleness_rate_percent FROM dec""",
    "stale_served_rate": f"""WITH {DEC} SELECT {VOL} AS volatile_queries,
        count(*) FILTER (true_category = 'Volatile' AND hit) AS served_from_cache,
        {percent("count(*) FILTER (true_category = 'Volatile' AND hit)", f"greatest(1, {VOL})")} AS stale_served_percent FROM dec""",
    "label_accuracy": f"""WITH {DEC} SELECT count(predicted_category) AS labelled,
        count(*) FILTER (predicted_category = true_category) AS correct,
        coalesce({percent("count(*) FILTER (predicted_category = true_category)", "nullif(count(predicted_category), 0)")}, 0) AS category_accuracy_percent FROM dec""",
    "category_breakdown": f"""WITH {DEC} SELECT true_category, count(*) AS queries,
        round(avg(coalesce(predicted_category = true_category, false)::INT) * 100, 2) AS accuracy_percent,
        round(avg(hit::INT) * 100, 2) AS hit_rate_percent, round(avg(latency) * 1000, 2) AS avg_latency_ms FROM dec GROUP BY 1""",
    "latency_summary": f"""WITH {DEC}, a AS (SELECT coalesce(avg(latency) FILTER (hit), 0) AS h, coalesce(avg(latency) FILTER (api), 0) AS u FROM dec)
        SELECT round(h * 1000, 2) AS cache_hit_latency_ms, round(u * 1000, 2) AS gemini_latency_ms,
        CASE WHEN h > 0 THEN round(u / h, 1) END AS speedup_factor FROM a""",
    "latency_percentiles": f"""WITH {DEC}, us AS (
        SELECT source, greatest(0, round(latency * 1000000)::BIGINT) AS us FROM dec WHERE latency IS NOT NULL), cut AS (
        SELECT source, us - us % (10 ** greatest(0, length(us::VARCHAR) - 3))::BIGINT AS us FROM us)
        SELECT source, count(*) AS n, quantile_disc(us, 0.5) / 1000.0::DOUBLE AS p50_ms,
        quantile_disc(us, 0.95) / 1000.0::DOUBLE AS p95_ms, quantile_disc(us, 0.99) / 1000.0::DOUBLE AS p99_ms FROM cut GROUP BY source""",
    "source_breakdown": f"WITH {DEC} SELECT source, count(*) AS n FROM dec GROUP BY source",
    "admission_integrity": f"""WITH {DEC} SELECT count(*) FILTER (admission = 'admitted') AS admitted,
        count(*) FILTER (admission = 'blocked') AS blocked, count(*) FILTER (admission IN ('admitted', 'blocked')) AS total,
        {percent("count(*) FILTER (admission = 'blocked')", "nullif(count(*) FILTER (admission IN ('admitted', 'blocked')), 0)")} AS cache_integrity_percent FROM dec""",
    "batch_throughput": f"""WITH {DEC} SELECT count(latency) AS queries, round(sum(latency), 4) AS total_seconds,
        round(sum(latency) * 1000 / count(latency), 4) AS ms_per_query FROM dec""",
    "cost_summary": f"""WITH {DEC}, c AS (SELECT count(*) AS n, count(*) FILTER (api OR bypass) AS u FROM dec),
        s AS (SELECT *, n * 0.00004::DOUBLE + u * 0.01::DOUBLE AS spent FROM c)
        SELECT n AS queries, u AS upstream_calls, round(n * 0.01::DOUBLE, 4) AS cost_without_cache, round(spent, 4) AS cost_with_cache,
        round(spent / n, 6) AS cost_per_query, round(n * 0.01::DOUBLE / spent, 4) AS cost_ratio,
        0.4::DOUBLE AS break_even_hit_rate_percent FROM s""",
    "cache_sizes": f"""WITH {ENTRIES}, {EV}, {WRITES} SELECT (SELECT count(*) FROM cache) AS semantic_entries,
        (SELECT count(DISTINCT entry_key) FROM writes) AS exact_entries""",
    "wrong_hits": f"""WITH {DEC}, r AS (SELECT true_category,
        list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.05::DOUBLE AS wrong
        FROM dec JOIN embeddings a ON a.vec_id = user_id JOIN embeddings b ON b.vec_id = k WHERE hit)
        SELECT CASE WHEN grouping(true_category) = 1 THEN 'ALL' ELSE true_category END AS true_category, count(*) AS hits,
        count(*) FILTER (wrong) AS wrong, {percent('count(*) FILTER (wrong)', 'greatest(1, count(*))')} AS wrong_percent
        FROM r GROUP BY ROLLUP (true_category)""",
    "classification_report": f"""WITH {report_counts('quality', 'toxic', 'labels')}
        SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM prf
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support)::DOUBLE, 4), sum(support)::BIGINT FROM prf
        UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM prf
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
        round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM prf""",
    "one_vs_rest_counts": f"""WITH {report_counts('quality', 'toxic', 'labels')}
        SELECT label, tp, (SELECT count(*) FROM labels) - said - support + tp AS tn, said - tp AS fp, support - tp AS fn,
        round(recall, 3) AS recall, round(f1, 3) AS f1 FROM prf""",
    "class_weights": """SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings)
        / ((SELECT count(DISTINCT label) FROM embeddings) * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY label""",
    "policy_ablation": f"""WITH {BEST}, r AS (SELECT b.req_id, b.label, n.similarity AS near_sim, n.entry_label <> n.label AS wrong,
        b.rerank_score, b.label <= 6 AS stable, n.similarity > 0.40::DOUBLE AS fast,
        b.rerank_score > 0.70::DOUBLE AND nu <= 0.30::DOUBLE AND answer_relevance > 1.50::DOUBLE AS verified
        FROM best b JOIN near n ON n.req_id = b.req_id AND n.rank = 1), p AS (
        SELECT 'full' AS policy, stable AND (fast OR verified) AS hit, wrong FROM r
        UNION ALL SELECT 'no_context', stable AND (fast OR verified) AND label > 0, wrong FROM r
        UNION ALL SELECT 'no_lifetime', fast OR verified, wrong FROM r
        UNION ALL SELECT 'no_verification', stable AND (fast OR rerank_score > 0.70::DOUBLE), wrong FROM r
        UNION ALL SELECT 'cosine_only', near_sim >= 0.35::DOUBLE, wrong FROM r)
        SELECT policy, count(*) AS queries, {HITS} AS hits, count(*) FILTER (hit AND wrong) AS false_hits,
        {percent(HITS, 'count(*)')} AS hit_rate_percent,
        coalesce({percent('count(*) FILTER (hit AND wrong)', f'nullif({HITS}, 0)')}, 0) AS false_positive_percent FROM p GROUP BY policy""",
    "threshold_sweep": f"""WITH {KNN}, t AS (SELECT unnest(range(101)) AS i), s AS (
        SELECT i, similarity >= i / 100.0::DOUBLE AS hit, entry_label <> label AS wrong FROM near, t WHERE rank = 1)
        SELECT i / 100.0::DOUBLE AS threshold, count(*) AS queries, {HITS} AS hits, count(*) FILTER (hit AND wrong) AS false_hits,
        {percent(HITS, 'count(*)')} AS hit_rate_percent,
        coalesce({percent('count(*) FILTER (hit AND wrong)', f'nullif({HITS}, 0)')}, 0) AS false_positive_percent FROM s GROUP BY i""",
    "baseline_policy": f"""WITH RECURSIVE {EV}, storable AS (SELECT * FROM ev WHERE true_category <> 'Volatile'),
        {replayed('flat', 'ev', str(DAY))}, {replayed('tiered', 'storable', f'({lifetime("true_category")})::BIGINT * 1000000')}, {KNN}
        SELECT 'flat_24h' AS policy, count(*) FILTER (hit) AS hits FROM flat
        UNION ALL SELECT 'per_class', count(*) FILTER (hit) FROM tiered
        UNION ALL SELECT 'flat_cosine', count(*) FILTER (similarity >= 0.35::DOUBLE) FROM near WHERE rank = 1""",
    # windows, order, maintenance
    "history_last3": f"""WITH {HIST} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY reply_turn) - 1 AS pos,
        hq AS past_query, hr AS past_response FROM past WHERE rn <= 3 AND hq IS NOT NULL""",
    "last_context": f"WITH {HIST} SELECT conv_id, turn, last_query, last_response FROM reqs",
    "api_rate_60s": f"WITH {RATE} SELECT event_id, rate FROM rated",
    "best_candidate": f"WITH {BEST} SELECT req_id, entry_key, rank, rerank_score FROM best",
    "topk_candidates": f"""WITH {KNN}, {scored('req_id', 'entry_key', 'near')} SELECT req_id,
        row_number() OVER (PARTITION BY req_id ORDER BY answer_relevance DESC, entry_key) AS rank, entry_key, answer_relevance
        FROM (SELECT * EXCLUDE (rank) FROM scored) QUALIFY rank <= 3""",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "stratified_split": """SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
        ORDER BY substr(md5(doc_id || ':42'), 1, 15), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM labels""",
    "stratified_folds": """SELECT vec_id, label, 5 * (row_number() OVER (PARTITION BY label
        ORDER BY substr(md5(vec_id || ':42'), 1, 15), vec_id) - 1) // count(*) OVER (PARTITION BY label) AS fold FROM embeddings""",
    "recent_log": f"""WITH {DEC} SELECT event_id, at_us, admission FROM dec WHERE admission IS NOT NULL
        ORDER BY at_us DESC, event_id DESC LIMIT 100""",
    "cache_upsert": f"""WITH {ENTRIES}, fresh AS (SELECT entry_key, 'new ' || answer AS answer, cached_us + {DAY} AS cached_us,
        expires_us + {DAY} AS expires_us FROM ent WHERE category = 'Static'
        QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY cached_us DESC) = 1)
        SELECT * FROM fresh UNION ALL SELECT entry_key, answer, cached_us, expires_us FROM cache
        WHERE entry_key NOT IN (SELECT entry_key FROM fresh)""",
    "evict_oldest": f"""WITH {ENTRIES} SELECT entry_key, cached_us FROM cache
        QUALIFY row_number() OVER (ORDER BY cached_us, entry_key) > greatest(1, (count(*) OVER ()) // 10)""",
    "cache_clear": f"WITH {ENTRIES} SELECT 0 AS version, count(*) AS entries FROM cache UNION ALL SELECT 1, 0",
    "exact_refresh": f"""WITH {CASCADE}, h AS (SELECT query_key, at_us, CASE source WHEN 'CACHE_HIT_FAST' THEN near_answer ELSE best_answer END AS answer,
        CASE source WHEN 'CACHE_HIT_FAST' THEN near_category ELSE best_category END AS category
        FROM decided WHERE source IN ('CACHE_HIT_FAST', 'CACHE_HIT_VERIFIED'))
        SELECT query_key AS entry_key, answer, category, at_us AS cached_us, {expiry('at_us', 'category')} AS expires_us FROM h""",
    # cascade, replay, streams
    "cascade_batch": f"""WITH {CASCADE} SELECT req_id, source,
        CASE WHEN source LIKE 'GEMINI%' THEN label WHEN source = 'CACHE_HIT_FAST' THEN near_category END AS category,
        CASE WHEN source LIKE 'GEMINI%' THEN confidence END AS confidence,
        CASE source WHEN 'REDIS_HIT' THEN exact_answer WHEN 'CACHE_HIT_FAST' THEN near_answer
             WHEN 'CACHE_HIT_VERIFIED' THEN best_answer ELSE '[LLM placeholder for: ' || query || ']' END AS answer,
        CASE WHEN source = 'CACHE_HIT_FAST' THEN round(near_sim, 4) END AS similarity,
        {', '.join(f"CASE WHEN source = 'CACHE_HIT_VERIFIED' THEN round({c}, 4) END AS {c}" for c in ('rerank_score', 'answer_relevance', 'mu', 'nu', 'pi'))},
        CASE source WHEN 'CACHE_HIT_FAST' THEN near_category WHEN 'CACHE_HIT_VERIFIED' THEN best_category END AS cached_category
        FROM decided""",
    "cascade_prototype": f"""WITH {REQUESTS}, pairs AS (SELECT a.vec_id AS req_id, b.vec_id AS cand, b.entry_key, b.category, {SIM} AS similarity
        FROM vec a JOIN vec b ON a.vec_id <> b.vec_id), near AS (SELECT * FROM pairs
        QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY similarity DESC, entry_key) = 1), kept AS (
        SELECT * FROM near WHERE similarity >= 0.35::DOUBLE), {scored('req_id', 'cand', 'kept')}, d AS (
        SELECT v.vec_id, v.label, 'vec ' || v.vec_id AS query, s.cand, s.entry_key, s.category AS cached_category, 2 * {MU} - 1 AS pair_score,
        CASE WHEN v.label = 0 THEN 'redis_hit' WHEN 2 * {MU} - 1 >= 0.35::DOUBLE THEN 'chroma_hit' ELSE 'llm' END AS source
        FROM vec v LEFT JOIN scored s ON s.req_id = v.vec_id)
        SELECT vec_id AS req_id, source, CASE source WHEN 'redis_hit' THEN 'keyed ' || vec_id WHEN 'chroma_hit' THEN 'answer ' || cand
        ELSE '[LLM placeholder for: ' || query || ']' END AS answer,
        CASE source WHEN 'llm' THEN CASE WHEN contains(query, '7') THEN 'volatile' WHEN contains(query, '3') THEN 'slow-moving' ELSE 'static' END
        WHEN 'chroma_hit' THEN cached_category END AS category,
        CASE WHEN source <> 'redis_hit' THEN round(pair_score, 6) END AS pair_score,
        CASE WHEN source = 'chroma_hit' THEN entry_key END AS served_key FROM d""",
    "ttl_replay": f"WITH RECURSIVE {EV}, {replayed('r', 'ev', str(3 * DAY))} SELECT event_id, hit, expires_us FROM r",
    "ttl_replay_stream": f"WITH RECURSIVE {EV}, {replayed('r', 'ev', str(3 * DAY))} SELECT event_id, hit, expires_us FROM r",
    "stream_counters": f"""WITH {DEC} SELECT epoch_us(date_trunc('hour', ts)) AS window_us, source, count(*) AS n FROM dec GROUP BY 1, 2""",
    "stream_rate": f"""WITH {DEC}, w AS (SELECT at_us // 600000000 * 600000000 - unnest(range(0, 6)) * 600000000 AS window_us FROM dec
        WHERE api OR bypass) SELECT window_us, count(*) AS calls FROM w GROUP BY 1""",
}


def _judged(query: str, answer: str, source: str, blocked: str) -> str:
    def reply(template: str, step: int) -> str:
        prompt = filled(template, query=query, response=answer)
        value = rf"(length({prompt}) * {step} % 101) / 100.0::DOUBLE"
        return rf"coalesce(nullif(regexp_extract('Score: ' || ({value}), '\b(1\.0+|0?\.\d+)\b', 1), '')::DOUBLE, 0)"

    steps = {"reusability": 1, "confidence": 7, "faithfulness": 13}
    columns = ", ".join(
        f"CASE WHEN {blocked} THEN 0.0::DOUBLE ELSE {reply(C.JUDGE_TEMPLATES[s], n)} END AS {s[0]}" for s, n in steps.items()
    )
    return f"""raw AS (SELECT *, {blocked} AS blocked, {columns} FROM {source}), judged AS (
        SELECT *, 0.5::DOUBLE * r + 0.3::DOUBLE * c + 0.2::DOUBLE * f AS combined FROM raw)"""


_BLOCKED = any_of("response", ("thing", "tionen", "eaux"))
_PAIRS_JUDGED = f"{PAIRS}, {_judged('query', 'response', 'pairs', _BLOCKED)}"

ORACLES["admission_log"] = f"""WITH {_PAIRS_JUDGED} SELECT conv_id, turn, round(r, 4) AS reusability_score,
    round(c, 4) AS confidence_score, round(f, 4) AS faithfulness_score, round(combined, 4) AS combined_score,
    NOT blocked AND combined >= 0.5::DOUBLE AS admit_to_cache,
    CASE WHEN blocked THEN 'blocked: heuristic' ELSE 'triple-signal' END AS mode FROM judged"""

ORACLES["admit_and_store"] = f"""WITH RECURSIVE {_PAIRS_JUDGED}, {ENTRIES}, old AS (
    SELECT entry_key, category, cached_us, expires_us, row_number() OVER (ORDER BY cached_us, entry_key) AS pos FROM cache), latest AS (
    SELECT {key('query')} AS entry_key, CASE WHEN length(query) % 2 = 0 THEN 'Static' ELSE 'Slow-Moving' END AS category,
    {BASE + 30 * DAY} + (conv_id * 1000 + turn) * 1000000 AS cached_us FROM judged WHERE NOT blocked AND combined >= 0.5::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY entry_key ORDER BY cached_us DESC) = 1), fresh AS MATERIALIZED (
    SELECT l.*, {expiry('l.cached_us', 'l.category')} AS expires_us, row_number() OVER (ORDER BY l.cached_us, l.entry_key) AS i,
    (SELECT count(*) FROM old) + row_number() OVER (ORDER BY l.cached_us, l.entry_key) AS pos, old.pos AS was
    FROM latest l LEFT JOIN old USING (entry_key)), walk AS (
    SELECT 0::BIGINT AS i, (SELECT list(pos ORDER BY pos) FROM old) AS live
    UNION ALL SELECT f.i, list_append(list_filter(CASE WHEN len(live) >= 100 THEN live[greatest(1, len(live) // 10) + 1:] ELSE live END,
      lambda x: x <> coalesce(was, 0)), f.pos) FROM walk JOIN fresh f ON f.i = walk.i + 1), ended AS (
    SELECT unnest(live) AS pos FROM walk WHERE i = (SELECT max(i) FROM walk))
    SELECT entry_key, category, cached_us, expires_us FROM ended JOIN (SELECT entry_key, category, cached_us, expires_us, pos FROM old
      UNION ALL SELECT entry_key, category, cached_us, expires_us, pos FROM fresh) USING (pos)"""

ORACLES["memo_score_batches"] = ORACLES["memo_score_join"]
ORACLES["stream_rate_exact"] = ORACLES["api_rate_60s"]

_HALF_HOUR = 1_800_000_000
_BAND = "CASE WHEN {n} > 10 THEN 0.35::DOUBLE WHEN {n} < 3 THEN 0.45::DOUBLE ELSE 0.40::DOUBLE END"

# requests in order of time, one by one: the newest calls are carried along
ORACLES["cascade_stream"] = f"""WITH RECURSIVE {DEC}, asked AS (
    SELECT event_id AS req_id, key AS query, '[LLM placeholder for: ' || key || ']' AS response, user_id, at_us,
           CASE WHEN k = 13 THEN 'Volatile' ELSE true_category END AS label
    FROM dec JOIN embeddings ON vec_id = user_id), miss AS (SELECT * FROM asked WHERE label <> 'Volatile'),
    {_judged('query', 'response', 'miss', any_of('response', C.UNCACHEABLE_PHRASES))}, stored AS (
    SELECT query, user_id, max(at_us) AS cached_us, max({expiry('at_us', 'label')}) AS expires_us
    FROM judged WHERE NOT blocked AND combined >= 0.5::DOUBLE GROUP BY query, user_id), sims AS (
    SELECT a.vec_id AS user_id, max({SIM}) AS s FROM embeddings a JOIN embeddings b ON b.vec_id IN (SELECT user_id FROM stored)
    WHERE a.vec_id IN (SELECT user_id FROM asked) GROUP BY a.vec_id), again AS (
    SELECT a.req_id, a.label, a.at_us + {MINUTE} AS at_us, s,
           coalesce(cached_us <= a.at_us + {MINUTE} AND a.at_us + {MINUTE} < expires_us, false) AS known
    FROM asked a LEFT JOIN stored st ON st.query = a.query LEFT JOIN sims ON sims.user_id = a.user_id), called AS (
    SELECT at_us, 1 AS c0, 1 AS c1, 1 AS c2 FROM asked UNION ALL
    SELECT at_us, {', '.join(f"(label = 'Volatile' OR NOT known AND coalesce(s, 0) <= {t}::DOUBLE)::INT" for t in (0.35, 0.40, 0.45))} FROM again), instants AS MATERIALIZED (
    SELECT at_us, sum(c0)::BIGINT AS c0, sum(c1)::BIGINT AS c1, sum(c2)::BIGINT AS c2, row_number() OVER (ORDER BY at_us) AS i FROM called GROUP BY at_us), walk AS (
    SELECT 0::BIGINT AS i, 0::BIGINT AS at_us, 0::DOUBLE AS threshold, []::BIGINT[] AS calls
    UNION ALL SELECT i, at_us, threshold, list_concat(calls, list_transform(range(CASE threshold WHEN 0.35::DOUBLE THEN c0 WHEN 0.40::DOUBLE THEN c1 ELSE c2 END), lambda x: at_us))[-11:]
    FROM (SELECT n.*, w.calls, {_BAND.format(n=f"len(list_filter(w.calls, lambda x: n.at_us - x < {_HALF_HOUR}))")} AS threshold
      FROM walk w JOIN instants n ON n.i = w.i + 1))
    SELECT 0::BIGINT AS batch, req_id, CASE label WHEN 'Volatile' THEN 'GEMINI_VOLATILE' ELSE 'GEMINI_API' END AS source,
      CASE WHEN label <> 'Volatile' THEN {_BAND.format(n=f"(count(*) OVER (ORDER BY at_us RANGE BETWEEN {_HALF_HOUR - 1} PRECEDING AND 1 PRECEDING))")} END AS threshold,
      NULL::DOUBLE AS similarity FROM asked
    UNION ALL SELECT 1, req_id, CASE WHEN label = 'Volatile' THEN 'GEMINI_VOLATILE' WHEN known THEN 'REDIS_HIT'
      WHEN s > threshold THEN 'CACHE_HIT_FAST' ELSE 'GEMINI_API' END, CASE WHEN label <> 'Volatile' AND NOT known THEN threshold END,
      CASE WHEN label <> 'Volatile' AND NOT known AND s > threshold THEN round(s, 4) END
    FROM again JOIN walk USING (at_us)"""
