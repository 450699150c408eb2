"""SQL of the queries that SQL can express."""


def _url_rounds(rounds: int = 10, damping: float = 0.85) -> str:
    """One table of ranks per round of the link propagation."""
    return ",\n".join(
        f"""r{i + 1} AS MATERIALIZED (
  SELECT s.host, trusted + {damping} * coalesce((SELECT sum(trust * along) FROM edges e JOIN r{i} ON r{i}.host = e.src WHERE e.dst = s.host), 0) AS trust,
    blocked + {damping} * coalesce((SELECT sum(distrust * against) FROM edges e JOIN r{i} ON r{i}.host = e.dst WHERE e.src = s.host), 0) AS distrust
  FROM seeds s)"""
        for i in range(rounds)
    )

ORACLES = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents),
sources AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, struct_pack(a := ratio, b := key)) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT key, source_size, coalesce(least(cap, (SELECT level FROM level) * weight), cap) AS target FROM weighed),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
hashed AS (SELECT key, h, sum(size)::BIGINT AS size FROM sized GROUP BY key, h),
cuts AS (
  SELECT key, max(h) AS cut FROM (
    SELECT key, h, sum(size) OVER (PARTITION BY key ORDER BY h) - size / 2.0 AS middle, rest
    FROM hashed JOIN rests USING (key)) WHERE rest > 0 AND middle <= rest GROUP BY key)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN h <= coalesce(cut, '') THEN 1 ELSE 0 END) AS taken
FROM sized JOIN rests USING (key) LEFT JOIN cuts USING (key)
""",
    "op2_topk_threshold": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op8_multi_index_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
""",
    "op5_url_links": rf"""
WITH parts AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT page_id, host, path, html,
    (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT arg_max(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS verdict
  FROM parts),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM ruled),
targets AS (
  SELECT src, translate(coalesce(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '://([^/?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs WHERE contains(link, '://') OR starts_with(link, '//')),
counted AS (SELECT src, dst, count(*) AS n FROM targets WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS along, n / sum(n) OVER (PARTITION BY dst) AS against FROM counted),
shares AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trusted, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked
  FROM ruled WHERE host <> '' GROUP BY host),
hosts AS (SELECT host FROM shares UNION SELECT src FROM edges UNION SELECT dst FROM edges),
seeds AS MATERIALIZED (SELECT host, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked FROM hosts LEFT JOIN shares USING (host)),
r0 AS MATERIALIZED (SELECT host, trusted AS trust, blocked AS distrust FROM seeds),
{_url_rounds()}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN r10 USING (host)
""",
    "op11_hybrid_search": r"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM found WHERE len(terms) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
words AS (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM found),
postings AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM words
  WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, stats GROUP BY term, nd),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), stats GROUP BY item_id, row),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op12_fill_in_middle": """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
parts AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
cuts AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q FROM parts),
pieces AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
""",
}
