"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from partloom.llm import linededup, quality, sharding, urls


def op5_sql(documents: str = "documents") -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    blank = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    value = lambda r: f"{r.numerator}::double" + (f" / greatest({r.denominator}, 1)" if r.denominator else "")
    tests = [f"{value(r)} >= {r.least}" for r in quality.RULES if r.least is not None] + [f"{value(r)} <= {r.most}" for r in quality.RULES if r.most is not None]
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {documents}),
split AS (
  SELECT k, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {blank}, '')) > 0) AS l
  FROM numbered),
windows AS (SELECT k, i, list_slice(w, i, i + 7) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT k, sum(least(8, coalesce(nx - i, 8)))::bigint AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM twice) GROUP BY k),
measures AS (
  SELECT doc_id, len(w)::bigint AS n_words, length(translate(text, {blank}, ''))::bigint AS word_chars,
    (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::bigint AS n_symbols,
    (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, len(l)::bigint AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::bigint AS n_stop_words, coalesce(c.n, 0)::bigint AS n_repeat_words
  FROM split LEFT JOIN covered c USING (k)),
judged AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(tests)}) AS kept
FROM judged"""


def op10_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    )
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in urls.RULES)
    rounds, damping = 100, 0.85
    steps = "".join(
        f""",
r{i} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT kind, host, {1 - damping} * seed AS score FROM seeds
  UNION ALL SELECT e.kind, e.dst, {damping} * r.score * e.share FROM r{i - 1} r JOIN edges e ON r.kind = e.kind AND r.host = e.src) GROUP BY 1, 2)"""
        for i in range(1, rounds + 1)
    )
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, CASE {fits} END AS rule FROM p),
g AS (SELECT *, CASE rule {verdict} END AS given FROM f),
hits AS (SELECT CASE given WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM g WHERE given IS NOT NULL GROUP BY 1, 2),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM hits),
found AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:https?:)?//([^/"''?#\s>]+)', 1))) AS dst FROM g WHERE host <> '' AND html IS NOT NULL),
links AS (SELECT src, lower(dst) AS dst, count(*) AS n FROM found WHERE src <> lower(dst) GROUP BY 1, 2),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
edges AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
r0 AS (SELECT kind, host, {1 - damping} * seed AS score FROM seeds){steps},
hosts AS (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS distrust FROM r{rounds} GROUP BY 1)
SELECT page_id, g.host, path, rule, coalesce(given, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN hosts ON g.host = hosts.host"""


def _crc_table() -> str:
    """The 256 steps of CRC-32, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"{out}::bigint[]"


def op2_sql(shards: int = 40, buckets: int = 1024) -> str:
    u = lambda node: f"((('0x' || substr(md5(k || '|' || {node}), 1, 13))::bigint + 1) / 4503599627370496.0)"

    def draws(name: str, n: int) -> str:
        rows = ", ".join(f"({x.region}, {x.rack}, {x.shard}, {x.weight}::double)" for x in sharding.topology(n))
        return f"""
{name}_t AS (SELECT * FROM (VALUES {rows}) AS t(region, rack, shard, weight)),
{name}_r AS (SELECT region, sum(weight) AS weight FROM {name}_t GROUP BY 1),
{name}_k AS (SELECT region, rack, sum(weight) AS weight FROM {name}_t GROUP BY 1, 2),
{name}_1 AS (SELECT n, any_value(k) AS k, arg_min(r.region, -ln({u("r.region")}) / r.weight) AS region FROM d, {name}_r r GROUP BY n),
{name}_2 AS (SELECT n, any_value(k) AS k, p.region, arg_min(c.rack, -ln({u("c.region || '/' || c.rack")}) / c.weight) AS rack FROM {name}_1 p JOIN {name}_k c ON p.region = c.region GROUP BY n, p.region),
{name} AS (SELECT n, arg_min(c.shard, -ln({u("c.region || '/' || c.rack || '/' || c.shard")}) / c.weight) AS shard FROM {name}_2 p JOIN {name}_t c ON p.region = c.region AND p.rack = c.rack GROUP BY n)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(cast(doc_id AS string), '') AS k, hex(encode(coalesce(text, ''))) AS raw FROM documents),
crc AS (SELECT n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, list_extract({_crc_table()}, (xor(c, b) & 255) + 1))), 4294967295::bigint) AS text_crc32 FROM d),{draws("now", shards)},{draws("grown", shards + 1)},
placed AS (SELECT d.doc_id, (length(raw) // 2 + 16)::bigint AS size, text_crc32, 'key' AS law, now.shard::int AS shard, grown.shard::int AS grown_shard,
  ('0x' || substr(md5(k || '|' || text_crc32 || '|slot'), 1, 6))::bigint % {buckets} AS bucket FROM d JOIN crc USING (n) JOIN now USING (n) JOIN grown USING (n))
SELECT doc_id, size, text_crc32, law, shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1)::bigint AS slot, grown_shard FROM placed"""


def op8_sql(least: int = linededup.MIN_WORDS) -> str:
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
raw AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM docs),
lines AS (SELECT doc_id, text, pos, trim(x, {blank}) AS line, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS k FROM raw WHERE trim(x, {blank}) <> ''),
counted AS (SELECT *, len(regexp_split_to_array(line, '[ 	-
]+')) AS w FROM lines),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY k) AS upto FROM counted),
lists AS (SELECT doc_id, text, list(line ORDER BY k) AS l, list(pos ORDER BY k) AS ps FROM lines GROUP BY doc_id, text),
windows AS (SELECT doc_id, text, i, ps[i] AS first, ps[j] AS last, list_slice(l, i, j) AS run FROM (
  SELECT a.doc_id, a.text, a.k AS i, b.k AS j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND a.text IS NOT DISTINCT FROM b.text
  AND b.k BETWEEN a.k AND a.k + {least} AND b.upto - a.upto + a.w >= {least} AND b.upto - b.w - a.upto < {least}) JOIN lists USING (doc_id, text)),
later AS (SELECT DISTINCT doc_id, text, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
marked AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc_id, text ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM later),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text ORDER BY first, last) AS island FROM marked),
merged AS (SELECT doc_id, text, min(first) AS first, max(last) AS last FROM islands GROUP BY doc_id, text, island),
gone AS (SELECT doc_id, text, list([first, last] ORDER BY first) AS runs, sum(last - first + 1) AS n FROM merged GROUP BY doc_id, text)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::int AS n_lines, coalesce(g.n, 0)::int AS n_deleted,
  md5(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: len(list_filter(coalesce(g.runs, []), lambda r: i - 1 BETWEEN r[1] AND r[2])) = 0), chr(10))) AS text_md5,
  coalesce(array_to_string(list_transform(g.runs, lambda r: r[1] || '-' || r[2]), ','), '') AS deleted_runs
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.text = d.text"""


#: Embeddings as whole numbers; only usable vectors.
_WHOLE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def op11_sql() -> str:
    return f"""
WITH {_WHOLE},
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM v WHERE label IS NOT NULL),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_inner_product(a.e, b.e) AS bigint) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN met m ON p.anchor_id = m.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


def op12_sql() -> str:
    return f"""
WITH {_WHOLE},
met AS (SELECT a.vec_id AS query_id, b.vec_id, cast(list_inner_product(a.e, b.e) AS bigint) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::int AS rank, vec_id, score FROM met WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def op13_sql() -> str:
    one = lambda c, letter: f"CASE WHEN {c} THEN '{letter}' ELSE '' END"
    return rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM raw),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
docs AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {one("len(w) < 100", "A")} || {one("100 * len(list_distinct(w)) < 80 * len(w)", "B")} ||
  {one("100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text)", "C")} ||
  {one("regexp_matches(text, '[#$%&*|]')", "D")} || {one("first < s.doc_id", "E")} AS fails FROM split s LEFT JOIN known k ON s.doc_id = k.doc_id),
masks AS (SELECT part, fails, good, toxic, count(*) AS n FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::int AS step FROM orders),
met AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS hit,
  len(list_intersect(string_split(substr(filter_order, 1, step - 1), ''), string_split(fails, ''))) > 0 AND step > 1 AND fails <> '' AS gone FROM masks, steps),
counted AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END)::bigint AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN n * good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN hit AND NOT gone THEN n * toxic ELSE 0 END)::bigint AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley FROM counted"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": op2_sql(), "op5_quality": op5_sql(), "op8_lines": op8_sql(), "op10_urls": op10_sql(), "op11_negatives": op11_sql(), "op12_topk": op12_sql(), "op13_audit": op13_sql()}
