"""DuckDB statements that give the rows of the registered queries."""

from __future__ import annotations

from logsift.llm.line_dedup import Spread
from logsift.llm.mixing import MAX_COPIES
from logsift.llm.quality_rules import HostRules
from logsift.llm.url_rules import FIXED_RULES, Mining

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Five-word windows of ``d(doc_id, w)``.
FIVES = """each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
fives AS (SELECT doc_id, pos, five FROM (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o
            || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five
          FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE five IS NOT NULL)"""


def op1(rules: HostRules = HostRules()) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
{FIVES},
twice AS (SELECT doc_id, five FROM fives GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM fives JOIN twice USING (doc_id, five),
            (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n,
            count(*) FILTER (base_failed OR 100 * n_symbols > {rules.symbol_share} * word_chars) AS n_failed
          FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT avg(n_failed / n) AS mu, var_pop(n_failed / n) AS v FROM hosts),
prior AS (SELECT mu, CASE WHEN v > 0 AND v < mu * (1 - mu) THEN mu * (1 - mu) / v - 1
                     ELSE {rules.default_strength} END AS s FROM mo),
bad AS (SELECT source FROM hosts, prior
        WHERE (n_failed + mu * s) / (n + s) > {rules.max_host_rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       bad.source IS NOT NULL AS host_rejected, NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source"""


OP2 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op3(rule: Spread = Spread()) -> str:
    words = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))".format
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS site,
             string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT site, unnest(list_distinct([x FOR x IN lines IF {words('x')} > 0])) AS line FROM d),
bad AS (SELECT line FROM l GROUP BY line
        HAVING count(*) >= CASE WHEN {words('line')} >= {rule.min_words} THEN {rule.min_sites} ELSE {rule.short_sites} END),
every AS (SELECT list(line) AS bad FROM bad),
o AS (SELECT doc_id, lines, [x FOR x IN lines IF NOT list_contains(coalesce(bad, []), x)] AS kept FROM d, every)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, chr(10))) AS clean_sha256 FROM o"""


OP7 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
             (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS DOUBLE) + 0.5)
               / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY {MAX_COPIES} * source_size / weight, source NULLS LAST) AS k FROM w),
a AS (SELECT *, sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) OVER before, 0) AS total,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN {MAX_COPIES} * source_size * left_weight > total * weight THEN k END) OVER () AS stop FROM a),
t AS (SELECT source, source_size,
        CASE WHEN stop IS NULL OR k < stop THEN CAST({MAX_COPIES} * source_size AS DOUBLE)
             ELSE max(CASE WHEN k = stop THEN CAST(total AS DOUBLE) / left_weight END) OVER () * weight END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MAX_COPIES}) ELSE 0 END AS copies FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 AND copies < {MAX_COPIES} THEN target / source_size - copies ELSE 0 END AS p,
        target - copies * source_size AS due FROM p),
r AS (SELECT d.doc_id, d.size, q.*, (u / (1 - u)) / (p / (1 - p)) AS odds
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, odds / (1 + odds) AS pos FROM r),
e AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS upto FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (copies + CASE WHEN p > 0 AND upto - size / 2 <= due THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e"""


OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
{FIVES},
e AS (SELECT DISTINCT doc_id, five AS x FROM fives
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
n AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (doc_id)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n"""


def op10(mining: Mining = Mining()) -> str:
    order = sorted(FIXED_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    name = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    strong = f"nb >= least AND nb / n >= {mining.min_confidence}"
    return rf"""
WITH p AS (SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
t AS (SELECT *, list_distinct(list_concat(list_concat(
        ['h:' || x FOR x IN string_split(host, '.') IF x <> ''], ['p:' || x FOR x IN string_split(path, '/') IF x <> '']),
        ['q:' || string_split(x, '=')[1] FOR x IN string_split(query, '&') IF string_split(x, '=')[1] <> ''])) AS tokens FROM p),
tr AS (SELECT row_number() OVER () AS id, tokens, toxic = 1 AS blocked FROM t JOIN labels ON page_id = doc_id
       WHERE toxic IS NOT NULL AND (toxic = 1 OR len(tokens) > 0)),
lim AS (SELECT ceil({mining.min_support} * count(*)) AS least FROM tr),
x AS (SELECT id, blocked, unnest(tokens) AS token FROM tr),
one AS (SELECT token FROM (SELECT token, count(*) AS n, count(*) FILTER (blocked) AS nb FROM x GROUP BY token), lim WHERE {strong}),
two AS (SELECT t1, t2 FROM (SELECT a.token AS t1, b.token AS t2, count(*) AS n, count(*) FILTER (a.blocked) AS nb
        FROM x a JOIN x b ON a.id = b.id AND a.token < b.token GROUP BY ALL), lim
        WHERE {strong} AND t1 NOT IN (SELECT token FROM one) AND t2 NOT IN (SELECT token FROM one)),
u AS (SELECT DISTINCT url, unnest(tokens) AS token FROM t),
hit AS (SELECT url FROM u WHERE token IN (SELECT token FROM one)
        UNION SELECT a.url FROM u a JOIN u b ON a.url = b.url JOIN two ON a.token = t1 AND b.token = t2)
SELECT page_id, host, path, CASE {name} END AS rule,
       CASE {verdict} WHEN url IN (SELECT url FROM hit) THEN 'block' ELSE 'allow' END AS verdict FROM t"""


# The checksum that the borrowed heads' lengths come from, byte by byte over
# the table of its polynomial.
OP12 = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(strlen(role) || ':' || role || text)) AS k
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
               lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM o), tab),
r AS (SELECT h.conv_id, k, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND k <= h
      UNION ALL SELECT conv_id, k, role, text FROM h JOIN o USING (conv_id) WHERE k > h),
s AS (SELECT h.conv_id, coalesce(list(md5(strlen(role) || ':' || role || text) ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS seq,
        coalesce(list(strlen(text) ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS sizes
      FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
m AS (SELECT conv_id, d, seq[1:d] AS p, len(seq) AS n, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS b
      FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
v AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) > any_value(d) AS inside, any_value(b) AS b,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
      FROM m GROUP BY p),
t AS (SELECT p[1:e] AS p, count(*) FILTER (WHERE NOT inside) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS e FROM v) GROUP BY 1),
c AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1)
SELECT v.conv_id, depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN t USING (p) LEFT JOIN c USING (p) LEFT JOIN (SELECT p, conv_id FROM v) AS u ON depth > 0 AND u.p = v.p[1:depth - 1]"""


# Five hexadecimal digits are four digits of base 32.
OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string([substr('{UPPER}234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 + 1 AS INTEGER), 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


ORACLE_SQL = {"op1_quality_rules": op1(), "op2_exact_dedup": OP2, "op3_line_dedup": op3(), "op7_mixing": OP7,
              "op9_minhash_tensor": OP9, "op10_url_rules": op10(), "op12_prefix_trie": OP12, "op13_warc": OP13}
