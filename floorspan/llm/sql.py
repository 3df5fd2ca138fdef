"""DuckDB SQL for the queries that SQL can express.

The others learn weights (1, 6, 8, 9) or call a tokenizer library (4), and are tested against plain versions.
"""

from __future__ import annotations

from floorspan.llm import chat_format, quality_rules, resampling, spelling, url_filter

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 9) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w FROM d GROUP BY source),
fill(round, level) AS (SELECT 0, -1e0 UNION ALL
    SELECT round + 1, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3e0 * source_size) FROM s WHERE 3e0 * source_size < level * w), 0)) / (SELECT sum(w) FROM s WHERE NOT 3e0 * source_size < level * w)
    FROM fill WHERE round < 60 AND EXISTS (SELECT 1 FROM s WHERE NOT 3e0 * source_size < level * w)),
t AS (SELECT source, source_size, least(3e0 * source_size, (SELECT max(level) FROM fill) * w) AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY ALL),
r AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
x AS (SELECT b.source, first(r.h ORDER BY r.h) AS h, first(r.n ORDER BY r.h) AS n, first(b.target - b.times * b.source_size - (r.upto - r.n) ORDER BY r.h) AS room
    FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source AND r.upto > b.target - b.times * b.source_size WHERE b.target - b.times * b.source_size > 0 GROUP BY b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target, CAST(d.size * (b.times + CASE WHEN d.h < x.h + CASE WHEN room * 2 >= n THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""


def _options() -> str:
    rows = [(role, label, c, s, a, via, i) for role, by in chat_format.OPTIONS.items() for label, found in by.items() for i, (c, s, a, via) in enumerate(found)]
    return ", ".join(str(r) for r in rows)


OP3 = f"""
WITH RECURSIVE o(role, label, c, s, a, via, i) AS (VALUES {_options()}),
q AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, CASE lower(trim(coalesce(role, ''))) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) AS pos FROM q),
z AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
w(conv_id, pos, state, cost, path) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, CAST([] AS STRUCT(label INT, a VARCHAR, via INT, c INT)[]) FROM z UNION ALL
  SELECT w.conv_id, t.pos, o.label, min(w.cost + o.c), arg_min(list_append(w.path, {{'label': o.label, 'a': o.a, 'via': o.via, 'c': o.c}}), (w.cost + o.c) * 100 + o.i)
  FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1 JOIN o ON o.role = t.r AND o.s = w.state GROUP BY w.conv_id, t.pos, o.label),
e AS (SELECT w.conv_id, z.n, arg_min(path, cost * 10 + state) AS path FROM w JOIN z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.pos = z.n GROUP BY w.conv_id, z.n),
p AS (SELECT t.*, e.n, e.path[t.pos] AS x FROM t JOIN e ON t.conv_id IS NOT DISTINCT FROM e.conv_id),
f AS (SELECT *, replace(coalesce(text, ''), '<|im_', '< |im_') AS body, ['system', 'user', 'assistant'] AS names FROM p),
g AS (SELECT *, CASE WHEN x.a = 'merge' THEN E'\\n\\n' || body ELSE CASE WHEN pos = 1 THEN '' ELSE E'<|im_end|>\\n' END || CASE WHEN x.via > 0 THEN '<|im_start|>' || names[x.via] || E'\\n<|im_end|>\\n' ELSE '' END
    || '<|im_start|>' || names[x.label] || E'\\n' || body END || CASE WHEN pos = n THEN E'<|im_end|>\\n' ELSE '' END AS fragment FROM f)
SELECT conv_id, turn, CAST(pos - 1 AS BIGINT) AS place, role, names[x.label] AS new_role, CASE WHEN x.a = 'keep' AND x.label <> r THEN 'relabel' ELSE x.a END AS action, CASE WHEN x.via > 0 THEN names[x.via] END AS inserted,
  CAST(x.c AS BIGINT) AS cost, CAST(length(fragment) AS BIGINT) AS n_chars, sha256(fragment) AS fragment_sha256 FROM g
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
e AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT k, count(*) AS n FROM e GROUP BY k),
many AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
live AS (SELECT e.k, e.s FROM e JOIN many USING (s)),
pair AS (SELECT a.k AS a, b.k AS b, count(*) AS i FROM live a JOIN live b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT k, k FROM w UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (k) JOIN (SELECT reach.a AS k, min(v.doc_id) AS component_id FROM reach JOIN w v ON reach.b = v.k GROUP BY 1) c USING (k)
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP7 = f"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM v),
p AS (SELECT k, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM w, sizes WHERE len(w) >= size),
h AS (SELECT p.k, p.i, p.size, v.item_id FROM p JOIN v ON p.size = v.size AND v.s = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
c AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS x FROM h) GROUP BY k),
f AS (SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY k)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (k) LEFT JOIN f USING (k)
"""


def _op10() -> str:
    rules = quality_rules.RULES
    a, d = quality_rules.ALPHA, quality_rules.DELTA
    n_cuts = sum(len(g) for _, g in rules.values())
    tests = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, cut, count(*) AS n, count(*) FILTER (WHERE {v} > cut) AS k FROM known, (SELECT unnest({list(g)}::DOUBLE[]) AS cut) GROUP BY stratum, cut" for r, (v, g) in rules.items())
    cuts = ", ".join(f"min(cut) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in rules)
    hit = ", ".join(f"CASE WHEN {v} > cut_{r} THEN '{r}' END" for r, (v, _) in rules.items())
    return f"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
l AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM w), m AS (SELECT id, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM l WHERE regexp_matches(line, {_WORD}) GROUP BY id),
p AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT id, i FROM p QUALIFY count(*) OVER (PARTITION BY id, s) > 1),
r AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS x FROM again) GROUP BY id),
c AS (SELECT w.id, w.doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_lines - kinds, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN m USING (id) LEFT JOIN r USING (id)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
known AS (SELECT c.* FROM c JOIN good USING (doc_id) WHERE n_words > 0), tests AS ({tests}),
bound AS (SELECT *, CASE WHEN k >= n * {a} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln({1 - a})))) END AS chance FROM tests),
cuts AS (SELECT stratum, {cuts} FROM bound WHERE chance <= {d} / ({n_cuts} * (SELECT count(DISTINCT stratum) FROM known)) GROUP BY stratum),
j AS (SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(list_filter([{hit}], lambda x: x IS NOT NULL), ',') AS rules_hit FROM c LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules_hit = '' AS kept, rules_hit FROM j
"""


#: The 256 remainders of CRC-32, by its polynomial, and the sum of a text's UTF-8 bytes with them.
_CRC_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i))"


def _crc(digits: str) -> str:
    """CRC-32 of the bytes that a column of hexadecimal digits spells."""
    each = f"list_transform(range(1, len({digits}) // 2 + 1), lambda i: CAST('0x' || substr({digits}, 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1])), 4294967295)"


_B = resampling.BUCKETS
OP11 = f"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
f AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM w),
g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM b),
x AS (SELECT s, {_crc("x")} % {_B} AS bucket FROM (SELECT s, hex(encode(s)) AS x FROM (SELECT s FROM f UNION SELECT s FROM g)), {_CRC_TABLE}),
fs AS (SELECT k, s, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS n FROM fs JOIN x USING (s) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM g JOIN x USING (s) GROUP BY 1),
a AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (s_all + {_B}) / ((CAST(s.n AS DOUBLE) + 1) * (t_all + {_B})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), a),
m AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM fs JOIN x USING (s) JOIN gain USING (bucket) GROUP BY k),
d AS (SELECT k, doc_id, len(w.w) AS n_words, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
    coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM w LEFT JOIN m USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM d WHERE n_words >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {resampling.PERCENT} // 100 THEN rank END AS rank FROM d LEFT JOIN r USING (k)
"""

OP12 = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
u AS (SELECT d, r, count(*) AS n FROM w WHERE length(r) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
h AS (SELECT r, n, {_crc("x")} AS h FROM (SELECT r, n, hex(encode(d || ':' || r)) AS x FROM u), {_CRC_TABLE}),
c AS (SELECT CASE WHEN h % {spelling.LOSES} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM c WHERE length(word) >= {spelling.LEAST_LETTERS} AND n >= {spelling.LEAST_COUNT}),
e AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) AS t(i)),
pair AS (SELECT DISTINCT e.word AS a, v.word AS b FROM e JOIN v ON e.rest = v.word UNION SELECT x.word, y.word FROM e x JOIN e y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(m := -y.n, b := encode(b))) AS form, max(y.n) AS form_n FROM near JOIN v y ON b = y.word GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.TIMES} * v.n THEN form END AS form, CASE WHEN form_n >= {spelling.TIMES} * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
way(word, last) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.last AS root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f z ON way.last = z.word WHERE z.form IS NULL
"""


def _op13() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    double = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
    low, high = url_filter.WORTH

    def level(name: str, groups: str) -> str:
        """The prior of a level (n, k, p): its worth by moments, whole pages, the posterior mean."""
        return f"""{name}_w AS (SELECT CASE WHEN s2 IS NULL OR s2 <= 0 THEN {low}e0 WHEN s0 <= s1 THEN {high}e0 ELSE least(greatest(round(s2 / (s0 - s1) - 1, 3), {low}), {high}) END AS m
    FROM (SELECT sum((k - n * p) * (k - n * p)) AS s0, sum(n * (p * (1 - p))) AS s1, sum(CAST(n AS DOUBLE) * (n - 1) * (p * (1 - p))) AS s2 FROM {groups} WHERE n > 0)),
{name} AS (SELECT *, (a + k) / CAST(a + b + n AS DOUBLE) AS mean FROM (SELECT g.*, CAST(greatest(1, floor(p * m + 0.5e0)) AS BIGINT) AS a, CAST(greatest(1, floor((1 - p) * m + 0.5e0)) AS BIGINT) AS b FROM {groups} g, {name}_w))"""

    s, d = url_filter.SHARE, url_filter.DOUBT
    return f"""
WITH rules(r_host, r_path, verdict) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS i, page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT i, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
fit AS (SELECT i, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS decided FROM q JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY i),
o AS (SELECT q.*, rule, decided FROM q LEFT JOIN fit USING (i)),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS x, count(decided) AS n, count(*) FILTER (WHERE decided = 'allow') AS k FROM o GROUP BY host),
labels AS (SELECT *, string_split(x, '.') AS l FROM bare),
hosts AS (SELECT host, n, k, CASE WHEN regexp_full_match(x, '[0-9.]+') THEN x WHEN array_to_string(l[-2:], '.') IN ({double}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    CASE WHEN regexp_full_match(x, '[0-9.]+') THEN x WHEN array_to_string(l[-2:], '.') IN ({double}) THEN array_to_string(l[-2:], '.') ELSE array_to_string(l[-1:], '.') END AS suffix FROM labels),
g1 AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, (SELECT (sum(k) + 1) / CAST(sum(n) + 2 AS DOUBLE) FROM hosts) AS p FROM hosts GROUP BY suffix),
{level("l1", "g1")},
g2 AS (SELECT h.domain, h.n, h.k, l1.mean AS p FROM (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM hosts GROUP BY ALL) h JOIN l1 USING (suffix)),
{level("l2", "g2")},
g3 AS (SELECT hosts.host, hosts.n, hosts.k, l2.mean AS p FROM hosts JOIN l2 USING (domain)),
{level("l3", "g3")},
t AS (SELECT host, CASE WHEN a + k - 1 >= (a + b + n - 1) * {s}e0 THEN 1 ELSE list_sum(list_transform(range(0, a + k), lambda i: exp(lgamma(a + b + n) - lgamma(i + 1) - lgamma(a + b + n - i) + i * ln({s}) + (a + b + n - 1 - i) * ln({1 - s})))) END > {d} AS trusted FROM l3)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN trusted THEN 'allow' ELSE 'block' END) AS verdict FROM o JOIN t USING (host)
"""


ORACLE_SQL = {"op2_mix_sources": OP2, "op3_chat_format": OP3, "op5_ngram_join": OP5, "op7_decontaminate": OP7, "op10_quality_rules": _op10(), "op11_importance_resample": OP11, "op12_spelling_groups": OP12, "op13_url_filter": _op13()}
