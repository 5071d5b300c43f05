"""DuckDB SQL for the queries of this subpackage that SQL can express.

Operators 2, 3, 5, 6, 7 and 8 hash with XXH64, run a tokenizer, follow links or pack: tests/llm compares these with
brute-force versions instead.
"""

from __future__ import annotations

from functools import reduce

from . import decontam, licenses, quality

WORD = r"[^\x20\x09-\x0D]+"


def _base32(hexed: str) -> str:
    """Base32 of 40 hex digits: each five of them are four letters."""
    number = lambda k: f"CAST('0x' || substr({hexed}, {5 * k + 1}, 5) AS INT)"
    letters = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({number(k)} >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0)]
    return " || ".join(letters)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
l AS (SELECT h, max(page_id) AS leader, count(*) AS n FROM p GROUP BY h),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, n > 1 AND page_id IS DISTINCT FROM leader AND leader IS NOT NULL AS again, leader FROM p JOIN l USING (h))
SELECT page_id, payload_bytes, {_base32("x")} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN leader END AS refers_to
FROM d"""


def _quality() -> str:
    rules = quality.RULES
    bucket = ", ".join(f"CASE WHEN {den} = 0 THEN 0 ELSE {num} * {factor} // {den} END AS b_{k}" for k, (num, factor, den, _) in rules.items())
    names = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS name, b_{k} AS b FROM judged WHERE NOT base_failed" for k in rules)
    slack = " ".join(f"WHEN '{k}' THEN {r[3]}" for k, r in rules.items())

    def level(name: str, by: str) -> str:
        return f"""{name} AS (SELECT {by}name, q1 - margin AS lo, q3 + margin AS hi, docs FROM (
  SELECT *, {quality.REACH} * (q3 - q1) + CASE name {slack} END AS margin FROM (
    SELECT {by}name, min(CASE WHEN 4 * place >= docs THEN b END) AS q1, min(CASE WHEN 4 * place >= 3 * docs THEN b END) AS q3, max(docs) AS docs
    FROM (SELECT *, row_number() OVER (PARTITION BY {by}name ORDER BY b) AS place, count(*) OVER (PARTITION BY {by}name) AS docs FROM flat) GROUP BY ALL)))"""

    inside = " AND ".join(f"b_{k} BETWEEN lo_{k} AND hi_{k}" for k in rules)
    pick = lambda side: ", ".join(f"max(CASE WHEN name = '{k}' THEN {side} END) AS {side}_{k}" for k in rules)
    choose = lambda side: f"CASE WHEN o.docs >= {quality.MIN_GROUP} THEN o.{side} WHEN l.docs >= {quality.MIN_GROUP} THEN l.{side} ELSE a.{side} END AS {side}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM often, range(0, 3) x(k) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM w LEFT JOIN r USING (rid)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {bucket} FROM m),
flat AS ({names}),
{level("own", "lang, source, ")},
{level("bylang", "lang, ")},
{level("every", "")},
fence AS (SELECT lang, source, {pick("lo")}, {pick("hi")} FROM (
  SELECT o.lang, o.source, o.name, {choose("lo")}, {choose("hi")} FROM own o JOIN bylang l ON o.lang = l.lang AND o.name = l.name JOIN every a ON o.name = a.name) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept
FROM judged LEFT JOIN fence USING (lang, source)"""


def _contained() -> str:
    split = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[^\x00-/:-@\[-`{{-\x7f]+')"
    size = decontam.SHINGLE
    return f"""
WITH i AS (SELECT item_id, w, least({size}, len(w)) AS n FROM (SELECT CAST(min(item_id) AS BIGINT) AS item_id, {split("text")} AS w FROM benchmark WHERE text IS NOT NULL GROUP BY text) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM i)),
total AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, {split("text")} AS w FROM documents),
dg AS (SELECT DISTINCT rid, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, count(*) AS n_shared FROM dg JOIN ig USING (n, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared FROM hit JOIN total USING (item_id) JOIN d USING (rid) WHERE 5 * n_shared >= 4 * n_shingles"""


def _licenses() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    bare = f"regexp_replace(lower({{0}}), {quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g')"
    spaced = f"trim(regexp_replace({bare}, {quoted(licenses.SEPARATORS)}, ' ', 'g'))"
    form = reduce(lambda t, s: f"replace({t}, {quoted(s[0])}, {quoted(s[1])})", licenses.SPELLINGS, spaced)
    canonical = lambda c: form.replace("{0}", c)
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.KNOWN)
    return f"""
WITH k AS (SELECT sha256(c) AS d, min(id) AS id FROM (SELECT id, {canonical("t")} AS c FROM (VALUES {known}) v(id, t)) WHERE c <> '' GROUP BY 1),
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, sha256({canonical("t")}) AS digest FROM t),
u AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM t),
c AS (SELECT line, sha256({canonical("line")}) AS d FROM (SELECT DISTINCT line FROM u)),
n AS (SELECT rid, array_to_string(list_sort(list_distinct(list(id))), ',') AS notices, count(*) AS n_notices FROM u JOIN c USING (line) JOIN k USING (d) GROUP BY rid)
SELECT doc_id, digest, k.id AS license_id, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM w LEFT JOIN k ON digest = k.d LEFT JOIN n USING (rid)"""


def _crc(c: str) -> str:
    """CRC-32 of a decimal number's digits, as list_reduce over bits from the lowest of the first digit on."""
    digit = f"CAST(ascii(substr(CAST({c} AS VARCHAR), CAST(k // 8 + 1 AS INT), 1)) AS BIGINT)"
    mixed = f"(CASE WHEN k % 8 = 0 THEN xor(s, {digit}) ELSE s END)"
    step = f"xor({mixed} >> 1, ({mixed} & 1) * 3988292384)"
    return f"xor(list_reduce(range(0, CAST(8 * strlen(CAST({c} AS VARCHAR)) AS BIGINT)), lambda s, k: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


TRIE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS v FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY p) AS own, {_crc("conv_id")} % 9 AS h FROM t GROUP BY conv_id),
m AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
x AS (SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM m),
g AS (SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends FROM x GROUP BY 1, 2),
n AS (SELECT g.*, p.conv_id AS parent_conv_id, (g.n_convs - 1) * coalesce(strlen(g.path[g.depth].text), 0) AS saved FROM g LEFT JOIN g p ON p.depth = g.depth - 1 AND p.path = g.path[1:g.depth - 1]),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (conv_id, depth)),
up AS (SELECT a.depth AS d, a.conv_id AS c, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS at FROM f) b JOIN f a ON a.depth = b.at AND a.path = b.path[1:b.at] GROUP BY 1, 2)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN up ON up.d = depth AND up.c = conv_id"""

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source) AS place FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
v AS (SELECT level FROM l WHERE cap >= w * level ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT level FROM v)) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS extra, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * ahead + size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, size, w[i:i + size - 1] AS g FROM (SELECT lang, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM w, range(1, 6) x(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_parts AS (SELECT lang, unnest([g[2:], g[1:size - 1]]) AS g, f FROM f WHERE size > 2),
held AS (SELECT lang, g, max(f) AS longer FROM inner_parts GROUP BY ALL),
c AS (SELECT lang, size, g, f AS a FROM f LEFT JOIN held USING (lang, g) WHERE size > 1 AND (longer IS NULL OR longer < f)),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * k.a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:] JOIN totals t ON t.lang = k.lang),
one AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS pick, array_to_string(g, ' ') AS phrase FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one WHERE pick = 1) WHERE rank <= 2000"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": WARC,
    "op4_quality_rules": _quality(),
    "op9_decontamination": _contained(),
    "op10_license_scan": _licenses(),
    "op11_prefix_trie": TRIE,
    "op12_mixing": MIX,
    "op13_collocations": COLLOCATIONS,
}
