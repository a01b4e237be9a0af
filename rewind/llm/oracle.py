"""SQL twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import MEASUREMENTS, POLICIES, RULES, rule_mask

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
_T = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents"

#: CRC-32: eight halvings of the register a byte, from the lowest bit.
_HALVED = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC = f"""
table8 AS (SELECT list(list_reduce(range(8), lambda c, k: {_HALVED.format("c")}, n) ORDER BY n) AS t8 FROM range(256) x(n)),
bytes AS (SELECT r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS b FROM t),
crc AS (SELECT r, xor(list_reduce(b, lambda c, x: xor(c >> 8, t8[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM bytes, table8)"""

SHARDING = f"""
WITH t AS ({_T}),{_CRC},
s AS (SELECT r, doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS size, text_crc32 FROM t JOIN crc USING (r)),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size, r) - size AS start, sum(size) OVER () AS everything, row_number() OVER (ORDER BY doc_id, text_crc32, size, r) AS row FROM s),
p AS (SELECT *, CAST(least(39, ((2 * start + size) * 40) // (2 * everything)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, condition in enumerate(RULES.values()))
assert all(name in RULES for name in POLICIES["v1"])

QUALITY = f"""
WITH t AS ({_T}),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM t),
word AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
three AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM three WHERE c IS NOT NULL),
rep AS (SELECT r, sum(covers) AS n_repeat_words FROM (SELECT r, least(3, i - lag(i, 1, i - 3) OVER (PARTITION BY r ORDER BY i)) AS covers FROM win WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{SPACES}+', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '|', '')) AS n_bars,
  length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_exclaim FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in MEASUREMENTS)}, fail_bits, fail_bits & {rule_mask("base")} <> 0 AS base_failed, fail_bits & {rule_mask("v1") | rule_mask("base")} = 0 AS kept FROM f"""

#: All pairs with a common shingle, compared exactly; components by reachability. Ids are taken to be distinct.
NGRAM_JOIN = f"""
WITH RECURSIVE t AS ({_T}),
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}+') AS words FROM t),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3])) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.least, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) m USING (doc_id)"""
