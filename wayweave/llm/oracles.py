"""DuckDB statements for the corpus queries that SQL can express."""

from .bagminhash import NO_ID, THRESHOLD
from . import hash_tree as ht, paragraphs as pg
from .mixing import BLOCK_ROWS, ENTROPY, REPEATS, SEED, STEPS

_CRC = """xor(list_reduce(list_transform(range(8), lambda i: i), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(x AS BIGINT)), 0)"""
_UNIT = "(CAST('0x' || substr({}, {}, 8) AS BIGINT) + 0.5) / 4294967296"
_LEAST = "list_position(list_transform([0, 1, 2, 3], lambda c: -ln((CAST('0x' || substr({0}, 8 * c + 1, 8) AS BIGINT) + 0.5) / 4294967296)), list_min(list_transform([0, 1, 2, 3], lambda c: -ln((CAST('0x' || substr({0}, 8 * c + 1, 8) AS BIGINT) + 0.5) / 4294967296)))) - 1"

#: All weights are 1: the least draw of a node's children, the earliest counting draw of the regions (of the same rate).
OP2 = f"""
WITH crcs AS (SELECT list({_CRC} ORDER BY x) AS crc FROM (SELECT unnest(range(256)) AS x)),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
rows AS (SELECT doc_id, CAST(len(b) + 16 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
  CAST(xor(list_reduce(b, lambda c, x: xor(c // 256, crc[CAST(xor(c, x) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32 FROM raw, crcs),
keys AS (SELECT DISTINCT k FROM rows),
turns AS (SELECT k, r, i FROM keys, (SELECT unnest(range({-(-(ht.SHARDS + 1) // ht.REGION)})) AS r), (SELECT unnest(range(64)) AS i)),
racks AS (SELECT *, -ln({_UNIT.format("md5(k || '|' || r || '|' || i)", 1)}) AS wait, {_LEAST.format("md5(k || '|racks ' || r || '|' || i)")} AS rk FROM turns),
draws AS (SELECT *, sum(wait) OVER (PARTITION BY k, r ORDER BY i) AS t, r * {ht.REGION} + rk * {ht.PLACES} + {_LEAST.format("md5(k || '|' || r || '.' || rk || '|' || i)")} AS s FROM racks),
homes AS (SELECT k, CAST(arg_min(s, t) FILTER (s < {ht.SHARDS}) AS INTEGER) AS shard, CAST(arg_min(s, t) FILTER (s < {ht.SHARDS} + 1) AS INTEGER) AS grown_shard FROM draws GROUP BY k),
total AS (SELECT greatest(1, count(*) // {ht.SHARDS * ht.PIECE_ROWS}) AS pieces FROM rows)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % pieces, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM rows JOIN homes USING (k), total
"""

_WORDS = r"""regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7 = f"""
WITH items AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS len, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM wins),
docs AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS.format('text')} AS w FROM documents),
grams AS (
  SELECT uid, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS g
  FROM (SELECT uid, w, unnest(generate_series(1, len(w))) AS i FROM docs) d, lens l WHERE i + l.len - 1 <= len(w)),
hits AS (SELECT a.uid, a.i, a.len, b.item_id FROM grams a JOIN wins b ON a.g = b.g AND a.len = b.len),
pos AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(generate_series(i, i + len - 1)) AS p FROM hits) GROUP BY uid),
ids AS (SELECT uid, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS j
        FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN pos USING (uid) LEFT JOIN ids USING (uid)
"""

OP4 = f"""
WITH RECURSIVE texts AS (SELECT coalesce(doc_id, {NO_ID}) AS doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
shingles AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM texts WHERE len(w) > 0)),
bags AS (SELECT doc_id, s, count(*) AS c FROM shingles GROUP BY doc_id, s),
sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS m FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE CAST(m AS DOUBLE) / CAST(p.n + q.n - m AS DOUBLE) >= {THRESHOLD}
  UNION SELECT a.doc_id, b.doc_id FROM texts a JOIN texts b ON a.text = b.text AND a.doc_id < b.doc_id),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM texts UNION SELECT y, root FROM reach JOIN ways ON x = doc_id WHERE root < y)
SELECT nullif(doc_id, {NO_ID}) AS doc_id, nullif(min(root), {NO_ID}) AS class_id FROM reach GROUP BY doc_id
"""

OP9 = f"""
WITH RECURSIVE docs AS (SELECT coalesce(doc_id, {pg.NO_ID}) AS doc, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc, unnest(generate_series(1, len(l))) AS nth, unnest(list_transform(l, lambda x: {_WORDS.format('x')})) AS w FROM (SELECT doc, string_split(text, chr(10)) AS l FROM docs)),
placed AS (SELECT doc, w, CAST(sum(len(w)) OVER (PARTITION BY doc ORDER BY nth ROWS UNBOUNDED PRECEDING) AS BIGINT) - len(w) AS start FROM cut),
lines AS (SELECT doc, start, CAST(len(w) AS BIGINT) AS n_words, w, array_to_string(w, ' ') AS body FROM placed WHERE len(w) >= {pg.MIN_WORDS}),
paras AS (SELECT body, any_value(w) AS w, row_number() OVER (ORDER BY body) AS id FROM lines GROUP BY body),
shingles AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM paras)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE CAST(m AS DOUBLE) >= CAST({pg.THRESHOLD} AS DOUBLE) * CAST(p.n + q.n - m AS DOUBLE)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS id, x AS root FROM ways UNION SELECT y, root FROM reach JOIN ways ON x = id WHERE root < y),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
classed AS (SELECT doc, start, n_words, coalesce(root, id) AS class FROM lines JOIN paras USING (body) LEFT JOIN roots USING (id)),
firsts AS (SELECT class, min(struct_pack(doc := doc, start := start)) AS f FROM classed GROUP BY class HAVING min(doc) < max(doc)),
words AS (SELECT doc, {_WORDS.format('text')} AS w FROM docs),
grams AS (SELECT doc, i - 1 AS i, md5(array_to_string(w[i:i + {pg.LENGTH - 1}], ' ')) AS g FROM (SELECT doc, w, unnest(generate_series(1, len(w) - {pg.LENGTH - 1})) AS i FROM words)),
held AS (SELECT g, min(doc) AS keeper FROM grams GROUP BY g HAVING min(doc) < max(doc)),
state AS (SELECT doc, p, bool_or(gone) AS removed FROM (SELECT DISTINCT doc, keeper < doc AS gone, unnest(generate_series(i, i + {pg.LENGTH - 1})) AS p FROM grams JOIN held USING (g)) GROUP BY doc, p),
spans AS (SELECT doc, removed, min(p) AS start, count(*) AS n_words FROM (
  SELECT *, p - row_number() OVER (PARTITION BY doc, removed ORDER BY p) AS island FROM state) GROUP BY doc, removed, island),
found AS (
  SELECT DISTINCT doc, 'paragraph' AS kind, start, n_words, f.doc AS first, f.start AS first_start, doc <> f.doc OR start <> f.start AS removed FROM classed JOIN firsts USING (class)
  UNION ALL SELECT doc, 'passage', start, n_words, NULL, NULL, removed FROM spans)
SELECT nullif(doc, {pg.NO_ID}) AS doc_id, kind, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, nullif(first, {pg.NO_ID}) AS first_doc, CAST(first_start AS BIGINT) AS first_start, removed FROM found
"""

_ESC = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
_ROW = "role || chr(10) || txt || chr(10)"

OP10 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({_ROW}, '' ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(txt) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN txt END, '' ORDER BY turn NULLS FIRST, role, txt), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('role')}) + length({_ESC.format('txt')}) + length('<s>[INST][/INST]</s>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_TRIM = "trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))"
_POWERS = "list_sum(list_transform(sizes, lambda x: pow(x / total, {m})))"
_LOGS = "list_sum(list_transform(sizes, lambda x: pow(x / total, {m}) * ln(x / total)))"

OP8 = f"""
WITH RECURSIVE named AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src, {_TRIM} AS body FROM documents),
sized AS (SELECT doc_id, source, src, md5('{SEED}|' || src || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
  CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split_regex(body, '[ \t\n\r]+')) END AS BIGINT) AS tokens FROM named),
stats AS (SELECT src, sum(tokens) AS size, count(*) AS n FROM sized GROUP BY src HAVING sum(tokens) > 0),
one AS (SELECT list(CAST(size AS DOUBLE) ORDER BY size) AS sizes, CAST(sum(size) AS DOUBLE) AS total FROM stats),
probe AS (
  SELECT 0 AS i, 0::DOUBLE AS slo, 1::DOUBLE AS shi, 0::DOUBLE AS rlo, 1::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1, CASE WHEN far THEN sm ELSE slo END, CASE WHEN far THEN shi ELSE sm END, CASE WHEN often THEN rm ELSE rlo END, CASE WHEN often THEN rhi ELSE rm END FROM (
    SELECT *, ln({_POWERS.format(m='sm')}) - sm * {_LOGS.format(m='sm')} / {_POWERS.format(m='sm')} >= {ENTROPY} * ln(len(sizes)) AS far,
      pow(sizes[1] / total, rm - 1) / {_POWERS.format(m='rm')} > {REPEATS} AS often
    FROM (SELECT *, (slo + shi) / 2 AS sm, (rlo + rhi) / 2 AS rm FROM probe, one WHERE i < {STEPS}))),
raw AS (SELECT greatest(slo, rhi) AS r FROM probe WHERE i = {STEPS}),
chosen_t AS (SELECT CASE WHEN r > 0.5 AND 1 - r < 1e-9 THEN 1 WHEN r < 1e-9 THEN 0 ELSE r END::DOUBLE AS t FROM raw),
full_t AS (SELECT t, {_POWERS.format(m='t')} AS z, total FROM chosen_t, one),
weighted AS (SELECT src, size, greatest(1, CAST(ceil(n / {BLOCK_ROWS}) AS BIGINT)) AS n_blocks, pow(size / total, t) / z AS weight, total FROM stats, full_t),
sources AS (SELECT src, n_blocks, weight, CAST(floor(weight * total) AS BIGINT) // CAST(size AS BIGINT) AS passes, CAST(floor(weight * total) AS BIGINT) % CAST(size AS BIGINT) AS rest FROM weighted),
placed AS (SELECT s.*, weight, passes, rest, CAST('0x' || substr(k, 1, 8) AS BIGINT) % n_blocks AS block FROM sized s JOIN sources USING (src)),
held AS (SELECT src, block, rest, sum(tokens) AS held FROM placed GROUP BY src, block, rest),
upto AS (SELECT *, sum(held) OVER (PARTITION BY src ORDER BY md5('{SEED}|' || src || '|' || block), block ROWS UNBOUNDED PRECEDING) AS upto FROM held),
blocks AS (SELECT src, block, upto <= rest AS whole, rest - (upto - held) AS room FROM upto WHERE upto - held < rest),
edge AS (SELECT p.src, p.k, room, sum(tokens) OVER (PARTITION BY p.src ORDER BY k RANGE UNBOUNDED PRECEDING) AS run FROM placed p JOIN blocks b ON p.src = b.src AND p.block = b.block AND NOT whole),
taken AS (SELECT DISTINCT src, k FROM edge WHERE run <= room)
SELECT s.doc_id, s.source, s.tokens, coalesce(p.weight, 0) AS weight,
  CASE WHEN s.tokens = 0 THEN 0 ELSE coalesce(p.passes, 0) + CASE WHEN b.src IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN t.src IS NOT NULL THEN 1 ELSE 0 END END AS copies
FROM sized s LEFT JOIN (SELECT DISTINCT src, k, weight, passes, block FROM placed) p ON s.src = p.src AND s.k = p.k
LEFT JOIN (SELECT src, block FROM blocks WHERE whole) b ON b.src = p.src AND b.block = p.block LEFT JOIN taken t ON t.src = s.src AND t.k = s.k
"""

ORACLES = {"op2_weighted_hash_tree": OP2, "op4_bagminhash": OP4, "op7_winnowing_decontamination": OP7, "op8_temperature_mixture": OP8, "op9_repeated_passages": OP9, "op10_chat_round_trip": OP10}
