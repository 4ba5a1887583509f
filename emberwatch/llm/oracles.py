"""SQL that gives the same rows as a query of this package, where SQL can express it.

Language models, the classifier, tokenizer vocabularies, rolling hashes and BM25 passages have no SQL form;
tests hold those operators against brute force.
"""

from __future__ import annotations

_SPACES = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACES}'), lambda x: x <> '')"


_QUALITY = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {_words('text')} AS w FROM documents),
good AS (SELECT doc_id, max(quality = 1 AND coalesce(toxic, 0) = 0) AS trusted FROM labels GROUP BY doc_id),
g AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w),
-- CRC-32, byte by byte, of each distinct gram
crc_table AS (SELECT i, list_reduce([i] || range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)),
distinct_grams AS (SELECT DISTINCT gram FROM g),
crc(gram, code, pos, v) AS (
  SELECT gram, hex(encode(gram)), 0::BIGINT, 4294967295::BIGINT FROM distinct_grams
  UNION ALL
  SELECT gram, code, pos + 1, xor(t.v, c.v >> 8) FROM crc c JOIN crc_table t ON t.i = xor(c.v & 255,
    16 * (instr('0123456789ABCDEF', substr(code, 2 * pos + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(code, 2 * pos + 2, 1)) - 1)
  WHERE 2 * pos < length(code)),
buckets AS (SELECT gram, xor(v, 4294967295) % 16384 AS bucket FROM crc WHERE 2 * pos = length(code)),
hashed AS (SELECT doc_id, bucket FROM g JOIN buckets USING (gram)),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (coalesce(trusted, false)) AS target
  FROM hashed LEFT JOIN good USING (doc_id) GROUP BY bucket),
totals AS (SELECT sum(raw)::DOUBLE AS raw, sum(target)::DOUBLE AS target FROM counts),
weights AS (SELECT bucket, CASE WHEN t.target = 0 THEN 0 ELSE round(ln((c.target::DOUBLE * t.raw / c.raw + 65536.0)
  / (t.target + 65536.0)), 6) END AS weight FROM counts c, totals t),
scores AS (SELECT doc_id, round(sum(weight) / count(*), 6) + 0.0 AS llr FROM hashed JOIN weights USING (bucket) GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3),
  lambda i: array_to_string(w[i:i + 4], ' '))) AS window_text FROM w WHERE len(w) >= 5),
often AS (SELECT doc_id, window_text FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM windows JOIN often USING (doc_id, window_text), range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w),
counted AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(len(lines) - len(list_distinct(lines)), 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0.0) AS llr
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN scores USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND llr >= -0.2 AS kept FROM counted
"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
  lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = doc_id
"""


def _key(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


_BLOCK = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks)"

_MIX = f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, len({_words('text')})::BIGINT AS n_tokens FROM documents),
units AS (SELECT s, doc_id, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
sources AS (SELECT s, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM units GROUP BY s),
shares AS (SELECT *, CASE WHEN tokens > 0 THEN tokens / (SELECT sum(tokens) FROM sources)::DOUBLE END AS p FROM sources),
-- the bisected condition, solved: (least share / greatest share) ^ (a - 1) <= 2
chosen AS (SELECT CASE WHEN count(p) <= 1 THEN 1.0 WHEN max(p) = min(p) THEN 0.000001 ELSE
  greatest(0.000001, ceil(1000000 * (1 - ln(2) / ln(max(p) / min(p)))) / 1000000) END AS a FROM shares),
norm AS (SELECT sum(pow(p, a)) AS z, min(pow(p, a - 1)) AS low FROM shares, chosen),
targets AS (SELECT s, tokens, coalesce(round(pow(p, a) / z, 9), 0.0) AS weight,
  coalesce(floor(tokens * round(pow(p, a - 1) / low, 6)), 0)::BIGINT AS target,
  greatest(1, ceil(greatest(tokens / 1048576.0, docs / 10000.0)))::BIGINT AS blocks FROM shares, chosen, norm),
plan AS (SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE target // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE target % tokens END AS rest FROM targets),
own AS (SELECT u.s, u.doc_id, u.tokens, epochs, rest, {_BLOCK} AS block FROM units u JOIN plan p ON p.s = u.s WHERE rest > 0),
sums AS (SELECT s, block, epochs, rest, sum(tokens) AS tokens, {_key('s', 'block', 'epochs')} AS block_key FROM own GROUP BY ALL),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY block_key) AS through FROM sums),
last AS (SELECT s, arg_min(block, block_key) AS block, min(block_key) AS block_key, arg_min(rest - through + tokens, block_key) AS room
  FROM running WHERE through > rest GROUP BY s),
fits AS (SELECT o.s, {_key('o.doc_id', 'epochs')} AS doc_key, room, sum(tokens) OVER (PARTITION BY o.s ORDER BY {_key('o.doc_id', 'epochs')}) AS through
  FROM own o JOIN last l ON l.s = o.s AND l.block = o.block),
ends AS (SELECT l.s, block_key AS last_block, coalesce((SELECT max(doc_key) FROM fits f WHERE f.s = l.s AND through <= room), '') AS last_doc FROM last l),
read AS (SELECT d.*, weight, {_BLOCK} AS block, epochs, coalesce(last_block, '') AS last_block, coalesce(last_doc, '') AS last_doc
  FROM d JOIN plan USING (s) LEFT JOIN ends USING (s)),
times AS (SELECT *, epochs + CASE WHEN {_key('s', 'block', 'epochs')} < last_block
  OR ({_key('s', 'block', 'epochs')} = last_block AND {_key('doc_id', 'epochs')} <= last_doc) THEN 1 ELSE 0 END AS times FROM read),
spread AS (SELECT *, unnest(range(times)) AS epoch FROM times)
SELECT doc_id, source, epoch, block, {_key('s', 'block', 'epoch')} AS block_key, {_key('doc_id', 'epoch')} AS doc_key, weight, n_tokens FROM spread
"""

_CHAT = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text) AS copy FROM conversations),
u AS (SELECT conv_id, turn FROM c WHERE role = 'user' AND copy = 1), r AS (SELECT conv_id, turn FROM c WHERE role = 'assistant' AND copy = 1),
j AS (SELECT c.*, a.turn IS NOT NULL AS answered, q.turn AS call_at, z.turn IS NOT NULL AS has_first FROM c
  LEFT JOIN r a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 LEFT JOIN u q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1
  LEFT JOIN u z ON z.conv_id = c.conv_id AND z.turn = 0),
k AS (SELECT *, CASE role WHEN 'user' THEN CASE WHEN copy > 1 THEN 'repeated' WHEN answered THEN 'answered' ELSE 'unanswered' END
  WHEN 'assistant' THEN CASE WHEN copy > 1 THEN 'repeated' WHEN call_at IS NULL THEN 'orphan' ELSE 'linked' END END AS link FROM j)
SELECT conv_id, CASE WHEN role = 'user' AND link <> 'repeated' AND turn > 0 AND has_first THEN greatest(turn, 2)
  WHEN link = 'linked' THEN greatest(turn, 1 + CASE WHEN call_at > 0 AND has_first THEN greatest(call_at, 2) ELSE call_at END) ELSE turn END AS level,
  turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE role END AS role,
  CASE role WHEN 'user' THEN 't' || turn WHEN 'assistant' THEN 't' || (turn - 1) END AS call_id, link,
  CASE WHEN role = 'user' THEN turn WHEN role = 'assistant' THEN call_at END AS call_turn, false AS cyclic,
  CASE WHEN role = 'user' AND text IS NULL THEN '$.prompt: missing' WHEN role = 'user' AND text = '' THEN '$.prompt: too short' END AS problem,
  CASE role WHEN 'user' THEN '{"role":"assistant","tool_calls":[{"function":{"arguments":{' || coalesce('"prompt":' || to_json(text) || ',', '')
    || '"turn":' || turn || '},"name":"reply"},"id":"t' || turn || '","type":"function"}]}'
  WHEN 'assistant' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"t' || (turn - 1) || '"}'
  ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' END AS message
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _QUALITY,
        "op3_minhash_near_dedup": _NEAR,
        "op9_source_mixing": _MIX,
        "op10_chat_formatting": _CHAT,
    }
