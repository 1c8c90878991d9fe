"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations


def _repair_options(state: int) -> str:
    """The edits of one row from a state, each as a struct (cost, audit, lines) that ends in the next row's best."""
    user = {0: True, 1: True, 2: False, 3: True}
    options, at, letters, lines = [], state, "", ""
    for inserted in range(3):
        cost = 3 * inserted

        def option(condition: str, to: int, more: str, letter: str, line: str, before: str = lines, audit: str = letters) -> str:
            text = " || ".join(x for x in (f"chr(10) || '{before}'" if before else "", line, f"b{to}.t") if x)
            text = text.replace("~", "' || chr(10) || '")
            return (f"CASE WHEN {condition} THEN {{'c': b{to}.c + {cost} + {more}, 'a': '{audit}{letter}' || b{to}.a, 't': {text}}} END")

        own = "chr(10) || role || ':' || txt"
        after = 2 if user[at] else 3
        given = f"chr(10) || '{'user' if user[at] else 'assistant'}:' || txt"
        options.append(option("true", at, "4", "D", ""))
        if at == 0:
            options.append(option("NOT must_go AND ini = 's'", 1, "extra", "K", own))
        options.append(option(f"NOT must_go AND ini = '{'u' if user[at] else 'a'}'", after, "extra", "K", own))
        options.append(option("NOT must_go", after, "extra + 3", "R", given))
        lines += ("~" if lines else "") + ("user:" if user[at] else "assistant:")
        letters, at = letters + "I", after
    return "list_min([" + ",\n      ".join(options) + "])"


REPAIR = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS d
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt
  FROM dealt, range(2) AS r(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i,
    substr(role, 1, 1) AS ini, NOT regexp_matches(txt, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM damaged),
faults AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior,
    CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate'
         WHEN cut THEN 'truncated' ELSE '' END AS fault
  FROM placed),
kinds AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faults),
best AS (
  SELECT conv_id, max(n) + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b0,
    {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS b1,
    {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}} AS b2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b3
  FROM kinds GROUP BY conv_id
  UNION ALL
  SELECT best.conv_id, best.i - 1,
      {_repair_options(0)},
      {_repair_options(1)},
      {_repair_options(2)},
      {_repair_options(3)}
  FROM best JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM best.conv_id AND k.i = best.i - 1),
solved AS (SELECT conv_id, b0.c AS cost, b0.a AS audit, sha256(substr(b0.t, 2)) AS h FROM best WHERE i = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM o.conv_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS r(k) WHERE len(w) >= k),
freq AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM starts GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM freq WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n,
    ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS part FROM (
    SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.part = c.phrase AND 100 * p.a >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (
  SELECT DISTINCT doc_id AS d, doc_id AS o FROM words
  UNION
  SELECT r.d, l.b FROM reach r JOIN links l ON l.a = r.o),
label AS (SELECT d, min(o) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w JOIN label ON d = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id
"""

SHARDS = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS doc_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
spots AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE h >> (60 - k) END AS prefix FROM d, range(0, 61) AS r(k)),
buckets AS (SELECT k, prefix, sum(doc_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM spots GROUP BY k, prefix),
own AS (
  SELECT doc_id, doc_bytes, k, prefix, shard_bytes, shard_docs FROM spots JOIN buckets USING (k, prefix)
  WHERE shard_bytes <= 33554432 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1)
SELECT doc_id, k || ':' || printf('%015X', prefix) || ':0' AS shard, k AS shard_depth, doc_bytes, shard_bytes, shard_docs FROM own
"""

ORACLE = {"op2_near_dedup": NEAR_DEDUP, "op8_shard": SHARDS, "op12_collocations": COLLOCATIONS, "op13_conversation_repair": REPAIR}
