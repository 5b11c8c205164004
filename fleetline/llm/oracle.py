"""DuckDB SQL for those operators whose whole result SQL can express.

Operators 1 to 10 cannot be: DuckDB has no XXH64 or tokenizer, HTML reader or iterative fit, and a CRC-32 written in SQL
is too slow for whole texts. Those are tested in tests/llm against a brute-force version, sharding also against SQL
without its checksum column.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of short ASCII keys by its table, then the dynamic programme as a recursive query with one row for each state.
CONVERSATIONS = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS tab),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
         lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c // 256)), 4294967295) % 20 AS code FROM given, crc),
damaged AS (
  SELECT g, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (VALUES (1), (2)) AS c(copy) WHERE code <> 0 AND (copy = 1 OR code = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
chain(s, t, ins, price, piece) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 3, 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'), (3, 2, 'I', 3, chr(10) || 'user:'),
  (0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(s, t, letter, price, initial, new_role) AS (VALUES
  (0, 0, 'D', 4, NULL, NULL), (1, 1, 'D', 4, NULL, NULL), (2, 2, 'D', 4, NULL, NULL), (3, 3, 'D', 4, NULL, NULL),
  (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL),
  (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'), (3, 2, 'R', 3, NULL, 'user')),
states AS (
  SELECT g, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS written FROM (SELECT DISTINCT g FROM given)
  UNION ALL
  SELECT g, i, s, cost, audit, written FROM (
    SELECT j.g, j.i, e.t AS s, st.cost + c.price + e.price + CASE WHEN e.letter <> 'D' AND cut THEN 3 ELSE 0 END AS cost,
           st.audit || c.ins || e.letter AS audit,
           st.written || c.piece || CASE WHEN e.letter = 'D' THEN '' ELSE CASE WHEN c.t = 0 THEN '' ELSE chr(10) END
             || coalesce(e.new_role, j.role) || ':' || j.text END AS written
    FROM states st JOIN judged j ON j.g = st.g AND j.i = st.i + 1 JOIN chain c ON c.s = st.s JOIN edit e ON e.s = c.t
    WHERE (e.letter = 'D' OR NOT (blank OR again)) AND (e.initial IS NULL OR e.initial = substr(j.role, 1, 1))) AS tried
  QUALIFY row_number() OVER (PARTITION BY g, s ORDER BY cost, audit) = 1),
ended AS (
  SELECT st.g, st.cost + c.price AS cost, st.audit || c.ins AS audit, st.written || c.piece AS written
  FROM states st JOIN (SELECT g, count(*) AS n FROM judged GROUP BY g UNION ALL SELECT g, 0 FROM given WHERE g NOT IN (SELECT g FROM judged) GROUP BY g) m
    ON m.g = st.g AND m.n = st.i JOIN chain c ON c.s = st.s AND c.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY st.g ORDER BY st.cost + c.price, st.audit || c.ins) = 1),
counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY g)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(e.cost AS BIGINT) AS cost, e.audit, sha256(e.written) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM given) n JOIN ended e ON e.g = n.g LEFT JOIN counted k ON k.g = n.g
"""

#: All pairs that share a shingle, and reachability over the links.
MINHASH = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM shingled),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM shingled UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN least ON a = doc_id
"""

#: Removal is replayed for each order; the sum over orders is taken from the steps themselves.
FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, quality, toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > id THEN 'E' ELSE '' END AS f
  FROM (SELECT d.*, first.id, quality, toxic, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w
        FROM d JOIN first ON d.t = first.t LEFT JOIN known ON known.doc_id = d.doc_id)),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM judged GROUP BY part, f),
letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
played AS (
  SELECT part, o, k, substr(o, k, 1) AS own, f, n, good, toxic, contains(f, substr(o, k, 1)) AS fails,
         regexp_replace(f, '[' || left(o, k - 1) || '_]', '', 'g') <> f AS before
  FROM kinds, orders, range(1, 6) AS r(k)),
steps AS (
  SELECT part, o, k, own, sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM played GROUP BY part, o, k, own)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversations": CONVERSATIONS, "op12_minhash": MINHASH, "op13_filter_audit": FILTER_AUDIT}
