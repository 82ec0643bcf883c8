"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: crc32 as SQL: a table made bit by bit, then one step a byte of an ASCII string `s`.
CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)) AS crc"""
CRC = "xor(list_reduce(list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _merkle() -> str:
    """Trees, then every leaf's way up through lists of its run, for the digest as it was and as it is now."""
    rest = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, sha256({rest} || {_encoded('text')}) AS leaf,
         sha256({rest} || {_encoded(f"CASE WHEN {CRC.format(s='CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {lowered} ELSE text END")}) AS now
  FROM documents, {CRC_TABLE}),
l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM d),
node AS (
  SELECT 0 AS lvl, part, idx, n, leaf AS h FROM l
  UNION ALL
  SELECT lvl + 1, part, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lvl, part, idx // 8, n),
top AS MATERIALIZED (
  SELECT part, lvl AS height, h, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, n, h FROM top
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n),
runs AS MATERIALIZED (
  SELECT part, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM node WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT top.part, top.height + r.lvl, 0, r.hs FROM top JOIN (
    SELECT lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM high WHERE n > 1 GROUP BY ALL) AS r ON top.idx // CAST(8 ** (r.lvl + 1) AS BIGINT) = r.run),
way AS (
  SELECT l.doc_id, l.part, l.leaf, l.idx AS spot, l.now AS h, 0 AS lvl, '' AS proof FROM l
  UNION ALL
  SELECT w.doc_id, w.part, w.leaf, w.spot,
         sha256(array_to_string(r.hs[:digit], '') || w.h || array_to_string(r.hs[digit + 2:], '')), w.lvl + 1,
         w.proof || array_to_string(r.hs[:digit], '') || array_to_string(r.hs[digit + 2:], '')
  FROM (SELECT way.*, CASE WHEN way.lvl < top.height THEN (spot // CAST(8 ** way.lvl AS BIGINT)) % 8
                           ELSE (top.idx // CAST(8 ** (way.lvl - top.height) AS BIGINT)) % 8 END AS digit,
               CASE WHEN way.lvl < top.height THEN spot // CAST(8 ** (way.lvl + 1) AS BIGINT) ELSE 0 END AS run
        FROM way JOIN top ON top.part = way.part) AS w
  JOIN runs AS r ON r.part = w.part AND r.lvl = w.lvl AND r.run = w.run),
done AS (SELECT doc_id, part, spot, leaf, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM way GROUP BY ALL)
SELECT done.doc_id, done.leaf, top.h AS subroot, root.h AS root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
FROM done JOIN top ON top.part = done.part, (SELECT h FROM high WHERE n = 1) AS root"""


def _repair() -> str:
    """Left to right over the rows with the best (cost, edits) of each role state; the states of
    (s?(ua)+)? are 0 none, 1 behind s, 2 behind u, 3 behind a, each closed under insertion."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    add = lambda s, cost, edits: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edits}'}} END"
    edit = lambda s, role: f"CASE WHEN gone THEN NULL WHEN ini = '{role}' THEN {add(s, 'cut', 'K')} ELSE {add(s, '3 + cut', 'R')} END"
    n2 = ", ".join([add("s2", 4, "D"), *(edit(s, "u") for s in ("s0", "s1", "s3"))])
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(s=key)} % 20 AS f FROM conversations, {CRC_TABLE}),
x AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) WHERE f <> 0),
e AS (
  SELECT *, right(rtrim(text, {space}), 1) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM x),
k AS MATERIALIZED (
  SELECT *, left(role, 1) AS ini, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_ini,
         CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM e),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM k GROUP BY conv_id),
best AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': ''}} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s1, {{'c': 3, 'a': 'I'}} AS s2, {{'c': 6, 'a': 'II'}} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, n0, n1, least(n2, {add('n0', 3, 'I')}, {add('n1', 3, 'I')}, {add('n3', 3, 'I')}),
         least(n3, {add('n2', 3, 'I')}, {add('n0', 6, 'II')}, {add('n1', 6, 'II')})
  FROM (SELECT conv_id, i, {add('s0', 4, 'D')} AS n0,
               least({add('s1', 4, 'D')}, CASE WHEN ini = 's' AND NOT gone THEN {add('s0', 'cut', 'K')} END) AS n1,
               least({n2}) AS n2, least({add('s3', 4, 'D')}, {edit('s2', 'a')}) AS n3
        FROM (SELECT best.conv_id, k.i, s0, s1, s2, s3, ini, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut
              FROM best JOIN k ON k.conv_id IS NOT DISTINCT FROM best.conv_id AND k.i = best.i + 1))),
done AS MATERIALIZED (
  SELECT c.*, least(s0, s3) AS b FROM best JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND c.n = best.i),
w AS (
  SELECT conv_id, j, substr(b.a, j, 1) AS ch FROM done, unnest(range(1, length(b.a) + 1)) AS t(j)),
o AS (
  SELECT *, sum(CAST(ch <> 'I' AS INTEGER)) OVER v AS i, sum(CAST(ch <> 'D' AS INTEGER)) OVER v AS place FROM w WINDOW v AS (PARTITION BY conv_id ORDER BY j)),
r AS (
  SELECT o.*, k.role, k.text, max(CASE WHEN ch = 'K' AND place = 1 AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS sys
  FROM o LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.i = o.i AND ch <> 'I' WHERE ch <> 'D'),
h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN ch = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS h
  FROM r GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(done.b.c, 0) AS BIGINT) AS cost, coalesce(done.b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM q.conv_id"""


SQL = {
    "op12_conversation_repair": _repair(),
    "op11_merkle_manifest": _merkle(),
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
cls AS (
  SELECT doc_id, md5(string_agg(md5(sh), '' ORDER BY sh)) AS fp FROM s GROUP BY doc_id),
low AS (SELECT fp, min(doc_id) AS class_id FROM cls GROUP BY fp)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.class_id, d.doc_id) AS class_id, c.component_id
FROM documents d JOIN comp c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN cls ON cls.doc_id = d.doc_id LEFT JOIN low ON low.fp = cls.fp""",
    "op1_embedding_near_duplicates": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(deg.k, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id""",
}
