"""DuckDB SQL for the queries that SQL can express."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"

OP1 = """
WITH bit(k) AS (SELECT unnest(range(0, 256))),
step AS (
  SELECT k, list_reduce(list_prepend(k, range(0, 8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM bit
),
tab AS (SELECT list(v ORDER BY k) AS t FROM step),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents
),
raw AS (
  SELECT doc_id, size, hex(encode(text)) AS h FROM d
),
byte AS (
  SELECT doc_id, size, list_transform(range(0, size - 8), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS b FROM raw
),
crc AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM byte, tab
),
run AS (
  SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total,
    row_number() OVER o - 1 AS position
  FROM crc WINDOW o AS (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, (((2 * before + size) * 24) // (2 * total))::INT AS shard FROM run)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (position - min(position) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_BLANK}) AS w FROM documents
),
g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) AS gram
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
link AS (
  SELECT x, y, c = p.n AND c = q.n AS same FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
),
root AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
per AS (
  SELECT x, count(*) AS n_links, count(*) FILTER (same) AS twins, min(y) FILTER (same) AS low FROM link GROUP BY x
)
SELECT d.doc_id, class_id, least(d.doc_id, coalesce(low, d.doc_id)) AS set_id, coalesce(twins, 0) + 1 AS n_copies,
  coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_grams
FROM documents d JOIN root ON root.x = d.doc_id LEFT JOIN per ON per.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
byte AS (
  SELECT doc_id, p, h[2 * p + 1 : 2 * p + 2] AS b,
    CASE WHEN 2 * p + 200 <= length(h) THEN h[2 * p + 1 : 2 * p + 200] END AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)
),
mark AS (
  SELECT doc_id, p, b, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM byte
),
gone AS (
  SELECT doc_id, p, b,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS r
  FROM mark
),
edge AS (SELECT *, r AND NOT coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM gone),
per AS (
  SELECT doc_id, count(*) FILTER (r) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT r), '') AS kept
  FROM edge GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
s AS (SELECT page_id, octet_length(h) AS n, upper(sha1(h)) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM s GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      ((('0x' || x[5 * (k // 4) + 1 : 5 * (k // 4) + 5])::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s JOIN f USING (x)
"""

_KEPT = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9 = rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_KEPT}) AS w FROM benchmark
),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
),
d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_KEPT}) AS w FROM documents
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

# Unsigned CRC-32 of an ASCII text: the byte table, then one fold over the characters.
_CRC = """bit(k) AS (SELECT unnest(range(0, 256))),
step AS (
  SELECT k, list_reduce(list_prepend(k, range(0, 8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM bit
),
tab AS (SELECT list(v ORDER BY k) AS t FROM step)"""


def _crc(text: str) -> str:
    codes = f"list_transform(regexp_extract_all({text}, '.'), lambda x: ascii(x)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}),"
        " lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)"
    )


def _fields(*columns: str) -> str:
    """Leaf of a document: each field as its byte count and value, or a dash."""
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in columns]
    return f"sha256({' || '.join(parts)})"


_LEAF = _fields("doc_id", "source", "lang", "n_chars", "text")
_TAMPERED = _fields("doc_id", "source", "lang", "(n_chars + 1)", "text")
OP11 = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS checked
  FROM documents, tab
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM d
),
tree AS (
  SELECT lang, n, 0 AS lvl, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, n, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree
  WHERE n > (1::BIGINT << lvl) GROUP BY lang, n, lvl, pos // 2
),
subs AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n
  FROM tree WHERE n <= (1::BIGINT << lvl)
),
crown AS (
  SELECT n, 0 AS lvl, pos, subroot AS h FROM subs
  UNION ALL
  SELECT n, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown
  WHERE n > (1::BIGINT << lvl) GROUP BY n, lvl, pos // 2
),
top AS (SELECT h AS root, lvl AS height FROM crown WHERE n <= (1::BIGINT << lvl)),
low AS (
  SELECT l.lang, l.pos, list(CASE WHEN (l.pos >> k) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, '') ORDER BY k) AS path
  FROM (SELECT leaves.lang, leaves.pos, unnest(range(0, height)) AS k FROM leaves JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang) l
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = l.k AND t.pos = xor(l.pos >> l.k, 1)
  GROUP BY ALL
),
high AS (
  SELECT l.lang, list(CASE WHEN (l.pos >> k) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, '') ORDER BY k) AS path
  FROM (SELECT lang, subs.pos, unnest(range(0, top.height)) AS k FROM subs, top) l
  LEFT JOIN crown t ON t.lvl = l.k AND t.pos = xor(l.pos >> l.k, 1)
  GROUP BY l.lang
),
whole AS (
  SELECT leaves.*, subroot, root, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM leaves JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang CROSS JOIN top
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM leaves.lang AND low.pos = leaves.pos
  LEFT JOIN high ON high.lang IS NOT DISTINCT FROM leaves.lang
),
fold AS (
  SELECT *, list_reduce(list_prepend(checked, path),
    lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM fold
"""


def _after(state: int, letter: str, cost: str) -> str:
    return f"struct_pack(c := s{state}.c + {cost}, a := '{letter}' || s{state}.a)"


def _edits(state: int, keep: str, turn: int) -> str:
    """Cheapest audit of a state through the edits that use up the row."""
    kept = f"CASE WHEN NOT must THEN CASE role {keep} END END"
    rerole = f"CASE WHEN NOT must THEN {_after(turn, 'R', '1 + late')} END"
    return f"list_min([{_after(state, 'D', '2')}, {kept}, {rerole}])"


def _kept(initial: str, state: int) -> str:
    return f"WHEN '{initial}' THEN {_after(state, 'K', 'late')}"


def _insert(state: str, turn: str) -> str:
    return f"list_min([{state}, struct_pack(c := {turn}.c + 5, a := 'I' || {turn}.a)])"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13 = f"""
WITH RECURSIVE {_CRC},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit
  FROM conversations, tab
),
rows AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS again
  FROM raw WHERE hit <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i,
    trim(text, {_SPACE}) AS core
  FROM rows
),
marked AS (
  SELECT *, left(role, 1) AS initial, core = '' AS blank,
    core <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again_said,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair
  FROM numbered
),
faults AS (SELECT *, NOT blank AND NOT again_said AND right(core, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
tally AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again_said) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv
),
dp AS (
  SELECT conv, n AS i, struct_pack(c := 0::BIGINT, a := '') AS s0, struct_pack(c := 10::BIGINT, a := 'II') AS s1,
    struct_pack(c := 5::BIGINT, a := 'I') AS s2, struct_pack(c := 0::BIGINT, a := '') AS s3
  FROM tally
  UNION ALL
  SELECT conv, i, {_insert('b0', 'c2')}, {_insert('b1', 'c2')}, {_insert('b2', 'c3')}, {_insert('b3', 'c2')}
  FROM (
    SELECT *, {_insert('b2', 'b3')} AS c2, {_insert('b3', 'b2')} AS c3
    FROM (
      SELECT conv, dp.i - 1 AS i,
        {_edits(0, _kept('s', 1) + ' ' + _kept('u', 2), 2)} AS b0, {_edits(1, _kept('u', 2), 2)} AS b1,
        {_edits(2, _kept('a', 3), 3)} AS b2, {_edits(3, _kept('u', 2), 2)} AS b3
      FROM dp JOIN (
        SELECT conv, i, initial AS role, blank OR again_said AS must, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM faults
      ) f USING (conv, i)
    )
  )
),
best AS (SELECT conv, s0.c AS cost, s0.a AS audit FROM dp WHERE i = 0),
letters AS (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS t FROM best),
steps AS (
  SELECT conv, t, audit[t] AS e, length(replace(audit[1:t], 'I', '')) AS i, length(replace(audit[1:t], 'D', '')) AS made
  FROM letters
),
placed AS (
  SELECT s.*, f.role, f.text,
    coalesce(max(CASE WHEN made = 1 AND e = 'K' AND f.initial = 's' THEN 1 END) OVER (PARTITION BY s.conv), 0) AS led
  FROM steps s LEFT JOIN faults f ON f.conv = s.conv AND f.i = s.i AND s.e <> 'I'
),
said AS (
  SELECT conv, string_agg(
    CASE WHEN e = 'K' THEN role WHEN (made - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
    chr(10) ORDER BY t) AS said
  FROM placed WHERE e <> 'D' GROUP BY conv
),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM every LEFT JOIN tally USING (conv) LEFT JOIN best USING (conv) LEFT JOIN said USING (conv)
"""

SQL = {
    "op1_sharding": OP1, "op4_ngram_join": OP4, "op5_suffix_dedup": OP5, "op6_warc": OP6, "op9_decontamination": OP9,
    "op11_merkle_manifest": OP11, "op13_dialogue_repair": OP13,
}
